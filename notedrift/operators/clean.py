"""Projections, filters, null handling, sorting and set operations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import closing_year

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def filter_period_names(df: DataFrame, years: Iterable[int] = range(2013, 2019), col: str = "rpt_nm",
                        typed: bool = False) -> DataFrame:
    """Keep rows whose report name contains any of the years anywhere
    (``typed=True``: the closing year parsed from '(yyyy.mm)' is in the list)."""
    years = [int(y) for y in years]
    if typed:
        return df.filter(closing_year(F.col(col)).isin(*years))
    return df.filter(F.col(col).rlike("|".join(str(y) for y in years)))


def distinct_codes(df: DataFrame, col: str = "crp_cd") -> DataFrame:
    """Distinct company codes."""
    return df.select(col).distinct()


def exclude_industry_prefixes(df: DataFrame, industry: DataFrame, prefixes: Sequence[str] = ("64", "65", "66"),
                              key: str = "crp_cd", code: str = "ind_cd", drop: Sequence[str] = ("acc_crp",),
                              keep_unknown: bool = True) -> DataFrame:
    """Attach the industry code (inner join on the company code), drop
    codes starting with any prefix, drop the auditor column.  A missing code is
    kept when ``keep_unknown`` (the reference leaves it undefined)."""
    j = df.join(industry, key, "inner")
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.col(code).startswith(p)
    cond = ~F.coalesce(starts, F.lit(not keep_unknown))
    return j.filter(cond).drop(*[c for c in drop if c in j.columns])


def split_missing_notes(df: DataFrame, note: str = "foot_note", missing: str = "NA") -> tuple[DataFrame, DataFrame]:
    """C4: (rows without note, rows with note)."""
    is_missing = F.col(note).isNull() | (F.col(note) == missing)
    return df.filter(is_missing), df.filter(~is_missing)


def originals_only(df: DataFrame, col: str = "dic_cls", missing: str = "NA") -> DataFrame:
    """Filings that are not corrections."""
    return df.filter(F.col(col) == missing)


def zero_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric 0 -> null in the given (default: all numeric) columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    return df.select(*[F.nullif(F.col(c), F.lit(0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame, thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (or with fewer than ``thresh`` non-nulls)."""
    if thresh is None:
        return df.na.drop(how="any", subset=list(subset) if subset else None)
    return df.na.drop(thresh=thresh, subset=list(subset) if subset else None)


def nonblank_cast(df: DataFrame, col: str, to: str = "double") -> DataFrame:
    """Keep rows where ``col`` is not '' and cast it (bad values -> null)."""
    return df.filter(F.col(col) != "").withColumn(col, F.col(col).try_cast(to))


def filter_year(df: DataFrame, col: str = "year", exclude: int = 2012) -> DataFrame:
    """Drop a warm-up year."""
    return df.filter(F.col(col) != exclude)


def select_columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name matches a regex (e.g. '^M')."""
    rx = re.compile(pattern)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if rx.search(c)])


def arrange_columns(df: DataFrame, first: Sequence[str] = (), last: Sequence[str] = (),
                    drop: Sequence[str] = ()) -> DataFrame:
    """C11: move ``first`` to the front and ``last`` to the end, drop ``drop``."""
    middle = [c for c in df.columns if c not in first and c not in last and c not in drop]
    return df.select(*[F.col(f"`{c}`") for c in [*first, *middle, *last]])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C12."""
    return df.drop(*cols)


def take_first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in ``order`` (a top-n; Spark plans TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def prefer_consolidated(df: DataFrame, note: str = "foot_note", consolidated: str = "consolidated_foot_note",
                        missing: str = "NA", keep: bool = False, use_consolidated: bool = True) -> DataFrame:
    """C14: the note to analyse: the consolidated note when present, else the
    separate note (``use_consolidated=False``: separate note only).  ``keep``
    keeps the consolidated column."""
    if use_consolidated:
        df = df.withColumn(note, F.coalesce(F.nullif(F.col(consolidated), F.lit(missing)), F.col(note)))
    return df if keep else df.drop(consolidated)


def note_variants(originals: DataFrame, revised: DataFrame, note: str = "foot_note",
                  consolidated: str = "consolidated_foot_note") -> dict[str, DataFrame]:
    """C14: the four variants {originals, revised} x {separate, consolidated-first}.
    The fourth keeps the consolidated column, as the reference's does."""
    return {
        "originals_separate": prefer_consolidated(originals, note, consolidated, use_consolidated=False),
        "revised_separate": prefer_consolidated(revised, note, consolidated, use_consolidated=False),
        "originals_consolidated": prefer_consolidated(originals, note, consolidated),
        "revised_consolidated": prefer_consolidated(revised, note, consolidated, keep=True),
    }


def to_number(c: Column, numeric_strings_are_missing: bool = False) -> Column:
    """Typed numeric view of a value: numbers pass, strings are parsed
    (``numeric_strings_are_missing``: any string counts as missing)."""
    if numeric_strings_are_missing:
        return F.lit(None).cast("double")
    return c.cast("string").try_cast("double")


def fill_from_alternate_basis(df: DataFrame, main: str = "M", order: Sequence[str] = ("6", "3"),
                              sep: str = "-", numeric_strings_are_missing: bool = False) -> DataFrame:
    """For every ``M<code>-<item>`` column, a missing or non-numeric value is
    taken from the same item on the other bases, in ``order`` of preference
    (default: consolidated '6' before separate '3').  Output: typed doubles."""
    items: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if sep in c:
            head, item = c.split(sep, 1)
            items.setdefault(item, {})[head[:1]] = c
    out = []
    mains = set()
    for item, by_basis in items.items():
        if main not in by_basis:
            continue
        mcol = by_basis[main]
        mains.add(mcol)
        typed = [_numeric_cell(df, mcol, numeric_strings_are_missing)]
        typed += [_numeric_cell(df, by_basis[b], numeric_strings_are_missing) for b in order if b in by_basis]
        out.append(F.coalesce(*typed).alias(mcol))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in mains]
    return df.select(*rest, *out)


def _numeric_cell(df: DataFrame, c: str, strings_missing: bool) -> Column:
    dt = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if isinstance(dt, NUMERIC_TYPES):
        return col.cast("double")
    return to_number(col, strings_missing)


def dedupe_column_names(df: DataFrame) -> DataFrame:
    """Keep the first of repeated column names."""
    seen, idx = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            idx.append(i)
    if len(idx) == len(df.columns):
        return df
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in idx])


def sort_filings(df: DataFrame, keys: Sequence[str] = ("crp_cd", "rpt_nm", "rcp_dt", "rcp_no"),
                 ascending: bool | Sequence[bool] = True) -> DataFrame:
    """H1: global multi-key sort (range-partitioned by Spark)."""
    return df.orderBy(*keys, ascending=ascending)


def union_frames(frames: Sequence[DataFrame], common_only: bool = True) -> DataFrame:
    """H2: vertical concat on the common columns (``join='inner'``) or on all
    columns with nulls for the missing ones."""
    if common_only:
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
        frames = [f.select(*common) for f in frames]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def set_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """H3: rows of ``a`` whose key is not in ``b`` (anti join)."""
    return a.join(b.select(*on), list(on), "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """H3: rows occurring exactly once in the concatenation of ``a`` and ``b``."""
    cols = a.columns
    u = a.unionByName(b)
    return u.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1).drop("_n")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """Helper: first ``n`` rows per key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hconcat_tables(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Side-by-side concat of tables that share ``keys``, aligned to
    the first table (keyed left joins instead of row positions); a column name
    that repeats keeps its first occurrence."""
    out = frames[0]
    seen = set(out.columns)
    for f in frames[1:]:
        new = [c for c in f.columns if c not in seen]
        seen.update(new)
        out = out.join(f.select(*keys, *new), list(keys), "left")
    return out
