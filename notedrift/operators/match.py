"""Joins (E1-E10): keyed equi-joins replace the reference's positional and
row-loop lookups.  "Next quarter" is a join on ``period + 1`` (calendar next),
never the next row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .revisions import assert_unique


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared column names."""
    on = [c for c in a.columns if c in b.columns]
    return a.join(b, on, how)


def left_join_suffix(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join; clashing non-key columns get suffixes."""
    clash = [c for c in a.columns if c in b.columns and c not in on]
    a2 = a.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in a.columns])
    b2 = b.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in b.columns])
    return a2.join(b2, list(on), "left")


def match_filings_to_panel(filings: DataFrame, panel: DataFrame, on: Sequence[str] = ("symbol", "period"),
                           require_unique: bool = True) -> DataFrame:
    """Each filing gets the panel row of the same company and quarter;
    unmatched filings are kept with nulls and ``is_matched = false``.  A key that
    the panel holds twice would repeat filings and is an error (``require_unique``)."""
    if require_unique:
        assert_unique(panel, on)
    p = panel.withColumn("_m", F.lit(True))
    return (filings.join(p, list(on), "left")
                   .withColumn("is_matched", F.coalesce(F.col("_m"), F.lit(False))).drop("_m"))


def attach_next_period_target(panel: DataFrame, targets: Sequence[str], entity: str = "symbol",
                              period: str = "period", features: Sequence[str] = (),
                              zero_is_missing: bool = True, shift: int = 1, cast: str | None = None,
                              complete: bool = True, suffix: str = "_next",
                              target_frame: DataFrame | None = None, require_unique: bool = True) -> DataFrame:
    """The row at t gets the targets of t+shift (calendar quarter).

    The targets come from ``target_frame``, by default from ``panel`` itself; a
    key that a separate frame holds twice is an error (``require_unique``).
    Pre-filter as the reference: features with 0 -> null, rows with a missing
    feature dropped; target rows must have all targets; at the end only
    complete rows are kept (``complete``).
    """
    cur = panel
    if features:
        if zero_is_missing:
            cur = cur.select(*[F.nullif(F.col(c), F.lit(0)).alias(c) if c in features else F.col(c)
                               for c in cur.columns])
        cur = cur.na.drop(how="any", subset=list(features))
    source = _targets(panel, target_frame, (entity, period), require_unique)
    nxt = source.select(F.col(entity), (F.col(period) - shift).alias(period),
                        *[(F.col(t).cast(cast) if cast else F.col(t)).alias(t + suffix) for t in targets])
    nxt = nxt.na.drop(how="any", subset=[t + suffix for t in targets])
    return cur.join(nxt, [entity, period], "inner" if complete else "left")


def _targets(panel: DataFrame, target_frame: DataFrame | None, key: Sequence[str], require_unique: bool) -> DataFrame:
    if target_frame is not None and require_unique:
        assert_unique(target_frame, key)
    return panel if target_frame is None else target_frame


def attach_current_target(panel: DataFrame, target: str, new_name: str, entity: str = "symbol",
                          period: str = "period", target_frame: DataFrame | None = None,
                          require_unique: bool = True) -> DataFrame:
    """The current-quarter target under a new name: a left join with
    ``target_frame`` on the key, null when absent; without one, a column of ``panel``."""
    if target_frame is None:
        return panel.withColumn(new_name, F.col(target))
    source = _targets(panel, target_frame, (entity, period), require_unique)
    return panel.join(source.select(entity, period, F.col(target).alias(new_name)), [entity, period], "left")


def attach_previous_target(panel: DataFrame, target: str, entity: str = "symbol", period: str = "period",
                           new_name: str | None = None, lag: int = 1, target_frame: DataFrame | None = None,
                           require_unique: bool = True) -> DataFrame:
    """Target of the previous calendar quarter (t-1), null when absent;
    from ``target_frame``, by default from ``panel`` itself."""
    new_name = new_name or f"{target}_prev"
    source = _targets(panel, target_frame, (entity, period), require_unique)
    prev = source.select(F.col(entity), (F.col(period) + lag).alias(period), F.col(target).alias(new_name))
    return panel.join(prev, [entity, period], "left")


def match_prior_filings(df: DataFrame, entity: str = "crp_cd", period: str = "period", id_col: str = "rcp_no",
                        lags: Mapping[str, int] | None = None, order: Sequence[str] = ("rcp_dt", "rcp_no")) -> DataFrame:
    """E5: for each filing, the id of the filing of the same company ``lag``
    quarters back (first in ``order`` when several); null when none.

    The candidate per (company, period) is chosen with a partial aggregate
    (``min_by``), so a company with very many filings is pre-aggregated on the
    map side before any shuffle.
    """
    lags = dict(lags or {"q": 1, "y": 4})
    first = (df.groupBy(entity, period)
               .agg(F.min_by(F.col(id_col), F.struct(*[F.col(c) for c in order])).alias("_first")))
    # every candidate is sent to each quarter that looks back at it, so all lags take one pass and one join
    targets = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(lag).alias("lag")) for name, lag in lags.items()])
    look = (first.select(entity, period, "_first", F.explode(targets).alias("_t"))
                 .select(entity, (F.col(period) + F.col("_t.lag")).alias(period), "_first", F.col("_t.name").alias("_name"))
                 .groupBy(entity, period)
                 .agg(*[F.max(F.when(F.col("_name") == name, F.col("_first"))).alias(f"prior_{name}") for name in lags]))
    return df.join(look, [entity, period], "left")


def prefix_range_join(df: DataFrame, ranges: DataFrame, key: Sequence[str], code: str = "ind_cd",
                      prefix: str = "range", pos: str = "pos", on_overlap: str = "last",
                      value_cols: Sequence[str] = ("sector", "sector2")) -> DataFrame:
    """Match a code to every range whose prefix it starts with.

    Implemented as an equi-join on the code's prefixes of every length
    that occurs in the range table (``substring(code, 1, k)``), so no theta join
    is needed and the range table may be any size; only the distinct lengths
    reach the driver.  An empty prefix matches every code once.  ``on_overlap='last'`` keeps, per ``key``, the match with the
    highest ``pos`` (the reference's last-row-wins) and keeps unmatched rows with
    nulls; ``'all'`` returns one row per match (a row may fall in several ranges).
    """
    key = list(key)
    found = sorted(r[0] for r in ranges.select(F.length(prefix)).distinct().collect() if r[0] is not None)
    lens = F.filter(F.array(*(F.lit(n) for n in found)).cast("array<int>"), lambda n: n <= F.length(F.col(code)))
    cand = (df.select(*key, code).filter(F.col(code).isNotNull())
              .withColumn("_plen", F.explode(lens))
              .withColumn(prefix, F.expr(f"substring({code}, 1, _plen)")))
    r = ranges.select(prefix, pos, *value_cols)
    j = cand.join(r, prefix, "inner").drop("_plen", code)
    if on_overlap == "all":
        return df.join(j, key, "inner")
    best = (j.groupBy(*key)
              .agg(F.max_by(F.struct(*[F.col(v) for v in value_cols], F.col(prefix)), F.col(pos)).alias("_b"))
              .select(*key, *[F.col(f"_b.{v}").alias(v) for v in value_cols], F.col(f"_b.{prefix}").alias(prefix)))
    return df.join(best, key, "left")


def exclude_ids(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose id is not listed (anti join)."""
    return df.join(ids.select(*on), list(on), "left_anti")


def attach_by_key(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Keyed side-by-side attachment (replaces positional hstack)."""
    return a.join(b, list(on), how)
