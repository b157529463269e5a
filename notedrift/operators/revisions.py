"""Revision (corrected filing) resolution and duplicate detection.

F1 keeps, for each (company, report), the filing that was valid before the
next quarter's data could be known: an on-time correction replaces the filing
right before it; a late correction is dropped.  The reference walks the sorted
rows once and compares each row with the *previous row* (deleted or not), so
the rule is a pure ``lead``/``lag`` window over ``partitionBy(keys)`` - one
hash shuffle on the keys, no iteration, no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P


def _order(date: str, tiebreak: str | None) -> list[Column]:
    cols = [F.col(date).asc()]
    if tiebreak:
        cols.append(F.col(tiebreak).asc())
    return cols


def revision_flags(df: DataFrame, keys: Sequence[str] = ("crp_cd", "rpt_nm"),
                   date: str = "rcp_dt", tiebreak: str | None = "rcp_no",
                   is_correction: Column | None = None, deadline: Column | None = None,
                   strict: bool = False, corrections_only: bool = True) -> DataFrame:
    """Adds boolean ``is_deleted`` following the resolution rule.

    ``date`` is the sort key ('yyyy.mm.dd' strings sort chronologically);
    the filing date used against the deadline is parsed from it.
    """
    rpt = F.col(keys[-1])
    y, m = P.closing_year(rpt), P.closing_month(rpt)
    filed = P.filing_date(F.col(date))
    if deadline is None:
        deadline = P.correction_deadline_first(y, m) if strict else P.correction_deadline(y, m)
    if is_correction is None:
        is_correction = F.col("dic_cls") != F.lit("NA")
    # strict (first-pass) rule: on time = filed < deadline; default: filed <= deadline
    on_time = (filed < deadline) if strict else (filed <= deadline)
    tested = is_correction if corrections_only else F.lit(True)
    w = Window.partitionBy(*keys).orderBy(*_order(date, tiebreak))
    x = (df.withColumn("_tested", F.coalesce(tested, F.lit(False)))
           .withColumn("_on_time", on_time)
           .withColumn("_nth", F.row_number().over(w))
           .withColumn("_next_tested", F.lead("_tested").over(w))
           .withColumn("_next_on_time", F.lead("_on_time").over(w)))
    # a tested row that follows a row of the same key deletes itself when late
    # (also when the deadline cannot be computed: the comparison raises in the
    # reference; we treat an unknown deadline as "not on time") ...
    self_del = (F.col("_nth") > 1) & F.col("_tested") & ~F.coalesce(F.col("_on_time"), F.lit(False))
    # ... and deletes the row before it when on time
    prev_del = F.coalesce(F.col("_next_tested"), F.lit(False)) & F.coalesce(F.col("_next_on_time"), F.lit(False))
    return (x.withColumn("is_deleted", self_del | prev_del)
             .drop("_tested", "_on_time", "_nth", "_next_tested", "_next_on_time"))


def resolve_revisions(df: DataFrame, keys: Sequence[str] = ("crp_cd", "rpt_nm"),
                      date: str = "rcp_dt", tiebreak: str | None = "rcp_no",
                      is_correction: Column | None = None, deadline: Column | None = None,
                      strict: bool = False, corrections_only: bool = True) -> DataFrame:
    """surviving filings after revision resolution."""
    flagged = revision_flags(df, keys, date, tiebreak, is_correction, deadline, strict, corrections_only)
    return flagged.filter(~F.col("is_deleted")).drop("is_deleted")


def resolve_revisions_strict(df: DataFrame, keys: Sequence[str] = ("crp_cd", "rpt_nm"),
                             date: str = "rcp_dt", tiebreak: str | None = "rcp_no") -> DataFrame:
    """The earlier rule - any repeat is tested, deadline = first day of the
    closing month + 3 months, strict ``<``.  Same-day ties are ordered by
    ``tiebreak`` (the reference leaves them to an unstable sort)."""
    return resolve_revisions(df, keys, date, tiebreak, strict=True, corrections_only=False)


def find_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys that occur more than once, with their count (partial aggregation)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if ``keys`` is not unique (one small aggregate action)."""
    dup = find_duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dup[0].asDict()} for {list(keys)}")


def same_day_last(df: DataFrame, keys: Sequence[str] = ("crp_cd", "rpt_nm", "rcp_dt"),
                  order: str = "rcp_no") -> DataFrame:
    """of filings of the same key on the same day keep the last one."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
