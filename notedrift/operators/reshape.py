"""Reshaping (H4-H7) and small aggregate checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import calendar_parts


def unpivot_calendar(df: DataFrame, ids: Sequence[str], date_cols: Sequence[str] | None = None,
                     value: str = "value") -> DataFrame:
    """H4: wide sheet (one column per quarter-end date 'yyyy-mm-dd') -> long
    rows (ids, date, month, year, quarter, value)."""
    date_cols = list(date_cols) if date_cols is not None else [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), date_cols, "date_col", value)
    long = long.withColumn("date", F.to_date("date_col")).drop("date_col")
    m, y, q = calendar_parts("date")
    return long.withColumn("month", m).withColumn("year", y).withColumn("quarter", q)


def distinct_levels(df: DataFrame, col: str) -> list:
    """Distinct non-null values of a column, sorted (one column of the wide form each)."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def one_hot_long(df: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """H5 in sparse form: (key, level) for every non-null value; no width and so no limit of levels."""
    return df.select(*key, F.col(col).alias("level")).where(F.col("level").isNotNull())


def one_hot(df: DataFrame, col: str, prefix: str | None = None, levels: Sequence | None = None,
            drop_first: bool = False) -> DataFrame:
    """H5: indicator columns ``<prefix>_<value>`` sorted by value; null -> all 0;
    the source column is dropped.  For many levels use ``one_hot_long``."""
    prefix = prefix or col
    levels = list(levels) if levels is not None else distinct_levels(df, col)
    if drop_first:
        levels = levels[1:]
    ind = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in levels]
    return df.select(*[c for c in df.columns if c != col], *ind)


def encode_labels(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """H7: alphabetical label -> 0..k-1; null stays null.  The distinct labels are
    ranked in ranges (no un-partitioned window) and joined back by key."""
    from .stats import group_ranks
    out = out or f"{col}_code"
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    coded = group_ranks(levels.withColumn("_one", F.lit(0)), "_one", col, out="_rank")
    return df.join(coded.select(col, (F.col("_rank") - 1).cast("long").alias(out)), col, "left")


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def row_ratio_check(wide: DataFrame, long: DataFrame, n_periods: int) -> DataFrame:
    """rows_out / rows_in must equal the number of periods (one row)."""
    tagged = (wide.select(F.lit(1).alias("_in"), F.lit(0).alias("_out"))
                  .unionByName(long.select(F.lit(0).alias("_in"), F.lit(1).alias("_out"))))
    c = tagged.agg(F.sum("_in").cast("long").alias("rows_in"), F.sum("_out").cast("long").alias("rows_out"))
    return (c.withColumn("n_periods", F.lit(n_periods).cast("long"))
             .withColumn("ok", F.col("rows_out") == F.col("rows_in") * F.col("n_periods")))


def compare_means(df: DataFrame, value: str, sample: str, a: str, b: str) -> DataFrame:
    """the mean of two samples and which one is larger (one row)."""
    m = (df.filter(F.col(sample).isin(a, b))
           .agg(F.avg(F.when(F.col(sample) == a, F.col(value))).alias("mean_a"),
                F.avg(F.when(F.col(sample) == b, F.col(value))).alias("mean_b")))
    return m.select(F.lit(a).alias("sample_a"), F.lit(b).alias("sample_b"), "mean_a", "mean_b",
                    F.when(F.col("mean_a") > F.col("mean_b"), F.lit(a))
                     .when(F.col("mean_b") > F.col("mean_a"), F.lit(b)).otherwise(F.lit("equal")).alias("larger"))
