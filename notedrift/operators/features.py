"""Feature preparation.

Randomness is derived from ``md5(id || '|' || seed)``, so folds, splits and
noise are reproducible whatever the partitioning (Spark's ``rand(seed)``
depends on it).  Ordered operations (fold numbering within a class, position
alignment of two corpora) use distributed ranks (``group_ranks``), never an
un-partitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import group_ranks


def seeded_key(id_col: str, seed: int) -> Column:
    """Portable pseudo-random key of a row: md5 of 'id|seed' (hex)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def seeded_uniform(id_col: str, seed: int) -> Column:
    """Uniform [0, 1) from the first 32 bits of the seeded md5."""
    return F.conv(F.substring(seeded_key(id_col, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def assemble_features(df: DataFrame, inputs: Sequence[str], out: str = "features",
                      handle_invalid: str = "error") -> DataFrame:
    """Vector of array/vector/numeric columns (arrays become dense vectors).
    ``handle_invalid='keep'`` (NaN for missing) needs vector sizes in the
    column metadata; the default fails on a missing value instead."""
    tmp, cols = df, []
    for c in inputs:
        dt = df.schema[c].dataType.simpleString()
        if dt.startswith("array"):
            tmp = tmp.withColumn(f"_v_{c}", array_to_vector(F.col(c)))
            cols.append(f"_v_{c}")
        else:
            cols.append(c)
    va = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid)
    return va.transform(tmp).drop(*[c for c in cols if c.startswith("_v_")])


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min) over all rows; a constant column gives 0."""
    st = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = df
    for c in cols:
        lo, hi = st.select(f"_lo_{c}").scalar(), st.select(f"_hi_{c}").scalar()
        rng = hi - lo
        out = out.withColumn(c + suffix, F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c) - lo) / rng))
    return out


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population std; a constant column gives 0."""
    st = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    out = df
    for c in cols:
        mu, sd = st.select(f"_mu_{c}").scalar(), st.select(f"_sd_{c}").scalar()
        out = out.withColumn(c + suffix, F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - mu) / sd))
    return out


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Products of column pairs, named 'AxB'."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}x{b}") for a, b in pairs])


def f_regression_scores(df: DataFrame, vec_col: str, y: str) -> DataFrame:
    """Univariate F score of every array element against a continuous target:
    F = r^2 / (1 - r^2) * (n - 2); null for a perfect or undefined correlation."""
    x = df.select(F.posexplode(vec_col).alias("feature", "x"), F.col(y).cast("double").alias("y"))
    g = x.groupBy("feature").agg(F.corr(F.col("x").cast("double"), "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("feature", (F.try_divide(F.col("r") ** 2, 1 - F.col("r") ** 2) * (F.col("n") - 2)).alias("f_score"))


def select_percentile(scores: DataFrame, percentile: float = 5.0) -> DataFrame:
    """Keep the top ``percentile`` % features by score (at least one).
    The score table has one row per feature, so its window is small."""
    n = scores.count()
    k = max(1, int(n * percentile / 100.0))
    w = Window.orderBy(F.col("f_score").desc(), F.col("feature"))
    return scores.withColumn("selected", F.row_number().over(w) <= k)


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Shuffled stratified k folds: within each class, rows ordered by the
    seeded key get folds 0, 1, ..., k-1, 0, ... so class shares are kept and
    per-class fold sizes differ by at most one."""
    keyed = df.withColumn("_k", F.concat(seeded_key(id_col, seed), F.lit("|"),
                                         F.lpad(F.col(id_col).cast("string"), 20, "0")))
    r = group_ranks(keyed, label, "_k", out="_r")
    return r.withColumn(out, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_k", "_r")


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """Deterministic hold-out flag ``is_test`` (md5 threshold)."""
    thr = format(int(test_size * 16 ** 8), "08x")
    return df.withColumn("is_test", F.substring(seeded_key(id_col, seed), 1, 8) < F.lit(thr))


def placebo_noise(df: DataFrame, id_col: str, cols: Sequence[str], seed: int = 0) -> DataFrame:
    """Replace signal columns by seeded uniform noise."""
    out = df
    for i, c in enumerate(cols):
        out = out.withColumn(c, seeded_uniform(id_col, seed * 1000 + i))
    return out


def align_by_position(a: DataFrame, a_order: str, b: DataFrame, b_order: str) -> DataFrame:
    """Pair the n-th row of ``a`` with the n-th row of ``b`` (each in its
    order), keeping as many rows as the shorter side: distributed positions
    and an equi-join on position."""
    pa = group_ranks(a.withColumn("_g", F.lit(0)), "_g", a_order, out="position").drop("_g")
    pb = group_ranks(b.withColumn("_g", F.lit(0)), "_g", b_order, out="position").drop("_g")
    return pa.join(pb, "position", "inner")
