"""Outlier filters and two-sample tests (K1-K9).

Statistics are aggregates (``avg``, ``var_samp``, exact ``percentile``) per
group, joined back to the rows by key - never a window that would hold a whole
group in one task.  p-values are computed on the aggregated rows (one per
test) by an Arrow-batched pandas UDF evaluating the regularised incomplete
beta function with NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ------------------------------------------------------------------ p-values
def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction 1 / (1 + d1 / (1 + d2 / (1 + ...))) of the incomplete beta function,
    d(2m) = m (b - m) x / ((a + 2m - 1)(a + 2m)) and d(2m+1) = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1)),
    evaluated from its innermost term; it converges in some sqrt(max(a, b)) terms."""
    value = 1.0
    for j in range(100 + 10 * math.isqrt(int(max(a, b)) + 1), 0, -1):
        m, odd = divmod(j, 2)
        top = -(a + m) * (a + b + m) if odd else m * (b - m)
        value = 1.0 + top * x / ((a + j - 1) * (a + j)) / value
    return 1.0 / value


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if not (a > 0 and b > 0) or x != x:
        return float("nan")
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or not np.isfinite(t) or not dof > 0:
        return float("nan")
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


def f_upper_p(f: float, d1: float, d2: float) -> float:
    if f is None or not np.isfinite(f) or not (d1 > 0 and d2 > 0):
        return float("nan")
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value, on aggregated rows."""
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail F p-value, on aggregated rows."""
    return pd.Series([f_upper_p(a, b, c) for a, b, c in zip(f, d1, d2)], dtype="float64")


# ------------------------------------------------------------------ outlier filters
def _group_stats(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _join_null_safe(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` in which null equals null."""
    right = stats.select(*[F.col(c).alias(f"_k_{c}") if c in by else F.col(c) for c in stats.columns])
    cond = None
    for c in by:
        same = df[c].eqNullSafe(right[f"_k_{c}"])
        cond = same if cond is None else cond & same
    return df.join(right, cond, how).drop(*[f"_k_{c}" for c in by])


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return _join_null_safe(df, stats, by)
    # a single aggregate row: attach as scalar subqueries, no join
    return df.select("*", *[stats.select(c).scalar().alias(c) for c in stats.columns])


def _with_group_quantiles(df: DataFrame, by: Sequence[str], col: str, probs, out: str) -> DataFrame:
    """Attach exact per-group quantiles (array column ``out``) by key; null is a group like any other."""
    if by:
        return _join_null_safe(df, group_quantiles(df, list(by), col, probs, out), by, "left")
    q = group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], col, probs, out)
    return df.withColumn(out, q.select(out).scalar())


def reject_outliers_sigma(df: DataFrame, col: str, m: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """K1: keep rows with ``|x - mean| < m * std`` (population std) per group."""
    st = _group_stats(df, by, F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    j = _attach(df, st, by)
    return j.filter(F.abs(F.col(col) - F.col("_mu")) < F.lit(m) * F.col("_sd")).drop("_mu", "_sd")


def filter_outliers_iqr(df: DataFrame, col: str, k: float = 1.5, by: Sequence[str] = (),
                        approx: bool = False) -> DataFrame:
    """K3: keep ``q25 - k*IQR <= x <= q75 + k*IQR`` (linear quantiles) per group."""
    if approx:
        st = _group_stats(df, by, F.percentile_approx(col, F.array(F.lit(.25), F.lit(.75)), 10000).alias("_q"))
        j = _attach(df, st, by)
    else:
        j = _with_group_quantiles(df, by, col, (.25, .75), "_q")
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    iqr = q3 - q1
    return j.filter((F.col(col) >= q1 - F.lit(k) * iqr) & (F.col(col) <= q3 + F.lit(k) * iqr)).drop("_q")


def flag_outliers_mad(df: DataFrame, cols: Sequence[str], thresh: float = 3.5, by: Sequence[str] = (),
                      out: str = "is_outlier") -> DataFrame:
    """K2: modified z-score ``0.6745 * d / median(d) > thresh`` where d is the
    Euclidean distance of the point to the per-column medians (null where the
    median distance is 0)."""
    j = df
    for c in cols:
        j = _with_group_quantiles(j, by, c, (.5,), f"_mq_{c}").withColumn(f"_m_{c}", F.col(f"_mq_{c}")[0]).drop(f"_mq_{c}")
    dist = F.sqrt(sum((F.col(c) - F.col(f"_m_{c}")) ** 2 for c in cols))
    j = j.withColumn("_d", dist).drop(*[f"_m_{c}" for c in cols])
    j = _with_group_quantiles(j, by, "_d", (.5,), "_madq").withColumn("_mad", F.col("_madq")[0]).drop("_madq")
    return j.withColumn(out, F.try_divide(F.lit(0.6745) * F.col("_d"), F.col("_mad")) > F.lit(thresh)).drop("_d", "_mad")


# ------------------------------------------------------------------ two-sample tests
def sample_moments(df: DataFrame, value: str, sample: str) -> DataFrame:
    return df.groupBy(sample).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  F.var_samp(value).alias("var"))


def _pairs(spark, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id INT, sample_a STRING, sample_b STRING")


def t_tests(df: DataFrame, value: str, sample: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """K6 + K7: pooled and Welch t statistics with their degrees of freedom,
    one row per pair (a, b); null where a variance or count leaves them undefined."""
    mom = sample_moments(df, value, sample)
    a = mom.select(F.col(sample).alias("sample_a"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = mom.select(F.col(sample).alias("sample_b"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    p = _pairs(df.sparkSession, pairs).join(a, "sample_a").join(b, "sample_b")
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    sp2 = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    se_w = F.try_divide(v1, n1) + F.try_divide(v2, n2)
    return p.select(
        "pair_id", "sample_a", "sample_b",
        F.try_divide(m1 - m2, F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))).alias("t_pooled"),
        (n1 + n2 - 2).cast("double").alias("df_pooled"),
        F.try_divide(m1 - m2, F.sqrt(se_w)).alias("t_welch"),
        F.try_divide(se_w * se_w, F.try_divide(F.try_divide(v1, n1) ** 2, n1 - 1)
                     + F.try_divide(F.try_divide(v2, n2) ** 2, n2 - 1)).alias("df_welch"))


def levene(df: DataFrame, value: str, sample: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """K5: Brown-Forsythe (median-centred Levene) W per pair of samples, with
    its F degrees of freedom (k - 1 = 1, N - k)."""
    spark = df.sparkSession
    pr = _pairs(spark, pairs)
    members = (pr.select("pair_id", F.col("sample_a").alias(sample))
                 .unionByName(pr.select("pair_id", F.col("sample_b").alias(sample))))
    med = group_quantiles(df, sample, value, (.5,), "_mq").select(sample, F.col("_mq")[0].alias("_med"))
    z = df.join(med, sample).select(sample, F.abs(F.col(value) - F.col("_med")).alias("z"))
    zg = z.groupBy(sample).agg(F.count("z").alias("ng"), F.avg("z").alias("zbar_g"), (F.count("z") * F.var_pop("z")).alias("ssw_g"))
    g = members.join(zg, sample)
    tot = g.groupBy("pair_id").agg(F.sum("ng").alias("N"), (F.sum(F.col("ng") * F.col("zbar_g")) / F.sum("ng")).alias("zbar"))
    g = g.join(tot, "pair_id")
    agg = g.groupBy("pair_id").agg(
        F.first("N").alias("N"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("ng") * (F.col("zbar_g") - F.col("zbar")) ** 2).alias("ssb"),
        F.sum("ssw_g").alias("ssw"))
    w = F.try_divide(F.try_divide(F.col("N") - F.col("k"), F.col("k") - 1) * F.col("ssb"), F.col("ssw"))
    return pr.join(agg, "pair_id").select("pair_id", "sample_a", "sample_b", w.alias("w"),
                                          (F.col("k") - 1).cast("double").alias("df1"),
                                          (F.col("N") - F.col("k")).cast("double").alias("df2"))


def compare_samples(df: DataFrame, value: str, sample: str, pairs: Sequence[tuple[str, str]],
                    alpha: float = 0.05, rule: str = "reference") -> DataFrame:
    """K8 / K9: per pair, Levene then the pooled or Welch t-test, and the
    one-sided decision "a is smaller than b": reject when t < 0 and p/2 < alpha.

    ``rule='reference'`` uses the pooled test when Levene's p < alpha (as the
    reference does); ``'standard'`` when p >= alpha (equal variances kept).
    """
    t = t_tests(df, value, sample, pairs)
    lv = levene(df, value, sample, pairs).select("pair_id", "w", "df1", "df2")
    j = t.join(lv, "pair_id").withColumn("levene_p", f_pvalue(F.col("w"), F.col("df1"), F.col("df2")))
    equal = (F.col("levene_p") < alpha) if rule == "reference" else (F.col("levene_p") >= alpha)
    j = (j.withColumn("equal_var", equal)
          .withColumn("t", F.when(F.col("equal_var"), F.col("t_pooled")).otherwise(F.col("t_welch")))
          .withColumn("dof", F.when(F.col("equal_var"), F.col("df_pooled")).otherwise(F.col("df_welch")))
          .withColumn("p", t_pvalue(F.col("t"), F.col("dof"))))
    return j.select("pair_id", "sample_a", "sample_b", "w", "levene_p", "equal_var", "t", "dof", "p",
                    ((F.col("t") < 0) & (F.col("p") / 2 < alpha)).alias("reject"))


# ------------------------------------------------------------------ ranks and normality
def group_ranks(df: DataFrame, group: str, value: str, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank of ``value`` within ``group`` (ties in arbitrary order)
    without holding a group in one task: range-partition on (group, value),
    number rows inside each partition, and add the counts of the earlier
    partitions of the same group (one row per (partition, group) that occurs:
    about #groups + #partitions rows).  A hot group is split over many
    partitions by value, and ties by a row number, so no task holds a whole
    group or a whole run of ties.  Null groups are groups like any other."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.withColumn("_tie", F.monotonically_increasing_id())
           .repartitionByRange(n, F.col(group), F.col(value), F.col("_tie")).sortWithinPartitions(group, value, "_tie").drop("_tie")
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # the range bounds come from a sample, so two evaluations of ``s`` could
    # place rows differently: write it once, then count blocks and number rows
    # from the same table (also survives executor loss)
    from ..session import materialize
    s = materialize(s, "ranked_input")
    blocks = s.groupBy("_pid", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # blocks has about #groups + #partitions rows; AQE broadcasts it when small
    j = _join_null_safe(s, blocks.select("_pid", group, "_first", "_off"), ["_pid", group])
    return j.withColumn(out, (F.col("_row") - F.col("_first") + F.col("_off") + 1).cast("long")).drop("_pid", "_row", "_first", "_off")


def _norm_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse standard normal CDF (Acklam's rational approximation, |rel err| < 1.2e-9)."""
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
    p = np.asarray(p, dtype="float64")
    out = np.empty_like(p)
    lo, hi = p < 0.02425, p > 1 - 0.02425
    mid = ~(lo | hi)
    q = np.sqrt(-2 * np.log(p[lo]))
    out[lo] = (((((c[0]*q+c[1])*q+c[2])*q+c[3])*q+c[4])*q+c[5]) / ((((d[0]*q+d[1])*q+d[2])*q+d[3])*q+1)
    q = p[mid] - 0.5
    r = q * q
    out[mid] = (((((a[0]*r+a[1])*r+a[2])*r+a[3])*r+a[4])*r+a[5])*q / (((((b[0]*r+b[1])*r+b[2])*r+b[3])*r+b[4])*r+1)
    q = np.sqrt(-2 * np.log(1 - p[hi]))
    out[hi] = -(((((c[0]*q+c[1])*q+c[2])*q+c[3])*q+c[4])*q+c[5]) / ((((d[0]*q+d[1])*q+d[2])*q+d[3])*q+1)
    return out


@F.pandas_udf(T.DoubleType())
def blom_score(i: pd.Series, n: pd.Series) -> pd.Series:
    """m_i = Phi^-1((i - 3/8) / (n + 1/4))."""
    return pd.Series(_norm_ppf((i.to_numpy("float64") - 0.375) / (n.to_numpy("float64") + 0.25)))


def _sw_pvalue(w: float, n: float) -> float:
    if w is None or n is None or not np.isfinite(w) or n < 3:
        return float("nan")
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    w = min(w, 1 - 1e-15)
    if n <= 11:
        g = 0.459 * n - 2.273
        mu = 0.544 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)
        arg = g - math.log(1 - w)
        if arg <= 0:
            return 0.0
        z = (-math.log(arg) - mu) / sigma
    else:
        ln = math.log(n)
        mu = 0.0038915 * ln ** 3 - 0.083751 * ln ** 2 - 0.31082 * ln - 1.5861
        sigma = math.exp(0.0030302 * ln ** 2 - 0.082676 * ln - 0.4803)
        z = (math.log(1 - w) - mu) / sigma
    return 0.5 * math.erfc(z / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def sw_pvalue(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_sw_pvalue(a, b) for a, b in zip(w, n)], dtype="float64")


def shapiro_wilk(df: DataFrame, value: str, sample: str) -> DataFrame:
    """W statistic and p-value per sample (Royston's approximation, n >= 3)."""
    r = group_ranks(df.select(sample, value), sample, value, out="i")
    n = r.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"))
    r = _join_null_safe(r, n, [sample]).withColumn("m", blom_score(F.col("i"), F.col("n")))
    u = F.lit(1.0) / F.sqrt(F.col("n"))
    g = (r.groupBy(sample).agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.max("m").alias("mn"),
                               F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("mn1"), F.first("n").alias("n")))
    cn, cn1 = F.col("mn") / F.sqrt("mm"), F.col("mn1") / F.sqrt("mm")
    an = cn + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5
    an1 = cn1 + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5
    big = F.col("n") > 5
    g = g.select(sample, F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(an).alias("an"),
                 F.when(big, an1).alias("an1"),
                 F.when(big, (F.col("mm") - 2 * F.col("mn") ** 2 - 2 * F.col("mn1") ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2))
                  .otherwise((F.col("mm") - 2 * F.col("mn") ** 2) / (1 - 2 * an ** 2)).alias("phi"))
    r = _join_null_safe(r, g.drop("n"), [sample])
    i, nn = F.col("i"), F.col("n")
    a = (F.when(i == nn, F.col("an")).when(i == 1, -F.col("an"))
          .when(F.col("an1").isNotNull() & (i == nn - 1), F.col("an1"))
          .when(F.col("an1").isNotNull() & (i == 2), -F.col("an1"))
          .otherwise(F.when(nn == 3, F.lit(0.0)).otherwise(F.col("m") / F.sqrt("phi"))))
    agg = r.groupBy(sample).agg(F.first("n").alias("n"), F.sum(a * F.col(value)).alias("_num"),
                                F.sum((F.col(value) - F.col("_mean")) ** 2).alias("_ss"))
    out = agg.select(sample, "n", (F.col("_num") ** 2 / F.col("_ss")).alias("w"))
    return out.withColumn("p", sw_pvalue(F.col("w"), F.col("n").cast("double")))


def normality_report(df: DataFrame, value: str, sample: str, alpha: float = 0.05, k: float = 1.5) -> DataFrame:
    """K4: per sample, drop null and 0, drop IQR outliers (k = 1.5), then
    Shapiro-Wilk; ``normal`` = p >= alpha."""
    x = df.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    x = filter_outliers_iqr(x, value, k, by=[sample])
    sw = shapiro_wilk(x, value, sample)
    return sw.withColumn("normal", F.col("p") >= alpha)


#: Accuracy of the brackets, and values inside a bracket that a group may gather.
ACCURACY, INSIDE = 10_000, 1_000_000


def group_quantiles(df: DataFrame, group: Sequence[str] | str, value: str, probs: Sequence[float],
                    out: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles per group (the same definition as ``percentile``) by bracketed selection.

    One scan gives each group's size and, by a sketch of bounded rank error, two values between which every wanted
    order statistic lies.  A second scan counts the values below a bracket and at its ends and gathers only those
    strictly inside: a thousandth of a large group at most (a value that many rows share is an end of the bracket), and by
    a finer sketch never more than ``INSIDE``.  No row is sorted as a whole or written.  Null is a group like
    any other; null values do not count.  Returns ``(group..., <out>: array<double>)`` in the order of ``probs``."""
    groups = [group] if isinstance(group, str) else list(group)
    x = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())

    def sketch(accuracy: int) -> DataFrame:
        near = [min(1.0, max(0.0, p + side * 4.0 / accuracy)) for p in probs for side in (-1, 1)]
        return x.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
                                      F.percentile_approx("_v", F.array(*(F.lit(p) for p in near)), accuracy).alias("_b"))

    from ..session import materialize
    brackets, accuracy = materialize(sketch(ACCURACY), "brackets"), ACCURACY  # one row a group
    largest = brackets.agg(F.max("_n")).first()[0] or 0
    if 10 * largest / accuracy > INSIDE and largest > accuracy:
        accuracy = -(-10 * largest // INSIDE)
        brackets = materialize(sketch(accuracy), "brackets")
    ends = []
    # at the edge of a group the extreme value is the end; the bracket of a group of no more rows than the accuracy is the
    # whole group, in a larger one a sketch of error n / accuracy leaves three ranks on either side
    small = F.col("_n") <= accuracy
    for i, p in enumerate(probs):
        low = F.col("_least") if p - 4.0 / accuracy <= 0 else F.when(small, F.col("_least")).otherwise(F.col("_b")[2 * i])
        high = F.col("_most") if p + 4.0 / accuracy >= 1 else F.when(small, F.col("_most")).otherwise(F.col("_b")[2 * i + 1])
        ends += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    brackets = brackets.select(*groups, "_n", *ends)
    v = F.col("_v")
    parts = []
    for i in range(len(probs)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        parts += [F.count(F.when(v < lo, 1)).alias(f"_below{i}"), F.count(F.when(v == lo, 1)).alias(f"_at{i}"), F.count(F.when((v == hi) & (hi > lo), 1)).alias(f"_top{i}"),
                  F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias(f"_in{i}"), F.first(lo).alias(f"_l{i}"), F.first(hi).alias(f"_h{i}")]
    found = _join_null_safe(x, brackets, groups).groupBy(*groups).agg(F.first("_n").alias("_n"), *parts)

    def order_statistic(i: int, rank):
        below, at, top, inside = F.col(f"_below{i}"), F.col(f"_at{i}"), F.col(f"_top{i}"), F.col(f"_in{i}")
        place = rank - below - at
        return (F.when(rank <= below, F.raise_error(F.lit("a bracket misses its order statistic")).cast("double"))
                .when(place <= 0, F.col(f"_l{i}")).when(place <= F.size(inside), F.get(inside, (place - 1).cast("int")))
                .when(place <= F.size(inside) + top, F.col(f"_h{i}")).otherwise(F.raise_error(F.lit("a bracket misses its order statistic")).cast("double")))

    quantiles = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        share = pos - F.floor(pos)
        first = order_statistic(i, (F.floor(pos) + 1).cast("long"))
        quantiles.append(F.when(share == 0, first).otherwise((F.lit(1.0) - share) * first + share * order_statistic(i, (F.ceil(pos) + 1).cast("long"))))
    return found.select(*groups, F.array(*quantiles).alias(out))
