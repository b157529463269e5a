"""Queries of the statistics layer (K1-K9) over the score samples (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..sources import adapters as A
from .q_filings import r6
from .registry import register
from .views_sql import with_views

# Fixed pairs of samples compared by the report (positions as in the reference's six pairs).
PAIRS = (("click", "view"), ("signup", "purchase"), ("click", "signup"),
         ("view", "purchase"), ("error", "click"), ("purchase", "error"))
_PAIRS_SQL = "pairs(pair_id, sample_a, sample_b) AS (VALUES " + ", ".join(
    f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIRS)) + ")"


def _scores2(spark, sf_dir):
    from ..sources.tables import table
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("sample"), "value",
                    F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("k"))


@register("reject_outliers_sigma", with_views(["scores"], """
SELECT s.id, s.sample FROM scores s JOIN (SELECT sample, avg(value) AS mu, stddev_pop(value) AS sd FROM scores GROUP BY sample) g
  ON g.sample = s.sample WHERE abs(s.value - g.mu) < 3 * g.sd"""))
def q_reject_outliers_sigma(spark, sf_dir):
    return S.reject_outliers_sigma(A.scores(spark, sf_dir), "value", 3.0, by=["sample"]).select("id", "sample")


@register("reject_outliers_sigma_global", with_views(["scores"], """
SELECT id FROM scores WHERE abs(value - (SELECT avg(value) FROM scores)) < 2 * (SELECT stddev_pop(value) FROM scores)"""))
def q_reject_outliers_sigma_global(spark, sf_dir):
    return S.reject_outliers_sigma(A.scores(spark, sf_dir), "value", 2.0).select("id")


@register("filter_outliers_iqr", with_views(["scores"], """
SELECT s.id, s.sample FROM scores s
JOIN (SELECT sample, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM scores GROUP BY sample) g ON g.sample = s.sample
WHERE s.value >= g.q1 - 0.3 * (g.q3 - g.q1) AND s.value <= g.q3 + 0.3 * (g.q3 - g.q1)"""))
def q_filter_outliers_iqr(spark, sf_dir):
    return S.filter_outliers_iqr(A.scores(spark, sf_dir), "value", 0.3, by=["sample"]).select("id", "sample")


@register("flag_outliers_mad", """
WITH s AS (SELECT event_id AS id, event_type AS sample, value, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k FROM events),
m AS (SELECT sample, median(value) AS mv, median(k) AS mk FROM s GROUP BY sample),
d AS (SELECT s.id, s.sample, sqrt((s.value - m.mv) ^ 2 + (s.k - m.mk) ^ 2) AS d FROM s JOIN m USING (sample)),
g AS (SELECT sample, median(d) AS mad FROM d GROUP BY sample)
SELECT d.id, d.sample, 0.6745 * d.d / g.mad > 1.5 AS is_outlier FROM d JOIN g USING (sample)""")
def q_flag_outliers_mad(spark, sf_dir):
    out = S.flag_outliers_mad(_scores2(spark, sf_dir), ["value", "k"], thresh=1.5, by=["sample"])
    return out.select("id", "sample", "is_outlier")


_MOM = """mom AS (SELECT sample, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM scores GROUP BY sample)"""


@register("t_test_pooled", with_views(["scores"], f"""
WITH {_PAIRS_SQL}, {_MOM}
SELECT p.pair_id, p.sample_a, p.sample_b,
  round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t_pooled,
  CAST(a.n + b.n - 2 AS DOUBLE) AS df_pooled
FROM pairs p JOIN mom a ON a.sample = p.sample_a JOIN mom b ON b.sample = p.sample_b"""))
def q_t_test_pooled(spark, sf_dir):
    t = S.t_tests(A.scores(spark, sf_dir), "value", "sample", PAIRS)
    return t.select(F.col("pair_id").cast("int"), "sample_a", "sample_b", r6("t_pooled").alias("t_pooled"), "df_pooled")


@register("t_test_welch", with_views(["scores"], f"""
WITH {_PAIRS_SQL}, {_MOM}
SELECT p.pair_id, p.sample_a, p.sample_b,
  round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t_welch,
  round((a.v / a.n + b.v / b.n) ^ 2 / ((a.v / a.n) ^ 2 / (a.n - 1) + (b.v / b.n) ^ 2 / (b.n - 1)), 6) AS df_welch
FROM pairs p JOIN mom a ON a.sample = p.sample_a JOIN mom b ON b.sample = p.sample_b"""))
def q_t_test_welch(spark, sf_dir):
    t = S.t_tests(A.scores(spark, sf_dir), "value", "sample", PAIRS)
    return t.select(F.col("pair_id").cast("int"), "sample_a", "sample_b", r6("t_welch").alias("t_welch"), r6("df_welch").alias("df_welch"))


_LEVENE_SQL = f"""
WITH {_PAIRS_SQL},
med AS (SELECT sample, median(value) AS md FROM scores GROUP BY sample),
z AS (SELECT s.sample, abs(s.value - med.md) AS z FROM scores s JOIN med USING (sample)),
zg AS (SELECT sample, count(z) AS ng, avg(z) AS zbar_g FROM z GROUP BY sample),
ssw AS (SELECT z.sample, sum((z.z - zg.zbar_g) ^ 2) AS ssw_g FROM z JOIN zg USING (sample) GROUP BY z.sample),
mem AS (SELECT pair_id, sample_a AS sample FROM pairs UNION ALL SELECT pair_id, sample_b FROM pairs),
g AS (SELECT mem.pair_id, zg.ng, zg.zbar_g, ssw.ssw_g FROM mem JOIN zg USING (sample) JOIN ssw USING (sample)),
tot AS (SELECT pair_id, sum(ng) AS nn, sum(ng * zbar_g) / sum(ng) AS zbar FROM g GROUP BY pair_id),
agg AS (SELECT g.pair_id, max(tot.nn) AS nn, count(*) AS k, sum(g.ng * (g.zbar_g - tot.zbar) ^ 2) AS ssb, sum(g.ssw_g) AS ssw
        FROM g JOIN tot USING (pair_id) GROUP BY g.pair_id)
SELECT p.pair_id, p.sample_a, p.sample_b, round((agg.nn - agg.k) / (agg.k - 1) * agg.ssb / agg.ssw, 6) AS w,
       CAST(agg.k - 1 AS DOUBLE) AS df1, CAST(agg.nn - agg.k AS DOUBLE) AS df2
FROM pairs p JOIN agg USING (pair_id)"""


@register("levene", with_views(["scores"], _LEVENE_SQL))
def q_levene(spark, sf_dir):
    lv = S.levene(A.scores(spark, sf_dir), "value", "sample", PAIRS)
    return lv.select(F.col("pair_id").cast("int"), "sample_a", "sample_b", r6("w").alias("w"), "df1", "df2")


@register("paired_comparison_report", with_views(["scores"], _LEVENE_SQL.replace(
    "\nSELECT p.pair_id", ",\n" + _MOM + ",\nlv AS (SELECT p.pair_id", 1) + """)
SELECT lv.pair_id, lv.sample_a, lv.sample_b, lv.w,
  round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t_pooled,
  round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t_welch
FROM lv JOIN mom a ON a.sample = lv.sample_a JOIN mom b ON b.sample = lv.sample_b"""))
def q_paired_comparison_report(spark, sf_dir):
    s = A.scores(spark, sf_dir)
    t = S.t_tests(s, "value", "sample", PAIRS)
    lv = S.levene(s, "value", "sample", PAIRS).select("pair_id", "w")
    j = t.join(lv, "pair_id")
    return j.select(F.col("pair_id").cast("int"), "sample_a", "sample_b", r6("w").alias("w"),
                    r6("t_pooled").alias("t_pooled"), r6("t_welch").alias("t_welch"))


@register("one_sided_decision")
def q_one_sided_decision(spark, sf_dir):
    """K8 with p-values (rows-only: no t distribution in the oracle)."""
    return S.compare_samples(A.scores(spark, sf_dir), "value", "sample", PAIRS)


@register("normality_report")
def q_normality_report(spark, sf_dir):
    """K4 (rows-only): Shapiro-Wilk per sample after null/zero/IQR filtering."""
    return S.normality_report(A.scores(spark, sf_dir), "value", "sample")


# Normal quantiles at 0.975 and 0.95.  The t quantile is expanded around them in 1 / dof.
def _t_quantile(z: str, dof: str) -> str:
    return (f"({z} + ({z}^3 + {z}) / (4 * {dof}) + (5 * {z}^5 + 16 * {z}^3 + 3 * {z}) / (96 * {dof}^2)"
            f" + (3 * {z}^7 + 19 * {z}^5 + 17 * {z}^3 - 15 * {z}) / (384 * {dof}^3))")


@register("decision_statistics", with_views(["scores"], _LEVENE_SQL.replace(
    "\nSELECT p.pair_id", ",\n" + _MOM + ",\nlv AS (SELECT p.pair_id", 1) + f"""),
st AS (
  SELECT lv.*, sqrt(lv.w) > {_t_quantile("1.959963984540054", "lv.df2")} AS equal_var,
         (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS tp, CAST(a.n + b.n - 2 AS DOUBLE) AS dp,
         (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS tw,
         (a.v / a.n + b.v / b.n) ^ 2 / ((a.v / a.n) ^ 2 / (a.n - 1) + (b.v / b.n) ^ 2 / (b.n - 1)) AS dw
  FROM lv JOIN mom a ON a.sample = lv.sample_a JOIN mom b ON b.sample = lv.sample_b),
d AS (SELECT *, CASE WHEN equal_var THEN tp ELSE tw END AS t, CASE WHEN equal_var THEN dp ELSE dw END AS dof FROM st)
SELECT pair_id, sample_a, sample_b, w, equal_var, round(t, 6) AS t, round(dof, 6) AS dof,
       t < -{_t_quantile("1.6448536269514722", "dof")} AS reject FROM d"""))
def q_decision_statistics(spark, sf_dir):
    """K8: statistics and decision; the twin compares with critical values instead of p-values."""
    d = S.compare_samples(A.scores(spark, sf_dir), "value", "sample", PAIRS)
    return d.select(F.col("pair_id").cast("int"), "sample_a", "sample_b", r6("w").alias("w"), "equal_var",
                    r6("t").alias("t"), r6("dof").alias("dof"), "reject")


@register("normality_counts", with_views(["scores"], """
SELECT s.sample, CAST(count(*) AS BIGINT) AS n
FROM (SELECT * FROM scores WHERE value <> 0) s
JOIN (SELECT sample, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM scores WHERE value <> 0 GROUP BY sample) g ON g.sample = s.sample
WHERE s.value >= g.q1 - 1.5 * (g.q3 - g.q1) AND s.value <= g.q3 + 1.5 * (g.q3 - g.q1) GROUP BY s.sample"""))
def q_normality_counts(spark, sf_dir):
    """K4: rows of each sample that enter the normality test."""
    return S.normality_report(A.scores(spark, sf_dir), "value", "sample").select("sample", "n")
