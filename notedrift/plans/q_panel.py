"""Queries over the company x quarter panel: null handling (C6-C11, C15),
periods (D5), joins (E2-E4, E9, E10), buckets and windows (G), reshaping (H4-H7),
aggregate checks (F4-F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import buckets as B
from ..operators import clean, match, reshape
from ..sources import adapters as A
from ..sources.tables import table
from .q_filings import r6, valid_notes
from .registry import register
from .views_sql import with_views


def _bucket_sql(src: str, value_expr: str, cuts: str, over: str, keys: str, out: str = "bucket") -> str:
    return f"""
WITH b AS (SELECT {keys}, nullif({value_expr}, 0) AS x FROM {src}),
e AS (SELECT {keys}, x, list_sort(list_distinct(quantile_cont(x, {cuts}) OVER ({over}))) AS edges FROM b)
SELECT {keys}, CAST(CASE WHEN x IS NULL OR len(edges) < 2 THEN NULL
                    ELSE len(list_filter(edges[2:len(edges) - 1], lambda v: x > v)) END AS BIGINT) AS {out}
FROM e"""


# ---------------------------------------------------------------- null handling (C)
@register("zero_to_null", with_views(["panel"], "SELECT symbol, period, nullif(qty, 0) AS qty, revenue FROM panel"))
def q_zero_to_null(spark, sf_dir):
    p = A.panel(spark, sf_dir).select("symbol", "period", "qty", "revenue")
    return clean.zero_to_null(p, ["qty", "revenue"])


@register("drop_incomplete", with_views(["panel"], """
SELECT symbol, period, qty, revenue FROM (SELECT symbol, period, nullif(qty, 0) AS qty, revenue FROM panel)
WHERE qty IS NOT NULL AND revenue IS NOT NULL"""))
def q_drop_incomplete(spark, sf_dir):
    p = clean.zero_to_null(A.panel(spark, sf_dir).select("symbol", "period", "qty", "revenue"), ["qty"])
    return clean.drop_incomplete(p)


@register("drop_incomplete_thresh", with_views(["panel_basis"], """
SELECT symbol, period FROM panel_basis
WHERE (CAST("M-qty" IS NOT NULL AS INT) + CAST("3-qty" IS NOT NULL AS INT) + CAST("6-qty" IS NOT NULL AS INT)
     + CAST("M-revenue" IS NOT NULL AS INT) + CAST("3-revenue" IS NOT NULL AS INT)
     + CAST("6-revenue" IS NOT NULL AS INT)) >= 5"""))
def q_drop_incomplete_thresh(spark, sf_dir):
    b = A.panel_basis(spark, sf_dir).drop("year", "quarter")
    return clean.drop_incomplete(b, thresh=7).select("symbol", "period")


_C8_X = "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'n/a' ELSE regexp_extract(props, '[0-9]+', 0) END"


@register("nonblank_cast", f"""
SELECT id, TRY_CAST(x AS DOUBLE) AS x FROM (SELECT event_id AS id, {_C8_X} AS x FROM events) WHERE x <> ''""")
def q_nonblank_cast(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    x = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("n/a")).otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return clean.nonblank_cast(e.select(k.alias("id"), x.alias("x")), "x")


@register("filter_year", with_views(["panel"], "SELECT symbol, period FROM panel WHERE year <> 1995"))
def q_filter_year(spark, sf_dir):
    return clean.filter_year(A.panel(spark, sf_dir), "year", 1995).select("symbol", "period")


@register("select_columns_like", with_views(["panel_basis"], 'SELECT "M-qty", "M-revenue" FROM panel_basis'))
def q_select_columns_like(spark, sf_dir):
    return clean.select_columns_like(A.panel_basis(spark, sf_dir), r"^M")


@register("arrange_columns", with_views(["panel"], "SELECT symbol, year, quarter, period, qty, n_lines, revenue FROM panel"))
def q_arrange_columns(spark, sf_dir):
    return clean.arrange_columns(A.panel(spark, sf_dir), first=["symbol"], last=["revenue"], drop=["avg_price"])


@register("fill_from_alternate_basis", with_views(["panel_basis"], """
SELECT symbol, period,
  coalesce(TRY_CAST("M-qty" AS DOUBLE), TRY_CAST("6-qty" AS DOUBLE), TRY_CAST("3-qty" AS DOUBLE)) AS "M-qty",
  coalesce(TRY_CAST("M-revenue" AS DOUBLE), TRY_CAST("6-revenue" AS DOUBLE), TRY_CAST("3-revenue" AS DOUBLE)) AS "M-revenue"
FROM panel_basis"""))
def q_fill_from_alternate_basis(spark, sf_dir):
    out = clean.fill_from_alternate_basis(A.panel_basis(spark, sf_dir))
    return out.select("symbol", "period", "M-qty", "M-revenue")


@register("hconcat_tables", with_views(["panel"], """
SELECT a.symbol, a.year, a.quarter, a.revenue, a.n_lines, b.qty
FROM panel a LEFT JOIN (SELECT symbol, year, quarter, qty, n_lines + 1 AS n_lines FROM panel WHERE year >= 1996) b
  ON a.symbol = b.symbol AND a.year = b.year AND a.quarter = b.quarter"""))
def q_hconcat_tables(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    t1 = p.select("symbol", "year", "quarter", "revenue", "n_lines")
    t2 = p.filter(F.col("year") >= 1996).select("symbol", "year", "quarter", "qty", (F.col("n_lines") + 1).alias("n_lines"))
    return clean.hconcat_tables([t1, t2], ["symbol", "year", "quarter"])


# ---------------------------------------------------------------- periods
@register("next_period", with_views(["panel"], """
SELECT symbol, year, quarter, CAST((year * 4 + quarter) // 4 AS BIGINT) AS next_year,
       CAST((year * 4 + quarter) % 4 + 1 AS BIGINT) AS next_quarter FROM panel"""))
def q_next_period(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    ny, nq = P.next_period(F.col("year"), F.col("quarter"))
    return p.select("symbol", "year", "quarter", ny.cast("long").alias("next_year"), nq.cast("long").alias("next_quarter"))


@register("previous_period", with_views(["panel"], """
SELECT symbol, year, quarter, CAST((year * 4 + quarter - 2) // 4 AS BIGINT) AS prev_year,
       CAST((year * 4 + quarter - 2) % 4 + 1 AS BIGINT) AS prev_quarter FROM panel"""))
def q_previous_period(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    py, pq = P.previous_period(F.col("year"), F.col("quarter"))
    return p.select("symbol", "year", "quarter", py.cast("long").alias("prev_year"), pq.cast("long").alias("prev_quarter"))


# ---------------------------------------------------------------- joins (E)
@register("left_join_suffix", with_views(["panel"], """
SELECT a.symbol, a.year, a.quarter, a.revenue AS revenue_x, a.qty, b.revenue AS revenue_y, b.n_lines
FROM panel a LEFT JOIN (SELECT * FROM panel WHERE year >= 1997) b
  ON a.symbol = b.symbol AND a.year = b.year AND a.quarter = b.quarter"""))
def q_left_join_suffix(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    a = p.select("symbol", "year", "quarter", "revenue", "qty")
    b = p.filter(F.col("year") >= 1997).select("symbol", "year", "quarter", "revenue", "n_lines")
    return match.left_join_suffix(a, b, ["symbol", "year", "quarter"])


@register("match_filings_to_panel", with_views(["valid_notes", "panel"], """
SELECT v.rcp_no, 'A' || v.crp_cd AS symbol, v.period, p.revenue, p.symbol IS NOT NULL AS is_matched
FROM valid_notes v LEFT JOIN panel p ON p.symbol = 'A' || v.crp_cd AND p.period = v.period"""))
def q_match_filings_to_panel(spark, sf_dir):
    v = valid_notes(spark, sf_dir).select("rcp_no", P.symbol_key("crp_cd").alias("symbol"), "period")
    p = A.panel(spark, sf_dir).select("symbol", "period", "revenue")
    return match.match_filings_to_panel(v, p)


@register("attach_next_period_target", with_views(["panel"], """
WITH cur AS (SELECT symbol, period, nullif(qty, 0) AS qty, nullif(revenue, 0) AS revenue FROM panel)
SELECT c.symbol, c.period, c.qty, c.revenue, round(n.avg_price, 6) AS avg_price_next
FROM cur c JOIN panel n ON n.symbol = c.symbol AND n.period = c.period + 1
WHERE c.qty IS NOT NULL AND c.revenue IS NOT NULL AND n.avg_price IS NOT NULL"""))
def q_attach_next_period_target(spark, sf_dir):
    p = A.panel(spark, sf_dir).select("symbol", "period", "qty", "revenue", "avg_price")
    out = match.attach_next_period_target(p, ["avg_price"], features=["qty", "revenue"])
    return out.select("symbol", "period", "qty", "revenue", r6("avg_price_next").alias("avg_price_next"))


_LABELS_SQL = with_views(["panel"], _bucket_sql("panel", "avg_price", "[0.0, 0.25, 0.75, 1.0]",
                                                "PARTITION BY symbol", "symbol, period", "label_entity"))


@register("attach_next_period_targets", with_views(["panel"], f"""
WITH le AS ({_bucket_sql('panel', 'avg_price', '[0.0, 0.25, 0.75, 1.0]', 'PARTITION BY symbol', 'symbol, period', 'label_entity')}),
     lq AS ({_bucket_sql('panel', 'avg_price', '[0.0, 0.33, 0.66, 1.0]', 'PARTITION BY period', 'symbol, period', 'label_cross')}),
     lab AS (SELECT le.symbol, le.period, le.label_entity, lq.label_cross FROM le JOIN lq USING (symbol, period)),
     cur AS (SELECT symbol, period, nullif(qty, 0) AS qty FROM panel)
SELECT c.symbol, c.period, c.qty, n.label_entity AS label_entity_next, n.label_cross AS label_cross_next
FROM cur c JOIN lab n ON n.symbol = c.symbol AND n.period = c.period + 1
WHERE c.qty IS NOT NULL AND n.label_entity IS NOT NULL AND n.label_cross IS NOT NULL"""))
def q_attach_next_period_targets(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    lab = B.bucket_by_entity(p, "avg_price", out="label_entity")
    lab = B.bucket_cross_section(lab, "avg_price", out="label_cross")
    out = match.attach_next_period_target(lab.select("symbol", "period", "qty", "label_entity", "label_cross"),
                                          ["label_entity", "label_cross"], features=["qty"], cast="long")
    return out.select("symbol", "period", "qty", "label_entity_next", "label_cross_next")


def _panel_and_targets(spark, sf_dir):
    """Two tables: the features of the panel, and prices of the quarters with more than one line."""
    p = A.panel(spark, sf_dir)
    return p.select("symbol", "period", "qty"), p.filter("n_lines > 1").select("symbol", "period", "avg_price")


@register("attach_current_target", with_views(["panel"], """
SELECT p.symbol, p.period, p.qty, round(t.avg_price, 6) AS target_t
FROM panel p LEFT JOIN (SELECT * FROM panel WHERE n_lines > 1) t ON t.symbol = p.symbol AND t.period = p.period"""))
def q_attach_current_target(spark, sf_dir):
    p, t = _panel_and_targets(spark, sf_dir)
    out = match.attach_current_target(p, "avg_price", "target_t", target_frame=t)
    return out.select("symbol", "period", "qty", r6("target_t").alias("target_t"))


@register("attach_previous_target", with_views(["panel"], """
SELECT a.symbol, a.period, round(b.avg_price, 6) AS avg_price_prev
FROM panel a LEFT JOIN (SELECT * FROM panel WHERE n_lines > 1) b ON b.symbol = a.symbol AND b.period = a.period - 1"""))
def q_attach_previous_target(spark, sf_dir):
    p, t = _panel_and_targets(spark, sf_dir)
    out = match.attach_previous_target(p, "avg_price", target_frame=t)
    return out.select("symbol", "period", r6("avg_price_prev").alias("avg_price_prev"))


@register("attach_next_target_of_table", with_views(["panel"], """
SELECT c.symbol, c.period, c.qty, round(n.avg_price, 6) AS avg_price_next
FROM panel c JOIN panel n ON n.symbol = c.symbol AND n.period = c.period + 1
WHERE c.qty <> 0 AND n.n_lines > 1 AND n.avg_price IS NOT NULL"""))
def q_attach_next_target_of_table(spark, sf_dir):
    """E4 with features and targets in two tables."""
    p, t = _panel_and_targets(spark, sf_dir)
    out = match.attach_next_period_target(p, ["avg_price"], features=["qty"], target_frame=t)
    return out.select("symbol", "period", "qty", r6("avg_price_next").alias("avg_price_next"))


# ---------------------------------------------------------------- buckets and windows (G)
@register("bucket_by_entity", with_views(["panel"], _bucket_sql(
    "panel", "revenue", "[0.0, 0.25, 0.75, 1.0]", "PARTITION BY symbol", "symbol, period")))
def q_bucket_by_entity(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    return B.bucket_by_entity(p, "revenue").select("symbol", "period", F.col("bucket").cast("long").alias("bucket"))


@register("bucket_rolling", with_views(["panel"], _bucket_sql(
    "panel", "qty", "[0.0, 0.33, 0.66, 1.0]",
    "PARTITION BY symbol ORDER BY period ROWS BETWEEN 40 PRECEDING AND CURRENT ROW", "symbol, period")))
def q_bucket_rolling(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    return B.bucket_rolling(p, "qty").select("symbol", "period", F.col("bucket").cast("long").alias("bucket"))


@register("bucket_cross_section", with_views(["panel"], _bucket_sql(
    "panel", "avg_price", "[0.0, 0.33, 0.66, 1.0]", "PARTITION BY period", "symbol, period")))
def q_bucket_cross_section(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    return B.bucket_cross_section(p, "avg_price").select("symbol", "period", F.col("bucket").cast("long").alias("bucket"))


@register("pct_change", with_views(["panel"], """
WITH f AS (
  SELECT symbol, period, last_value(nullif(qty, 0) IGNORE NULLS) OVER (
           PARTITION BY symbol ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM panel
),
g AS (SELECT symbol, period, x, lag(x) OVER (PARTITION BY symbol ORDER BY period) AS prev FROM f)
SELECT symbol, period, round(CASE WHEN prev = 0 THEN NULL ELSE (x / prev - 1) * 100 END, 6) AS pct_change FROM g"""))
def q_pct_change(spark, sf_dir):
    p = clean.zero_to_null(A.panel(spark, sf_dir).select("symbol", "period", "qty"), ["qty"])
    return B.pct_change(p, "qty").select("symbol", "period", r6("pct_change").alias("pct_change"))


@register("adjacent_compare", with_views(["filings"], """
SELECT rcp_no, lag(rcp_no) OVER (PARTITION BY crp_cd, rpt_nm ORDER BY rcp_dt, rcp_no) AS prev_rcp_no FROM filings"""))
def q_adjacent_compare(spark, sf_dir):
    f = A.filings(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_dt", "rcp_no")
    return B.adjacent_compare(f, ["crp_cd", "rpt_nm"], ["rcp_dt", "rcp_no"], "rcp_no").select("rcp_no", "prev_rcp_no")


@register("first_match", with_views(["filings"], """
SELECT crp_cd, rcp_no, rpt_nm FROM (
  SELECT crp_cd, rcp_no, rpt_nm, row_number() OVER (PARTITION BY crp_cd ORDER BY rcp_dt, rcp_no) AS rn FROM filings
) WHERE rn = 1"""))
def q_first_match(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    return B.first_match(f, ["crp_cd"], ["rcp_dt", "rcp_no"], ["rcp_no", "rpt_nm"])


# ---------------------------------------------------------------- reshaping (H) and checks
@register("unpivot_calendar", with_views(["panel_wide"], """
SELECT symbol, CAST(date_col AS DATE) AS date, value, CAST(month(CAST(date_col AS DATE)) AS BIGINT) AS month,
       CAST(year(CAST(date_col AS DATE)) AS BIGINT) AS year,
       CAST(CASE WHEN month(CAST(date_col AS DATE)) % 3 = 0 THEN month(CAST(date_col AS DATE)) // 3 END AS BIGINT) AS quarter
FROM panel_wide UNPIVOT INCLUDE NULLS (value FOR date_col IN (COLUMNS(* EXCLUDE (symbol))))"""))
def q_unpivot_calendar(spark, sf_dir):
    long = reshape.unpivot_calendar(A.panel_wide(spark, sf_dir), ["symbol"])
    return long.select("symbol", "date", "value", *[F.col(c).cast("long").alias(c) for c in ("month", "year", "quarter")])


@register("row_ratio_check", with_views(["panel_wide"], f"""
SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) * {len(A.quarter_end_columns())} AS BIGINT) AS rows_out,
       CAST({len(A.quarter_end_columns())} AS BIGINT) AS n_periods, true AS ok FROM panel_wide"""))
def q_row_ratio_check(spark, sf_dir):
    wide = A.panel_wide(spark, sf_dir)
    long = reshape.unpivot_calendar(wide, ["symbol"])
    return reshape.row_ratio_check(wide, long, len(wide.columns) - 1)


_SEGMENT_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(coalesce(c_mktsegment = '{s}', false) AS INTEGER) AS c_mktsegment_{s}" for s in _SEGMENT_LEVELS) + " FROM customer")
def q_one_hot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return reshape.one_hot(c, "c_mktsegment")


_SECTOR2 = sorted({s[2] for s in A.SECTOR_RANGES})


@register("one_hot_sector", with_views(["company_industry", "sector_ranges"], """
WITH m AS (
  SELECT crp_cd, sector2 FROM (
    SELECT i.crp_cd, s.sector2, row_number() OVER (PARTITION BY i.crp_cd ORDER BY s.pos DESC) AS rn
    FROM company_industry i LEFT JOIN sector_ranges s ON starts_with(i.ind_cd, s.range)
  ) WHERE rn = 1
)
SELECT crp_cd, """ + ", ".join(
    f"CAST(coalesce(sector2 = '{s}', false) AS INTEGER) AS \"ind_{s}\"" for s in _SECTOR2) + " FROM m"))
def q_one_hot_sector(spark, sf_dir):
    m = match.prefix_range_join(A.company_industry(spark, sf_dir), A.sector_ranges(spark), key=["crp_cd"])
    return reshape.one_hot(m.select("crp_cd", "sector2"), "sector2", prefix="ind", levels=_SECTOR2)


@register("one_hot_long", "SELECT doc_id, source AS level FROM documents WHERE source IS NOT NULL")
def q_one_hot_long(spark, sf_dir):
    """H5 without a column for each level: any number of levels."""
    return reshape.one_hot_long(table(spark, sf_dir, "documents"), ["doc_id"], "source")


@register("encode_labels", "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS lang_code FROM documents")
def q_encode_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return reshape.encode_labels(d, "lang").select("doc_id", "lang", "lang_code")


@register("class_frequency", "SELECT quality, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY quality")
def q_class_frequency(spark, sf_dir):
    return reshape.class_frequency(table(spark, sf_dir, "labels"), "quality")


@register("compare_means", with_views(["scores"], """
SELECT 'click' AS sample_a, 'view' AS sample_b, round(avg(value) FILTER (WHERE sample = 'click'), 6) AS mean_a,
       round(avg(value) FILTER (WHERE sample = 'view'), 6) AS mean_b,
       CASE WHEN avg(value) FILTER (WHERE sample = 'click') > avg(value) FILTER (WHERE sample = 'view') THEN 'click'
            WHEN avg(value) FILTER (WHERE sample = 'click') < avg(value) FILTER (WHERE sample = 'view') THEN 'view'
            ELSE 'equal' END AS larger
FROM scores WHERE sample IN ('click', 'view')"""))
def q_compare_means(spark, sf_dir):
    m = reshape.compare_means(A.scores(spark, sf_dir), "value", "sample", "click", "view")
    return m.select("sample_a", "sample_b", r6("mean_a").alias("mean_a"), r6("mean_b").alias("mean_b"), "larger")
