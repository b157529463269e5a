"""Adapter views: the driver's synthetic tables reshaped into the inputs the
operators expect (filings, company industry codes, company x quarter panel,
score samples, predictions, ...).

Every view is a deterministic function of the driver tables, so its size grows
with them.  The same construction is written independently in DuckDB SQL in
``notedrift.plans.views_sql``; the two must agree row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from .tables import table

# Fixed values for the adapters (segments listed on the main market; sector ranges).
MAIN_MARKET_SEGMENTS = ("BUILDING", "MACHINERY")
SECTOR_RANGES = (
    # pos, sector, sector2, range (code prefix); '5' overlaps '50'..'53' on purpose
    (0, "Manufacturing", "Food", "50"),
    (1, "Manufacturing", "Textile", "51"),
    (2, "Manufacturing", "Chemical", "52"),
    (3, "Manufacturing", "Metal", "53"),
    (4, "Manufacturing", "Other manufacturing", "5"),
    (5, "Construction", "Construction", "60"),
    (6, "Trade", "Wholesale", "61"),
    (7, "Trade", "Retail", "62"),
    (8, "Finance", "Banking", "64"),
    (9, "Services", "Software", "70"),
    (10, "Services", "Consulting", "71"),
    (11, "Services", "Other services", "7"),
)


def _doc_count(documents: DataFrame):
    # scalar subquery: evaluated once by Spark, no cross join
    return documents.select(F.count(F.lit(1))).scalar()


def filings(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Filing table (12 string columns, as scraped) built from orders.

    company = customer; closing quarter = quarter of the order date; a status 'P'
    order is a correction; filing date = closing day + 30*(key % 5) days; note =
    document (key mod #documents); every 17th note missing ('NA'); every third
    filing also has a consolidated note; every 29th key is filed as a half-year
    report whatever its month (non-standard period).

    ``rows``: ``(rcp_no, ...)``, joined to the filings by receipt number, as
    ``filings.join(rows, "rcp_no")`` would, but before the texts are attached.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = _doc_count(table(spark, sf_dir, "documents"))
    k = F.col("o_orderkey")
    y = F.year("o_orderdate")
    cm = ((F.month("o_orderdate") + 2) / 3).cast("int") * 3
    rtype = (F.when(k % 29 == 0, F.lit(P.HALF_YEAR)).when(cm == 6, F.lit(P.HALF_YEAR))
             .when(cm == 12, F.lit(P.ANNUAL)).otherwise(F.lit(P.QUARTERLY)))
    closing = F.last_day(F.make_date(y, cm, F.lit(1)))
    base = (o.join(c, o.o_custkey == c.c_custkey, "inner")
            .withColumn("doc_key", k % n)
            .withColumn("cdoc_key", F.when(k % 3 == 0, (k * 7 + 3) % n))
            .withColumn("rcp_no", F.lpad(k.cast("string"), 14, "0")))
    if rows is not None:
        base = base.join(rows, "rcp_no")
    d1 = d.select(F.col("doc_id").alias("doc_key"), F.col("text").alias("note_text"))
    d2 = d.select(F.col("doc_id").alias("cdoc_key"), F.col("text").alias("cnote_text"))
    # the text that a third of the filings have is attached first, so that only it is shuffled again; the
    # others keep out of that join, where their null key would be one task's
    two = base.where(F.col("cdoc_key").isNotNull()).join(d2, "cdoc_key", "left")
    one = base.where(F.col("cdoc_key").isNull()).withColumn("cnote_text", F.lit(None).cast("string"))
    df = two.unionByName(one).join(d1, "doc_key", "inner")
    extra = [c for c in rows.columns if c != "rcp_no"] if rows is not None else []
    return df.select(
        F.when(F.col("c_mktsegment").isin(*MAIN_MARKET_SEGMENTS), F.lit("Y")).otherwise(F.lit("K")).alias("crp_cls"),
        F.col("c_name").alias("crp_nm"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("crp_cd"),
        F.concat(rtype, F.lit(" ("), y.cast("string"), F.lit("."), F.lpad(cm.cast("string"), 2, "0"), F.lit(")")).alias("rpt_nm"),
        "rcp_no",
        F.when(F.col("o_orderstatus") == "P", F.lit(P.CORRECTION_KIND)).otherwise(F.lit("NA")).alias("dic_cls"),
        (k * 10 + 1).cast("string").alias("dcm_no"),
        F.when(k % 3 == 0, (k * 10 + 2).cast("string")).otherwise(F.lit("NA")).alias("col_dcm_no"),
        F.when(k % 17 == 0, F.lit("NA")).otherwise(F.col("note_text")).alias("foot_note"),
        F.when(k % 3 == 0, F.col("cnote_text")).otherwise(F.lit("NA")).alias("consolidated_foot_note"),
        F.concat(F.lit("A"), (F.col("o_custkey") % 9).cast("string"), F.lit("회계법인")).alias("acc_crp"),
        F.date_format(F.date_add(closing, (k % 5 * 30).cast("int")), "yyyy.MM.dd").alias("rcp_dt"), *extra,
    )


def company_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crp_cd, ind_cd): industry code = (50 + nation) || custkey % 10; every 50th unknown."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("crp_cd"),
        F.when(F.col("c_custkey") % 50 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat((F.col("c_nationkey") + 50).cast("string"),
                            (F.col("c_custkey") % 10).cast("string"))).alias("ind_cd"),
    )


def sector_ranges(spark: SparkSession) -> DataFrame:
    """Literal lookup of code-prefix ranges (tens of rows; safe to broadcast)."""
    return spark.createDataFrame(list(SECTOR_RANGES), "pos INT, sector STRING, sector2 STRING, range STRING")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company x fiscal-quarter panel from lineitem joined to orders.

    Sums are exact decimals turned into doubles.  ``qty`` is set to 0 ("no
    data" in the panel's own spelling) where the line count is a multiple of 7.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    y = F.year("o_orderdate")
    q = ((F.month("o_orderdate") + 2) / 3).cast("int")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(18,2)")
    agg = (j.groupBy(F.col("o_custkey").alias("custkey"), y.alias("year"), q.alias("quarter"))
           .agg(F.sum(price * (F.lit(1) - disc)).alias("rev_dec"),
                F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty_dec"),
                F.sum(price).alias("gross_dec"),
                F.count(F.lit(1)).alias("n_lines")))
    return agg.select(
        F.concat(F.lit("A"), F.lpad(F.col("custkey").cast("string"), 6, "0")).alias("symbol"),
        F.col("year").cast("int").alias("year"),
        F.col("quarter").cast("int").alias("quarter"),
        P.period(F.col("year"), F.col("quarter")).cast("int").alias("period"),
        F.col("rev_dec").cast("double").alias("revenue"),
        F.when(F.col("n_lines") % 7 == 0, F.lit(0.0)).otherwise(F.col("qty_dec").cast("double")).alias("qty"),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("gross_dec").cast("double") / F.col("n_lines")).alias("avg_price"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of samples for the statistics: sample = event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("sample"),
                    F.col("user_id").alias("entity"), F.col("value"))


def quarter_end_columns(first_year: int = 1995, last_year: int = 2001) -> list[str]:
    """Quarter-end date headers 'yyyy-mm-dd' of the wide calendar sheet (rule-built)."""
    ends = {3: 31, 6: 30, 9: 30, 12: 31}
    return [f"{y}-{m:02d}-{ends[m]}" for y in range(first_year, last_year + 1) for m in (3, 6, 9, 12)]


def panel_wide(spark: SparkSession, sf_dir: str, value: str = "revenue") -> DataFrame:
    """Wide calendar sheet: one row per company, one column per quarter-end
    date of the years that occur (one min/max, then a rule-built column list)."""
    p = panel(spark, sf_dir)
    span = p.agg(F.min("year").alias("first"), F.max("year").alias("last")).first()
    cols = quarter_end_columns(span["first"], span["last"]) if span["first"] is not None else quarter_end_columns()
    key = F.date_format(F.last_day(F.make_date(F.col("year"), F.col("quarter") * 3, F.lit(1))), "yyyy-MM-dd")
    return (p.withColumn("_d", key).groupBy("symbol").pivot("_d", cols).agg(F.first(value)))


def panel_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet with the same items on three bases as text cells: main 'M-', separate
    '3-' and consolidated '6-' columns, with planted blanks and non-numeric text."""
    p = panel(spark, sf_dir)
    nl = F.col("n_lines")
    q = F.floor("qty").cast("long")
    r = F.floor("revenue").cast("long")
    return p.select(
        "symbol", "year", "quarter", "period",
        F.when(nl % 4 == 0, F.lit(None)).when(nl % 5 == 0, F.lit("n/a")).otherwise(q.cast("string")).alias("M-qty"),
        F.when(nl % 3 == 0, F.lit(None)).otherwise((q + 1).cast("string")).alias("3-qty"),
        F.when(nl % 2 == 0, F.lit(None)).otherwise((q + 2).cast("string")).alias("6-qty"),
        F.when(nl % 6 == 0, F.lit(None)).otherwise(r.cast("string")).alias("M-revenue"),
        F.when(nl % 5 == 0, F.lit("-")).otherwise((r + 1).cast("string")).alias("3-revenue"),
        F.when(nl % 4 == 0, F.lit(None)).otherwise((r + 2).cast("string")).alias("6-revenue"),
    )


def preds_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label vs a deterministic pseudo-prediction over ``labels`` (quality)."""
    lb = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    pred = F.when((k * 7919 + 13) % 10 < 7, F.col("quality")).otherwise(F.lit(1) - F.col("quality"))
    return lb.select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("label"), pred.cast("long").alias("prediction"))


def preds_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-class label of ``embeddings`` vs a deterministic pseudo-prediction."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    pred = F.when((k * 7919 + 13) % 10 < 6, F.col("label")).otherwise((F.col("label") + k) % 10)
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), pred.cast("long").alias("prediction"))


# Attachment titles used by the option adapter (one per kind and
# an unlisted one), and the main-document report types.
OPTION_TITLES = ("감사보고서", "[정정] 감사보고서", "연결감사보고서", "[정정] 연결감사보고서", "기타보고서")
MAIN_TITLES = ("사업보고서", "반기보고서", "분기보고서")


def attachment_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option lists per filing: the filing's order lines are its options
    (date = ship date, title by (partkey + linenumber) % 5, value = line id),
    with the filing date and report type of the filing."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    f = filings(spark, sf_dir).select("rcp_no", "rcp_dt", "rpt_nm")
    titles = F.array(*[F.lit(t) for t in OPTION_TITLES])
    mains = F.array(*[F.lit(t) for t in MAIN_TITLES])
    o = li.select(
        F.lpad(F.col("l_orderkey").cast("string"), 14, "0").alias("rcp_no"),
        F.col("l_linenumber").cast("int").alias("pos"),
        F.to_date("l_shipdate").alias("opt_date"),
        F.get(titles, ((F.col("l_partkey") + F.col("l_linenumber")) % 5).cast("int")).alias("title"),
        F.get(mains, (F.col("l_linenumber") % 3).cast("int")).alias("main_title"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("value"))
    return (o.join(f, "rcp_no", "inner")
             .withColumn("filed", P.filing_date("rcp_dt"))
             .withColumn("rtype", P.report_type("rpt_nm"))
             .drop("rcp_dt", "rpt_nm"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sections: conversation = filing, turn = position, role = title."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("rcp_no"), F.col("turn").alias("pos"), F.col("role").alias("title"),
                    F.col("text"), F.lit(True).alias("is_leaf"))


def ml_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input: embedding vectors with a 3-class label (label % 3) and the
    first three coordinates as plain numeric columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("long").alias("label"),
                    F.col("embedding").alias("emb"),
                    *[F.get("embedding", i).cast("double").alias(f"x{i + 1}") for i in range(3)])
