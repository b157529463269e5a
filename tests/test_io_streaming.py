"""Sources, sinks and the streaming ingest."""

import os

from pyspark.sql import functions as F

from notedrift.sources import adapters as A
from notedrift.sources import io
from notedrift.streaming.ingest import ingest_pages

SF = "/root/testdata/sf0.001"


def test_stage_csv_chunks_roundtrip(spark, scratch):
    f = A.filings(spark, SF).select("rcp_no", "crp_cd", "rpt_nm")
    io.write_stage(f, os.path.join(scratch, "stage"))
    back = spark.read.parquet(os.path.join(scratch, "stage"))
    assert back.count() == f.count()
    io.write_csv(f, os.path.join(scratch, "csv"))
    codes = io.read_codes(spark, os.path.join(scratch, "csv"), ["rcp_no", "crp_cd", "rpt_nm"])
    assert codes.filter(F.col("crp_cd").startswith("0")).count() > 0   # leading zeros kept
    io.write_chunks(f, os.path.join(scratch, "chunks"), 400, order="rcp_no")
    ch = spark.read.parquet(os.path.join(scratch, "chunks"))
    sizes = sorted(r["count"] for r in ch.groupBy("chunk").count().collect())
    assert sum(sizes) == f.count() and max(sizes) <= 400


def test_results_scan(spark, scratch):
    p = os.path.join(scratch, "res.csv")
    with open(p, "w") as fh:
        fh.write(",".join(f"c{i}" for i in range(10)) + "\n")
        for k in range(3):
            fh.write(",".join(str(0.1 * (i + k)) for i in range(10)) + "\n")
    df = io.results_scan(spark, p)
    long = io.unpivot_results(df)
    assert df.count() == 3 and long.count() == 30


def test_streaming_ingest(spark, scratch):
    src, sink, ck = (os.path.join(scratch, d) for d in ("pages", "stage", "ckpt"))
    f = A.filings(spark, SF)
    # two page files, as the crawler writes them
    f.filter(F.col("rcp_no") < "00000000000800").coalesce(1).write.parquet(os.path.join(src, "page1"))
    f.filter(F.col("rcp_no") >= "00000000000800").coalesce(1).write.parquet(os.path.join(src, "page2"))
    q = ingest_pages(spark, src + "/*", sink, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    expected = f.filter((F.col("foot_note") != "NA") & F.col("foot_note").isNotNull()).count()
    assert got.count() == expected


def test_vectors_and_filings_scan(spark, scratch):
    from notedrift.operators import tfidf
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma")], "id long, text string")
    w = tfidf.tfidf(docs, "id", "text", materialize_counts=False)
    v = io.weights_to_vectors(w, "id", num_features=1 << 10)
    io.write_vectors(v, os.path.join(scratch, "vec"), "id")
    back = {r.id: r.features for r in io.read_vectors(spark, os.path.join(scratch, "vec")).collect()}
    assert back[1].size == 1 << 10 and abs(back[1].norm(2) - 1.0) < 1e-12
    f = A.filings(spark, SF)
    f.write.parquet(os.path.join(scratch, "pages", "p1"))
    scanned = io.filings_scan(spark, os.path.join(scratch, "pages"))
    assert scanned.schema == io.FILING_SCHEMA and scanned.count() == f.count()


def test_lookup_and_missing(spark):
    df = spark.createDataFrame([("000001", '{"ind_cd": "0642"}', "NA", 0.0), ("000002", "{}", "x", 1.0)],
                               "crp_cd string, payload string, note string, v double")
    got = {r.crp_cd: r.ind_cd for r in io.lookup_from_json(df).collect()}
    assert got == {"000001": "0642", "000002": None}
    n = io.normalize_missing(df, na_strings={"note": ["NA", ""]}, zero_is_missing=["v"]).collect()
    assert n[0].note is None and n[0].v is None and n[1].note == "x"
