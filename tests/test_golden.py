"""Golden micro-fixtures (typed in from the reference's rules)."""

import datetime as dt

from pyspark.sql import functions as F

from notedrift.functions import periods as P
from notedrift.functions import tagging as G
from notedrift.functions import text as X
from notedrift.operators import buckets as B
from notedrift.operators import clean, extract, reshape, revisions

KIND = P.CORRECTION_KIND


def _filing(crp, rpt, no, dic, dt_):
    return (crp, rpt, no, dic, dt_)


def test_revision_chains(spark):
    rpt = "분기보고서 (2018.03)"
    rows = [
        _filing("c1", rpt, "1a", "NA", "2018.05.15"), _filing("c1", rpt, "1b", KIND, "2018.06.30"),
        _filing("c1", rpt, "1c", KIND, "2018.07.01"),
        _filing("c2", rpt, "2a", "NA", "2018.05.15"), _filing("c2", rpt, "2b", KIND, "2018.07.02"),
        _filing("c3", rpt, "3a", KIND, "2018.08.01"),
        _filing("c4", rpt, "4a", "NA", "2018.05.15"), _filing("c4", rpt, "4b", "NA", "2018.05.20"),
        _filing("c5", rpt, "5a", "NA", "2018.05.15"), _filing("c5", rpt, "5b", KIND, "2018.05.15"),
    ]
    df = spark.createDataFrame(rows, "crp_cd string, rpt_nm string, rcp_no string, dic_cls string, rcp_dt string")
    kept = {r.rcp_no for r in revisions.resolve_revisions(df).collect()}
    assert kept == {"1b", "2a", "3a", "4a", "4b", "5b"}


def test_deadlines(spark):
    df = spark.createDataFrame([(2013, 3), (2018, 6), (2013, 11)], "y int, m int")
    got = [r.d for r in df.select(P.correction_deadline("y", "m").alias("d")).collect()]
    assert got == [dt.date(2013, 6, 30), dt.date(2018, 9, 30), dt.date(2014, 2, 28)]


def _buckets(spark, values, cuts=(0, .25, .75, 1)):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")
    out = B.quantile_bucket(df, "x", cuts, zero_is_missing=False).orderBy("i")
    return [r.bucket for r in out.collect()]


def test_bucket_golden(spark):
    assert _buckets(spark, [1, 2, 3, 4, 5, 6, 7, 8]) == [0, 0, 1, 1, 1, 1, 2, 2]
    assert _buckets(spark, [1, 1, 1, 5, 9]) == [0, 0, 0, 0, 1]
    assert _buckets(spark, [5, 5, 5, 9]) == [0, 0, 0, 1]
    assert _buckets(spark, [1, None, 2, 4]) == [0, None, 1, 2]
    assert _buckets(spark, [1, 1, 1, 1]) == [None] * 4
    assert _buckets(spark, [3]) == [None]


def test_fiscal_quarter(spark):
    rows = [("반기보고서", 6), ("사업보고서", 12), ("분기보고서", 3), ("분기보고서", 9), ("반기보고서", 9), ("사업보고서", 3)]
    df = spark.createDataFrame(rows, "t string, m int")
    got = [r.q for r in df.select(P.fiscal_quarter("t", "m").alias("q")).collect()]
    assert got == [2, 4, 1, 3, None, None]


def test_next_and_prior_periods(spark):
    df = spark.createDataFrame([(2015, 4, 1, 3)], "y int, q int, y1 int, m1 int")
    ny, nq = P.next_period("y", "q")
    r = df.select(ny.alias("ny"), nq.alias("nq"),
                  P.prior_quarter_report_name(F.lit(2015), F.lit(3)).alias("pq"),
                  P.prior_year_report_name(F.lit(P.QUARTERLY), F.lit(2015), F.lit(3)).alias("py")).first()
    assert (r.ny, r.nq) == (2016, 1)
    assert r.pq == "사업보고서 (2014.12)"
    assert r.py == "분기보고서 (2014.03)"


def test_basis_fill(spark):
    rows = [("a", None, "10", None), ("b", None, "10", "12"), ("c", "5", None, None), ("d", "text", "10", None),
            ("e", None, None, None)]
    df = spark.createDataFrame(rows, "k string, `M-x` string, `3-x` string, `6-x` string")
    got = {r.k: r["M-x"] for r in clean.fill_from_alternate_basis(df).collect()}
    assert got == {"a": 10.0, "b": 12.0, "c": 5.0, "d": 10.0, "e": None}


def test_pct_change(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, None, 2.0, 0.0, 3.0])], "symbol string, period int, x double")
    out = B.pct_change(df, "x").orderBy("period")
    assert [r.pct_change for r in out.collect()] == [None, 0.0, 100.0, -100.0, None]


def test_sentences_and_normalize(spark):
    df = spark.createDataFrame([("a. b\nc.\nd? e", "구   분\n\n 합계")], "s string, n string")
    r = df.select(X.split_sentences("s").alias("p"), X.normalize_note("n").alias("m")).first()
    assert r.p == ["a", "b", "c", "d", "e"]
    assert r.m == "구분\n합계"


def test_numeric_tokens(spark):
    toks = ["1,234/SN", "3.5/SN", "1e5/X", "nan/X", "12개/N", "1d/X"]
    df = spark.createDataFrame([(toks,)], "t array<string>")
    assert df.select(X.drop_numeric_tokens("t").alias("k")).first().k == ["12개/N", "1d/X"]


def test_title_parse_and_short_notes(spark):
    df = spark.createDataFrame([("[기재정정]사업보고서 (2018.12)",), ("사업보고서 (2018.12)",)], "t string")
    kind, name = extract.parse_report_title("t")
    got = [(r.k, r.n) for r in df.select(kind.alias("k"), name.alias("n")).collect()]
    assert got == [("기재정정", "사업보고서 (2018.12)"), ("NA", "사업보고서 (2018.12)")]
    notes = spark.createDataFrame([("1\n2\n3\n4",), ("1\n2\n3\n4\n5",)], "n string")
    assert [r.b for r in notes.select(extract.blank_short_note("n").alias("b")).collect()] == [None, "1\n2\n3\n4\n5"]


def test_auditor(spark):
    rows = [(1, 0, "감사인\n한영회계법인 적정"), (2, 0, "감사인\n한영 회계법인")]
    df = spark.createDataFrame(rows, "rcp_no int, pos int, text string")
    out = extract.extract_auditor(df, default=F.concat(F.lit("url:"), F.col("rcp_no").cast("string")))
    assert {r.rcp_no: r.auditor for r in out.collect()} == {1: "한영회계법인", 2: "url:2"}


def test_one_hot(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a")], "i int, c string")
    out = reshape.one_hot(df, "c").orderBy("i").collect()
    assert [r.c_a for r in out] == [0, 0, 1] and [r.c_b for r in out] == [1, 0, 0]


def test_latest_main_document(spark):
    rows = [("r", dt.date(2018, 5, 15), 0, dt.date(2018, 5, 10), "분기보고서", "분기보고서"),
            ("r", dt.date(2018, 5, 15), 1, dt.date(2018, 6, 1), "분기보고서", "분기보고서")]
    df = spark.createDataFrame(rows, "rcp_no string, filed date, pos int, opt_date date, title string, rtype string")
    assert extract.latest_main_document(df).first().main_index == 1


def test_default_tagger(spark):
    df = spark.createDataFrame([("Seoul has 12 firms. ok",)], "t string")
    tags = [(x.surface, x.tag) for x in df.select(G.tag_text("t").alias("g")).first().g]
    assert tags == [("Seoul", "NNP"), ("has", "NNG"), ("12", "SN"), ("firms", "NNG"), ("ok", "JX")]


def test_pluggable_tagger(spark):
    """A per-sentence analyser plugged in as a pandas UDF; a failing sentence is skipped."""
    def analyse(sentence):
        if "bad" in sentence:
            raise ValueError("analyser failed")
        return [(w, "NNG") for w in sentence.split()]

    tagger = G.pandas_tagger(analyse)
    df = spark.createDataFrame([("good words. bad one. more text",)], "t string")
    out = df.select(tagger(X.split_sentences("t")).alias("g")).first().g
    assert [x.surface for x in out] == ["good", "words", "more", "text"]
