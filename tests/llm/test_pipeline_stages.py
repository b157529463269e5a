"""Every stage of the pipeline on nulls, repeats, an empty table and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from notedrift.llm import language, toxicity

SF = "/root/testdata/sf0.001"
CLASHING = ["old", "spans", "pii", "verdict", "language_verdict", "key", "row", "host", "declared", "t", "n", "doc", "fp", "mark", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = own.limit(1).select(F.lit(9001).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"),
                              F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    odd = odd.union(odd.select(F.lit(9002).cast("long"), F.lit(""), F.lit("en"), F.lit("x"), F.lit(0).cast("long")))
    odd = odd.union(odd.select(F.lit(None).cast("long"), F.lit("This is the text of a person, mail me.now@home.example.org today, and then again."), F.lit("en"), F.lit("a.example.org"), F.lit(1).cast("long")).limit(1))
    every = own.unionByName(odd).unionByName(own.limit(3)).unionByName(own.limit(3))
    for i, name in enumerate(CLASHING):
        every = every.withColumn(name, F.lit(i))
    return every.persist()


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_columns_and_rows_it_should(spark, docs, k):
    stage = C.STAGES[k][1]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[name] == i for r in rows for i, name in enumerate(CLASHING))
    ids = [r.doc_id for r in rows]
    every = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(ids) <= set(every)
    if k == 0:  # a null or empty text has no language; repeated rows are judged alike
        assert 9001 not in ids and 9002 not in ids
        assert all(ids.count(i) == every.count(i) for i in set(ids))
    if k == 2:  # one of each group
        assert len(ids) == len(set(ids)) and not {9001, 9002} <= set(ids)
    if k == 3:
        assert sorted(ids, key=str) == sorted(every, key=str)
        found = next(r for r in rows if r.doc_id is None)
        assert "me.now@" not in found.text and "[EMAIL]" in found.text and found.n_chars == len(found.text)
        assert next(r for r in rows if r.doc_id == 9001).text is None
    assert stage(spark, docs.where("false"), SF).collect() == []


def test_packing_stage(spark, docs):
    pieces = C.STAGES[4][1](spark, docs, SF).collect()
    every = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted({r.doc_id for r in pieces}, key=str) == sorted(set(every), key=str)
    assert sum(r.piece == 0 for r in pieces) == len(every)
    assert [r.length for r in pieces if r.doc_id in (9001, 9002)] == [1, 1]
    assert C.STAGES[4][1](spark, docs.where("false"), SF).collect() == []


def test_language_of_a_long_html_tag(spark):
    pages = [f'<html data-x="{"a" * 2500}>" lang="de-AT"><p>x</p>', "<HTML\n LANG=fr>", "<html xml:lang='es'>", "<p lang='es'>", None, '<html ' + " ".join(f'a{i}="v"' for i in range(900)) + " lang='en'>"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(F.coalesce(language.html_language(F.col("html")), F.lit(""))).collect()] == ["de-AT", "fr", "", "", "", "en"]


def test_every_suffix_is_evidence(spark):
    """The rarest of many suffixes still speaks for its language."""
    words = {"fr": "le chat est sur la table et il dort dans la maison avec les enfants", "en": "the cat is on the table and it sleeps in the house with the children"}
    rows = [(i, words["en"], "en", f"h{i}.s{i % 300}") for i in range(600)] + [(1000 + i, words["fr"], "fr", f"h{i}.r{i % 300}") for i in range(600)]
    rows += [(2000, words["fr"], "fr", "only.zz"), (3000, "table", None, "new.zz"), (3001, "table", None, "new.s1")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string")
    model = language.train(df, "text", "lang", ("en", "fr"))
    got = {r.id: r.verdict for r in language.identify(df, model, "text", "lang", "host").where("id >= 3000").collect()}
    french = {i: v.probability if v.language == "fr" else 1 - v.probability for i, v in got.items()}
    assert all(v.accepted for v in got.values()) and french[3000] > 5 * french[3001] > 0


def test_rare_toxic_words_are_learned(spark):
    """One row in a hundred is toxic, by words no other row has."""
    clean = [(i, f"a plain note number {i} about rivers and hills. It goes on quietly.", 0) for i in range(4000)]
    bad = [(10_000 + i, f"a plain note number {i}. You vile{i % 4} wretch{i % 3}. It goes on.", 1) for i in range(40)]
    df = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    got = df.select("toxic", (toxicity.score(model, F.col("text")).getField("score") >= 0.5).alias("said")).groupBy("toxic").agg(F.avg(F.col("said").cast("int")).alias("share")).collect()
    share = {r.toxic: r.share for r in got}
    assert share[1] > 0.9 and share[0] < 0.01
