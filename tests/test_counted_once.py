"""Texts are split once and many at a time, folds of all seeds are ranked by narrow keys, packed documents go to naive Bayes and
the machines as they are, and written tables leave no shuffle behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from notedrift import session
from notedrift.functions import tagging as G
from notedrift.functions import text as X
from notedrift.operators import features as FT
from notedrift.operators import many_svm as S
from notedrift.operators import nb_cv as NB
from notedrift.operators import tfidf as T

TEXTS = ["Ein  Wort über_alles, 3.5 x2 É é", None, "", "\n\n a  bc\n def", "Straße ΣΑΣ İstanbul 日本語 𝒳𝒴 ﬁn ½x ²³", "a b c", "ab ab AB ab-ab", "x" * 3000 + " " + "yz" * 50, "naïve café​café ퟿"]


def test_words_are_the_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    want = {r.id: r.t or [] for r in df.select("id", X.tokenize("text").alias("t")).collect()}
    run = X.word_codes(X.token_characters(spark))
    lower = [r.t for r in df.orderBy("id").select(F.lower("text").alias("t")).collect()]
    n, codes = run(lower)
    assert n.tolist() == [len(want[i]) for i in range(len(TEXTS))]
    word = [t for i in range(len(TEXTS)) for t in want[i]]
    assert len(set(zip(word, codes.tolist()))) == len(set(word)) == len(set(codes.tolist()))
    # alone, in another order and among others a word has one code
    assert run([lower[6]])[1].tolist() == codes[n[:6].sum():n[:7].sum()].tolist()
    assert run([])[0].tolist() == [] and run([None])[0].tolist() == [0]


@pytest.mark.parametrize("block", [1, 1 << 20])
@pytest.mark.parametrize("hot", [2, 10000])
def test_words_have_the_distances_of_tokens(spark, block, hot, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_TERMS", block)
    df = spark.createDataFrame([(1, "aa bb bb cc"), (2, "bb cc dd dd dd"), (3, "ee"), (4, ""), (5, None), (6, "aa aa bb ff gg"), (7, "AA bb, bb cc")], "id long, text string")
    pairs = spark.createDataFrame([(1, 7), (1, 2), (1, 3), (2, 6), (6, 4), (5, 1), (3, None)], "id long, prior_id long")
    want = {(r.id, r.prior_id): r.distance for r in T.pair_distances(T.tfidf(df, "id", "text"), pairs).collect()}
    packed = T.packed_vectors(df, "id", words=F.col("text"), hot_terms=hot)
    assert {(r.id, r.prior_id): r.distance for r in T.packed_distances(packed, pairs).collect()} == pytest.approx(want)


def test_a_text_is_read_once(spark):
    """The plan that tokenises runs once, not for the frequencies and again for the vectors."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x
    df = spark.createDataFrame([(i, f"aa b{i}b cc") for i in range(20)], "id long, text string").withColumn("text", F.udf(look, "string")("text"))
    T.packed_vectors(df, "id", words=F.col("text"))
    assert seen.value == 20


def test_normalised_notes_and_tags(spark):
    df = spark.createDataFrame([(x,) for x in [*TEXTS, "a\n\n b", "a  b", "a\n b", "abc", "Ab", "ab", "ab\n", "É", "éa", "３", "½", "nan", "1,2", ".", "x1", "abc1", "ab1"]], "t string")
    chain = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\n+", "\n"), r"\n ", "\n"), r" {2,}", "")
    t = F.col("t")
    tag = (F.when(t.rlike(r"^\p{N}"), "SN").when(t.rlike(r"^\p{Lu}"), "NNP").when(t.rlike(r"^\p{L}{1,2}$"), "JX").when(t.rlike(r"^\p{L}"), "NNG").when(t.isin(".", "?", "!"), "SF").otherwise("SW"))
    for r in df.select("t", X.normalize_note("t").alias("a"), chain.alias("b"), G.class_tag(t).alias("c"), tag.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t


def test_tags_of_many_texts(spark):
    """Tokens and tags are those of the patterns, text by text."""
    odd = ["", None, ".", "a.", "a.\n", ". ", "? ! .", "1.2.3, 4,5. 6,,7 8.\n9", "x.\ny", "Mr. X! Really?\nYes.", "³½ ４.５ Ⅷ", "\u00a0a\u2003b\x0bc\x1cd\x85e", "a/b;c", "１.2", "end. ", "..  ..", "!\n?", "don't 3.14.", "日本語。x", "𝒳𝒴.5 5.𝒳", "1. 2", "1.\n2"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, *odd])], "id long, t string").coalesce(1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    for d in (df, docs):
        for normal in (True, False):
            got = d.select("id", "t", G.tag_text("t", normal).alias("a"), G.tag_by_patterns("t", normal).alias("b"))
            bad = [r for r in got.collect() if r.a != r.b]
            assert not bad, bad[:1]


def test_folds_of_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(NB, "FOLD_ROWS", 64)
    monkeypatch.setattr(NB, "FOLD_KEYS", 150)
    df = spark.createDataFrame([(i, (i * 7) % 3 if i % 10 else None) for i in range(500)] + [(None, 1)], "id LONG, label LONG")
    got = NB.fold_arrays(df, "id", "label", 5, [0, 3])
    assert got.count() == 501  # a row a row: nothing is copied for a seed
    found = {r.id: r.folds for r in got.collect()}
    for i, s in enumerate([0, 3]):
        assert {r.id: r.fold for r in FT.stratified_folds(df, "id", "label", 5, s).collect()} == {x: f[i] for x, f in found.items()}


def test_a_row_that_stands_twice_takes_no_part(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 1), (4, 1)], "id long, label long")
    a, b = (sorted(S.packed_folds(f, 4).select("id", "label").collect()) for f in (NB.fold_arrays(df, "id", "label", 3, range(4)), NB.repeated_folds(df, "id", "label", 3, range(4))))
    assert a == b and len(a) == 12


@pytest.mark.parametrize("few,hot,entries", [(0, 1000, 1 << 22), (1000, 1000, 40), (3, 3, 40)])
def test_packed_documents_beside_points(spark, few, hot, entries, monkeypatch):
    """Predictions are those of the same weights in long rows, however the entries are held."""
    for name, value in (("LIST", few), ("CHUNK_ENTRIES", entries), ("BUCKET_ENTRIES", entries)):
        monkeypatch.setattr(NB, name, value)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "kk"]
    df = spark.createDataFrame([(i, i % 3, " ".join(words[(i * j + i % 3) % 9] for j in range(1, 6)) if i % 11 else None) for i in range(90)], "id long, label long, text string")
    numbers = df.select("id", F.lit("#n").alias("feature"), (F.col("id") % 7).cast("double").alias("value"), F.lit(True).alias("scale"))
    folds = NB.repeated_folds(df.where("id != 5"), "id", "label", 3, [0, 1, 4])
    packed = T.packed_vectors(df, "id", words=F.col("text"), hot_terms=hot, max_df=None, merge=True)
    want = {(r.seed, r.fold, r.id): r.prediction for r in NB.complement_nb_cv(numbers, folds, 3, rows=T.tfidf_rows(df, "id", "text", max_df=None, named="codes")).collect()}
    got = {(r.seed, r.fold, r.id): r.prediction for r in NB.complement_nb_cv(numbers, folds, 3, rows=packed).collect()}
    assert got == want and len(got) == 267
    scores = [{(r.seed, r.fold): round(r.accuracy, 9) for r in NB.repeated_nb_cv(numbers, df, 3, [4, 0], rows=x).collect()} for x in (packed, T.tfidf_rows(df, "id", "text", max_df=None, named="codes"))]
    assert scores[0] == scores[1] and len(scores[0]) == 6


def test_packed_documents_for_the_machines(spark):
    df = spark.createDataFrame([(1, [7], [0.5]), (2, [], []), (3, [7], [1.0])], "id long, features array<long>, values array<double>")
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa aa cc"), (4, "dd")], "id long, text string")
    packed = T.packed_vectors(docs, "id", X.tokenize("text"), max_df=None)
    want = {r.id: dict(zip(r.codes, r.weights)) for r in T.tfidf_rows(docs, "id", "text", max_df=None, named="codes").collect()}
    got = T.with_weights(df.join(packed.rows, "id", "left"), packed, "features", "values")
    assert got.columns == ["id", "features", "values"] and packed.terms() == 4
    for r in got.collect():
        own = {7: r.values[0]} if r.id != 2 else {}
        assert dict(zip(r.features, r.values)) == pytest.approx(own | want.get(r.id, {}))


def test_gradients_do_not_grow_with_partitions(spark):
    """As many partial gradients as cores, whatever the partitions of the rows; the sums are the same."""
    plan, _ = S.cross_plan([0, 1], 2, 2, 2, 0.5, 1.0, 2)
    rows = spark.createDataFrame([(i, i % 2, [i % 2, i % 3 % 2], np.array([i, 1], "<f4").tobytes()) for i in range(60)], "key long, label int, folds array<int>, z binary")
    assert np.allclose(S.fit(rows.repartition(24), plan, 3), S.fit(rows.coalesce(1), plan, 3))


def test_written_tables_are_dense_and_leave_no_shuffle(spark):
    before = spark.conf.get(session._CLEANUP)
    table = session.materialize(spark.range(50_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t")
    files = [f for f in os.listdir(table.materialized_path.removeprefix("file:")) if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files) and table.count() == 7
    assert spark.conf.get(session._CLEANUP) == before


def test_report_reads_its_rows_from_a_table(spark, monkeypatch):
    """Distances are worked out once, not for every pass of the regression report over its rows."""
    from notedrift.plans import q_linear
    seen = []
    monkeypatch.setattr(q_linear.G, "ols_report", lambda df, *a, **b: seen.append(df) or df)
    q_linear.q_ols_report(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan and seen[0].count() > 0
