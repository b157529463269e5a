"""Arrays of weights a document against the long form, and distances of both."""

import pytest
from pyspark.sql import functions as F

from notedrift.operators import tfidf as T

DOCS = [(1, "aa bb bb cc"), (2, "bb cc dd dd dd"), (3, "ee"), (4, ""), (5, None), (6, "aa aa bb ff gg"), (7, "aa bb bb cc")]
PAIRS = [(1, 7), (1, 2), (1, 3), (2, 6), (6, 4), (5, 1), (3, None), (1, 2)]


@pytest.mark.parametrize("hot", [2, 10000])
@pytest.mark.parametrize("max_df,min_df", [(0.95, 0), (3, 2)])
def test_vectors_are_the_long_form(spark, hot, max_df, min_df):
    df = spark.createDataFrame(DOCS, "id long, text string")
    tokens = F.split("text", " +")
    tokens = F.filter(tokens, lambda t: t != "")
    long = T.tfidf(df, "id", tokens=tokens, max_df=max_df, min_df=min_df)
    vectors = T.document_vectors(df, "id", tokens, max_df=max_df, min_df=min_df, hot_terms=hot)
    want = {(r.id, r.code): r.weight for r in long.select("id", F.xxhash64("term").alias("code"), "weight").collect()}
    rows = vectors.collect()
    assert all([e.code for e in r.vector] == sorted(e.code for e in r.vector) for r in rows)
    got = {(r.id, e.code): e.w for r in rows for e in r.vector}
    assert got == pytest.approx(want)
    pairs = spark.createDataFrame(PAIRS, "id long, prior_id long")
    a = {(r.id, r.prior_id): r.distance for r in T.pair_distances(long, pairs).collect()}
    b = {(r.id, r.prior_id): r.distance for r in T.vector_distances(vectors, pairs).collect()}
    assert b == pytest.approx(a)


def test_counts_of_odd_documents(spark):
    df = spark.createDataFrame([(1, ["x"] * 3), (2, []), (3, None), (4, ["x", None, "y"])], "id long, t array<string>")
    got = {r.id: (len(r.codes), sorted(r.counts)) for r in T.term_counts(df, "id", F.col("t")).collect()}
    assert got[1] == (1, [3]) and got[2] == (0, []) and got[3] == (0, [])
    assert sum(got[4][1]) == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert T.document_vectors(df, "id", F.split("text", " ")).count() == 0
