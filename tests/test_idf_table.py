"""The table of idf by document frequency, and distances of documents whose rows are merged."""

import pytest
from pyspark.sql import functions as F

from notedrift.operators import tfidf as T
from notedrift.plans.registry import QUERIES, load_all

ROWS = [(1, "aa bb bb cc"), (2, "bb cc dd dd dd"), (3, "ee"), (4, ""), (5, None), (6, "aa aa bb ff gg"), (7, "aa bb bb cc")]


def _tokens():
    return F.filter(F.split("text", " +"), lambda t: t != "")


@pytest.mark.parametrize("min_df", [0, 2])
def test_terms_of_one_document_need_no_table(spark, min_df):
    """aa, bb, cc are in two documents or more: a table of three leaves only terms of one idf, so nothing is sorted or shuffled by term."""
    df = spark.createDataFrame(ROWS, "id long, text string")
    counts = T.term_counts(df, "id", _tokens())
    idf = T._Idf(counts, 7, 0.95, min_df, 3)
    assert idf.rest is None and len(idf.hot.value[0]) == 3 and (idf.other > 1) == (min_df == 0)
    want = {(r.id, r.term): r.weight for r in T.tfidf(df, "id", tokens=_tokens(), min_df=min_df).collect()}
    got = T.tfidf(df, "id", tokens=_tokens(), min_df=min_df, hot_terms=3)
    assert {(r.id, r.term): r.weight for r in got.collect()} == pytest.approx(want)


def test_table_holds_whole_frequencies(spark):
    df = spark.createDataFrame(ROWS, "id long, text string")
    idf = T._Idf(T.term_counts(df, "id", _tokens()), 7, 0.95, 0, 2)  # bb in 4, aa and cc in 3
    assert len(idf.hot.value[0]) == 1 and idf.rest.count() == 6


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_merged_rows_are_one_document(spark, hot):
    df = spark.createDataFrame([*ROWS, (1, "dd aa"), (3, None), (None, "aa")], "id long, text string")
    pairs = spark.createDataFrame([(1, 7), (1, 2), (1, 3), (2, 6), (6, 4), (5, 1), (3, None), (1, 2)], "id long, prior_id long")
    want = {(r.id, r.prior_id): r.distance for r in T.pair_distances(T.tfidf(df, "id", tokens=_tokens()), pairs).collect()}
    packed = T.packed_vectors(df, "id", _tokens(), hot_terms=hot, merge=True)
    assert {(r.id, r.prior_id): r.distance for r in T.packed_distances(packed, pairs).collect()} == pytest.approx(want)


def test_distances_of_documents_shuffle_no_terms(spark):
    load_all()
    plan = QUERIES["cosine_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "term#" not in plan and "MapInArrow" in plan
