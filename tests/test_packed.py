"""Rows that stay whole: packed documents, folds of all seeds in one array, texts attached last."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notedrift.operators import many_svm as S
from notedrift.operators import models as MD
from notedrift.operators import nb_cv as NB
from notedrift.operators import tfidf as T
from notedrift.plans.registry import QUERIES, load_all
from notedrift.sources import adapters as A

SF_SMALL = "/root/testdata/sf0.001"

DOCS = [(1, "aa bb bb cc"), (2, "bb cc dd dd dd"), (3, "ee"), (4, ""), (5, None), (6, "aa aa bb ff gg"), (7, "aa bb bb cc")]


def _tokens():
    return F.filter(F.split("text", " +"), lambda t: t != "")


@pytest.mark.parametrize("hot", [2, 10000])
def test_packed_distances(spark, hot):
    df = spark.createDataFrame(DOCS, "id long, text string")
    pairs = spark.createDataFrame([(1, 7), (1, 2), (1, 3), (2, 6), (6, 4), (5, 1), (3, None), (1, 2)], "id long, prior_id long")
    want = {(r.id, r.prior_id): r.distance for r in T.pair_distances(T.tfidf(df, "id", tokens=_tokens()), pairs).collect()}
    packed = T.packed_vectors(df, "id", _tokens(), hot_terms=hot)
    assert {(r.id, r.prior_id): r.distance for r in T.packed_distances(packed, pairs).collect()} == pytest.approx(want)
    assert not isinstance(T.packed_vectors(df.union(df), "id", _tokens()), T.PackedVectors)  # repeated ids


def test_weights_are_not_shuffled_by_document(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    plan = T.tfidf(df, "id", tokens=_tokens())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_repeated_ids_are_one_document(spark):
    df = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, "cc"), (None, "bb")], "id long, text string")
    one = spark.createDataFrame([(1, "aa bb aa"), (2, "cc"), (None, "bb"), (None, None)], "id long, text string")
    a, b = ({(r.id, r.term): r.weight for r in T.tfidf(d, "id", tokens=_tokens(), max_df=None).collect()} for d in (df, one))
    assert a == pytest.approx(b) and set(a) == {(1, "aa"), (1, "bb"), (2, "cc"), (None, "bb")}


def test_entries_are_not_copied_for_seeds(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 1)], "id long, label long")
    points = df.select("id", F.lit("t").alias("feature"), F.lit(1.0).alias("value"), F.lit(False).alias("scale"))
    folds = NB.repeated_folds(df, "id", "label", 3, range(30))
    rows = NB.packed_rows(points, folds, range(30)).collect()
    assert len(rows) == 13 and all(len(r.folds) == 30 for r in rows)  # the repeated id keeps both its rows
    want = sorted((r.seed, r.id, r.fold) for r in folds.collect())
    assert sorted((s, r.id, f) for r in rows for s, f in enumerate(r.folds)) == want


def test_rows_beside_points(spark):
    """Sparse rows give the predictions of the same values in long form."""
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, label long")
    text = df.select("id", F.concat(F.lit("t"), (F.col("id") * 7 % 5 + F.col("label")).cast("string")).alias("feature"), F.lit(0.7).alias("value"), F.lit(False).alias("scale"))
    numbers = df.select("id", F.lit("#n").alias("feature"), (F.col("id") % 11).cast("double").alias("value"), F.lit(True).alias("scale"))
    folds = NB.repeated_folds(df, "id", "label", 3, [0, 1])
    rows = text.select("id", F.array(F.xxhash64("feature")).alias("codes"), F.array("value").alias("weights"))
    a, b = ({(r.seed, r.id): r.prediction for r in d.collect()} for d in (
        NB.complement_nb_cv(numbers.unionByName(text), folds, 3), NB.complement_nb_cv(numbers, folds, 3, rows=rows)))
    assert a == b and len(a) == 120


def test_filings_of_some_rows(spark):
    every = A.filings(spark, SF_SMALL)
    some = every.where(F.col("rcp_no").substr(-1, 1) == "3").select("rcp_no", F.lit(1).alias("mark"))
    got, want = A.filings(spark, SF_SMALL, some), every.join(some, "rcp_no")
    assert set(got.columns) == set(want.columns)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_variants_carry_digests(spark):
    load_all()
    plan = QUERIES["prefer_consolidated"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "text" not in plan


def test_tasks_do_not_grow(spark):
    df = spark.range(100).repartition(100)
    assert MD._one_task_a_core(df).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_draws_are_kept_in_the_rows(spark):
    plan, _ = S.cross_plan([0, 1], 2, 2, 2, 0.5, 1.0, 2)
    rows = spark.createDataFrame([(i, i % 2, [i % 2, i % 3 % 2], np.array([i, 1], "<f4").tobytes()) for i in range(20)], "key long, label int, folds array<int>, z binary")
    kept = S._drawn(rows, plan)
    for r in kept.collect():
        assert np.frombuffer(r.drawn, np.uint8).tolist() == plan.weights(np.array([r.key]), np.array([r.folds])).ravel().tolist()
    assert np.allclose(S.fit(kept, plan, 3), S.fit(rows, plan, 3))
