"""Bracketed selection: exact quantiles whatever the ties, sizes and null groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notedrift.operators import buckets as B
from notedrift.operators import stats as S

PROBS = (0, .25, .33, .5, .66, .75, 1)


def groups():
    rng = np.random.default_rng(1)
    out = {"wide": rng.standard_normal(30_000) * 1e6, "ties": np.where(rng.random(20_000) < 0.9, 5.0, rng.standard_normal(20_000)), "two": np.repeat([1.0, 9.0], 5_000),
           "one": np.array([3.0]), "few": np.array([1.0, 1.0, 2.0, 7.0]), "same": np.full(300, -2.0), None: rng.integers(0, 50, 5_000).astype(float)}
    return out


def frame(spark):
    rows = [(g, float(v)) for g, vs in groups().items() for v in vs] + [("few", None), ("gone", None), (None, None)]
    return spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(6)


@pytest.mark.parametrize("accuracy", [10_000, 60])
def test_quantiles_equal_sorted_ones(spark, monkeypatch, accuracy):
    monkeypatch.setattr(S, "ACCURACY", accuracy)  # coarse brackets hold more and must stay exact
    got = {r.g: r.q for r in S.group_quantiles(frame(spark), "g", "v", PROBS).collect()}
    assert set(got) == set(groups())
    for g, vs in groups().items():
        assert got[g] == pytest.approx(np.quantile(vs, PROBS).tolist(), rel=1e-12), g


def test_a_finer_sketch_bounds_what_is_gathered(spark, monkeypatch):
    monkeypatch.setattr(S, "ACCURACY", 60)
    monkeypatch.setattr(S, "INSIDE", 50)
    got = {r.g: r.q for r in S.group_quantiles(frame(spark), ["g"], "v", (.5,)).collect()}
    assert all(got[g] == pytest.approx([np.median(vs)]) for g, vs in groups().items())


def test_null_groups_keep_their_rows(spark):
    df = frame(spark).where("g IS NULL OR g = 'few'")
    n = df.where("v IS NOT NULL").count()
    kept = S.filter_outliers_iqr(df, "v", 10.0, by=["g"])
    assert kept.count() == n
    assert S.flag_outliers_mad(df, ["v"], by=["g"]).where("g IS NULL AND is_outlier IS NOT NULL").count() == 5_000
    assert B.bucket_by_entity(df, "v", "g", zero_is_missing=False).where("g IS NULL AND bucket IS NOT NULL").count() == 5_000
    assert B.bucket_cross_section(df, "v", "g", zero_is_missing=False).count() == df.count()
    assert S.filter_outliers_iqr(df.where("g IS NULL"), "v").count() == 5_000
    w = S.shapiro_wilk(S.filter_outliers_iqr(df.where("g IS NULL"), "v", by=["g"]), "v", "g")
    assert w.count() == 1
