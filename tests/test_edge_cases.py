"""Inputs that once lost rows or raised: long prefixes, null groups, ties, constant samples."""

from pyspark.sql import functions as F

from notedrift.operators import buckets, features, match, reshape, stats


def test_prefixes_of_any_length(spark):
    df = spark.createDataFrame([(1, "1234567890"), (2, ""), (3, None)], "id int, ind_cd string")
    ranges = spark.createDataFrame([("123456789", 1, "a"), ("12", 2, "b"), ("", 3, "c")], "range string, pos int, sector string")
    got = match.prefix_range_join(df, ranges, ["id"], on_overlap="all", value_cols=("sector",)).collect()
    assert sorted((r.id, r.sector) for r in got) == [(1, "a"), (1, "b"), (1, "c"), (2, "c")]


def test_null_groups_and_ties_are_ranked(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, None).otherwise(F.lit("g")).alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("v"))
    got = stats.group_ranks(df, "g", "v", partitions=8)
    assert got.count() == 4000
    assert sorted(r["rank"] for r in got.where("g is null").collect()) == list(range(1, 1001))
    assert features.stratified_folds(df, "id", "g").count() == 4000


def test_constant_samples_do_not_raise(spark):
    df = spark.createDataFrame([(s, 1.0, 0.0) for s in "aabb"], "sample string, value double, y double")
    assert stats.t_tests(df, "value", "sample", [("a", "b")]).first().t_pooled is None
    assert stats.levene(df, "value", "sample", [("a", "b")]).first().w is None
    assert stats.flag_outliers_mad(df, ["value"]).count() == 4
    line = spark.createDataFrame([([float(i)], float(i)) for i in range(5)], "v array<double>, y double")
    assert features.f_regression_scores(line, "v", "y").count() == 1


def test_many_labels(spark):
    df = spark.range(12000).select(F.format_string("%05d", "id").alias("c"))
    assert all(int(r.c) == r.c_code for r in reshape.encode_labels(df, "c").collect())
    assert reshape.one_hot_long(df, ["c"], "c").count() == 12000


def test_rolling_forms_agree(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("symbol"), F.col("id").alias("period"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    a, b = (sorted(map(tuple, buckets.bucket_rolling(df, "v", method=m).collect())) for m in ("window", "ranks"))
    assert a == b


def test_bootstrap_does_not_depend_on_partitioning(spark):
    from notedrift.operators.models import bootstrap
    rows = spark.range(4000)
    one, two = (sorted(r.id for r in bootstrap(rows.repartition(n), "id", .2, 7).collect()) for n in (2, 5))
    assert one == two and 650 < len(one) < 950 and len(set(one)) < len(one)


def test_prior_filings_by_all_lags(spark):
    from notedrift.operators.match import match_prior_filings
    rows = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 11, 1), ("a", 2, 12, 2), ("a", 5, 13, 1), ("a", 6, 14, 1), ("b", 2, 15, 1), (None, 3, 16, 1)],
                                 "crp_cd string, period int, rcp_no int, rcp_dt int")
    got = {r.rcp_no: (r.prior_q, r.prior_y) for r in match_prior_filings(rows).collect()}
    assert got == {10: (None, None), 11: (10, None), 12: (10, None), 13: (None, 10), 14: (13, 11), 15: (None, None), 16: (None, None)}


def test_targets_of_another_table(spark):
    """Targets by key from a second table; a repeated target key is an error, not more rows."""
    import pytest

    from notedrift.operators import match
    p = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 0.0), ("B", 1, 4.0)], "symbol STRING, period INT, qty DOUBLE")
    t = spark.createDataFrame([("A", 1, 7.0), ("A", 2, 8.0)], "symbol STRING, period INT, y DOUBLE")
    now = {(r.symbol, r.period): r.y_t for r in match.attach_current_target(p, "y", "y_t", target_frame=t).collect()}
    assert now == {("A", 1): 7.0, ("A", 2): 8.0, ("B", 1): None}
    before = {(r.symbol, r.period): r.y_prev for r in match.attach_previous_target(p, "y", target_frame=t).collect()}
    assert before == {("A", 1): None, ("A", 2): 7.0, ("B", 1): None}
    after = match.attach_next_period_target(p, ["y"], features=["qty"], target_frame=t).collect()
    assert [(r.symbol, r.period, r.y_next) for r in after] == [("A", 1, 8.0)]
    twice = t.unionByName(t)
    for join in (lambda: match.attach_current_target(p, "y", "y_t", target_frame=twice),
                 lambda: match.attach_previous_target(p, "y", target_frame=twice),
                 lambda: match.attach_next_period_target(p, ["y"], target_frame=twice),
                 lambda: match.match_filings_to_panel(p.select("symbol", "period"), twice)):
        with pytest.raises(ValueError):
            join().collect()
