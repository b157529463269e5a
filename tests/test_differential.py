"""Differential and property tests against plain-Python implementations."""

import calendar
import datetime as dt
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from notedrift.operators import extract, features, revisions, stats, tfidf

KIND = "기재정정"


def _loop_resolve(rows):
    """The reference's single pass, written plainly: compare with the previous sorted row."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[4], r[2]))
    delete, prev = set(), None
    for i, r in enumerate(rows):
        if r[3] != "NA" and prev is not None and (prev[0], prev[1]) == (r[0], r[1]):
            y, m = (int(v) for v in r[1][r[1].find("(") + 1:r[1].find(")")].split("."))
            last = dt.date(y, m, calendar.monthrange(y, m)[1])
            mm = m + 3
            yy, mm = y + (mm - 1) // 12, (mm - 1) % 12 + 1
            deadline = dt.date(yy, mm, min(last.day, calendar.monthrange(yy, mm)[1]))
            filed = dt.date(*(int(v) for v in r[4].split(".")))
            delete.add(i - 1 if filed <= deadline else i)
        prev = r
    return {r[2] for i, r in enumerate(rows) if i not in delete}


def test_resolve_matches_loop(spark):
    rng = random.Random(7)
    rows = []
    for k in range(600):
        crp = f"{rng.randrange(20):06d}"
        y, m = rng.choice([2016, 2017]), rng.choice([3, 6, 9, 12])
        rpt = f"분기보고서 ({y}.{m:02d})"
        d = dt.date(y, m, 28) + dt.timedelta(days=rng.randrange(0, 150))
        rows.append((crp, rpt, f"{k:014d}", KIND if rng.random() < 0.4 else "NA", d.strftime("%Y.%m.%d")))
    df = spark.createDataFrame(rows, "crp_cd string, rpt_nm string, rcp_no string, dic_cls string, rcp_dt string")
    got = {r.rcp_no for r in revisions.resolve_revisions(df).collect()}
    assert got == _loop_resolve(rows)


def _py_tfidf(docs, max_df=0.95):
    toks = {i: re.findall(r"\w\w+", t.lower()) for i, t in docs.items()}
    toks = {i: [w for w in ws if len(w) >= 2] for i, ws in toks.items()}
    n = len(docs)
    dfc = Counter(w for ws in toks.values() for w in set(ws))
    keep = {w for w, c in dfc.items() if c <= max_df * n}
    out = {}
    for i, ws in toks.items():
        tf = Counter(w for w in ws if w in keep)
        v = {w: c * (math.log((1 + n) / (1 + dfc[w])) + 1) for w, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {w: x / norm for w, x in v.items()} if norm else {}
    return out


def test_tfidf_and_cosine_match_python(spark):
    docs = {1: "alpha beta beta gamma", 2: "beta gamma delta", 3: "omega", 4: "alpha alpha beta", 5: "x y"}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    w = tfidf.tfidf(df, "id", "text", max_df=0.95, hot_terms=2)
    got = {(r.id, r.term): r.weight for r in w.collect()}
    ref = _py_tfidf(docs)
    assert set(got) == {(i, t) for i, v in ref.items() for t in v}
    for (i, t), x in got.items():
        assert abs(x - ref[i][t]) < 1e-12
    pairs = spark.createDataFrame([(2, 1), (4, 1), (3, 1), (5, 2), (1, None)], "id long, prior_id long")
    d = {(r.id, r.prior_id): r.distance for r in tfidf.cosine_distance(w, pairs, "id", "prior_id").collect()}
    cos = sum(ref[2][t] * ref[1].get(t, 0) for t in ref[2])
    assert abs(d[(2, 1)] - (1 - cos)) < 1e-12
    assert d[(3, 1)] == 1.0          # no shared term
    assert d[(5, 2)] is None          # empty vector (single-letter words only)
    assert d[(1, None)] is None       # no prior


def test_group_ranks_and_folds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    r = stats.group_ranks(df, "g", "v", partitions=5).collect()
    for g in "abc":
        mine = sorted((x.rank, x.v) for x in r if x.g == g)
        assert [a for a, _ in mine] == list(range(1, len(mine) + 1))
        assert [b for _, b in mine] == sorted(b for _, b in mine)
    f = features.stratified_folds(df, "id", "g", 5, 0).collect()
    cnt = Counter((x.g, x.fold) for x in f)
    for g in "abc":
        sizes = [cnt[(g, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert len(f) == 500


def test_nearest_attachment_exact_fold(spark):
    filed = dt.date(2018, 5, 15)
    opts = [(0, dt.date(2018, 5, 1), "감사보고서", "p0"), (1, dt.date(2018, 5, 14), "감사보고서", "p1"),
            (2, dt.date(2018, 5, 10), "[정정] 감사보고서", "c2"), (3, dt.date(2018, 5, 20), "연결감사보고서", "k3")]
    rows = [("r", filed, p, d, t, v) for p, d, t, v in opts]
    df = spark.createDataFrame(rows, "rcp_no string, filed date, pos int, opt_date date, title string, value string")
    exact = extract.nearest_attachment(df, mode="exact").first()
    # p0 taken first (14 days); p1 ignored (plain, pick exists); c2 (5 days) nearer -> replaces
    assert (exact.dcm_no, exact.col_dcm_no) == ("c2", "k3")
    clean = extract.nearest_attachment(df, mode="clean").first()
    assert (clean.dcm_no, clean.col_dcm_no) == ("c2", "k3")


def test_t_tests_against_formula(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.5]
    b = [2.0, 4.0, 6.0, 8.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "s string, v double")
    t = stats.t_tests(df, "v", "s", [("a", "b")]).first()
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va = sum((x - ma) ** 2 for x in a) / (len(a) - 1)
    vb = sum((x - mb) ** 2 for x in b) / (len(b) - 1)
    assert abs(t.t_welch - (ma - mb) / math.sqrt(va / len(a) + vb / len(b))) < 1e-12
    p = stats.t_two_sided_p(t.t_welch, t.df_welch)
    assert 0 < p < 1


def test_group_quantiles_equal_percentile(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), rng.choice([1.0, 2.0, 2.0, 3.5, 7.0, rng.random() * 10])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.33, 0.5, 0.66, 0.75, 1.0]
    mine = {r.g: r.q for r in stats.group_quantiles(df, "g", "v", probs).collect()}
    ref = {r.g: r.q for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    for g in ref:
        assert all(abs(a - b) < 1e-12 for a, b in zip(mine[g], ref[g]))


def test_rolling_buckets_ranks_equal_window(spark):
    from notedrift.operators import buckets
    rng = random.Random(5)
    rows = [(s, p, float(rng.randrange(0, 20))) for s in ("s1", "s2", "s3") for p in range(rng.randrange(30, 90))]
    df = spark.createDataFrame(rows, "symbol string, period int, x double")
    a = {(r.symbol, r.period): r.bucket for r in buckets.bucket_rolling(df, "x", rows=10).collect()}
    b = {(r.symbol, r.period): r.bucket for r in buckets.bucket_rolling(df, "x", rows=10, method="window").collect()}
    assert a == b and len(a) == len(rows)


def test_hot_term_path_equals_plain_join(spark):
    rng = random.Random(9)
    words = ["common"] * 6 + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    docs.append((300, "zz"))  # a document whose only term is rare
    df = spark.createDataFrame(docs, "id long, text string")
    a = {(r.id, r.term): r.weight for r in tfidf.tfidf(df, "id", "text", hot_terms=3, max_df=0.9).collect()}
    b = {(r.id, r.term): r.weight for r in tfidf.tfidf(df, "id", "text", hot_terms=0, max_df=0.9).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)
