"""Queries of the feature, model and metric layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import match
from pyspark.ml.functions import vector_to_array
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import nb_cv as NB
from ..sources import adapters as A
from ..sources.tables import table
from .q_filings import r6
from .registry import register
from .views_sql import with_views

N_EMB = 64  # embedding width of the driver's table


def _ml(spark, sf_dir):
    return A.ml_frame(spark, sf_dir)


def _vec(spark, sf_dir):
    return FT.assemble_features(_ml(spark, sf_dir), ["emb"], "features")


# ---------------------------------------------------------------- exact feature operators
@register("minmax_scale", with_views(["ml_frame"], """
SELECT id, round(CASE WHEN max(x1) OVER () = min(x1) OVER () THEN 0.0 ELSE (x1 - min(x1) OVER ()) / (max(x1) OVER () - min(x1) OVER ()) END, 6) AS x1_scaled,
       round(CASE WHEN max(x2) OVER () = min(x2) OVER () THEN 0.0 ELSE (x2 - min(x2) OVER ()) / (max(x2) OVER () - min(x2) OVER ()) END, 6) AS x2_scaled
FROM ml_frame"""))
def q_minmax_scale(spark, sf_dir):
    out = FT.minmax_scale(_ml(spark, sf_dir), ["x1", "x2"])
    return out.select("id", r6("x1_scaled").alias("x1_scaled"), r6("x2_scaled").alias("x2_scaled"))


@register("standard_scale", with_views(["ml_frame"], """
SELECT id, round((x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER (), 6) AS x1_std,
       round((x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER (), 6) AS x2_std FROM ml_frame"""))
def q_standard_scale(spark, sf_dir):
    out = FT.standard_scale(_ml(spark, sf_dir), ["x1", "x2"])
    return out.select("id", r6("x1_std").alias("x1_std"), r6("x2_std").alias("x2_std"))


@register("interactions", with_views(["ml_frame"], "SELECT id, round(x1 * x2, 6) AS x1xx2, round(x1 * x3, 6) AS x1xx3 FROM ml_frame"))
def q_interactions(spark, sf_dir):
    out = FT.interactions(_ml(spark, sf_dir), [("x1", "x2"), ("x1", "x3")])
    return out.select("id", r6("x1xx2").alias("x1xx2"), r6("x1xx3").alias("x1xx3"))


@register("select_percentile", with_views(["ml_frame"], """
WITH x AS (SELECT CAST(label AS DOUBLE) AS y, unnest(emb) AS x, unnest(range(0, len(emb))) AS feature FROM ml_frame),
g AS (SELECT feature, corr(CAST(x AS DOUBLE), y) AS r, count(*) AS n FROM x GROUP BY feature),
s AS (SELECT feature, r * r / (1 - r * r) * (n - 2) AS f FROM g)
SELECT CAST(feature AS INTEGER) AS feature, round(f, 6) AS f_score,
       row_number() OVER (ORDER BY f DESC, feature) <= 3 AS selected FROM s"""))
def q_select_percentile(spark, sf_dir):
    sc = FT.f_regression_scores(_ml(spark, sf_dir), "emb", "label")
    out = FT.select_percentile(sc, 5.0)
    return out.select(F.col("feature").cast("int"), r6("f_score").alias("f_score"), "selected")


@register("stratified_folds", with_views(["ml_frame"], """
SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|0'), id) - 1) % 5 AS INTEGER) AS fold
FROM ml_frame"""))
def q_stratified_folds(spark, sf_dir):
    return FT.stratified_folds(_ml(spark, sf_dir).select("id", "label"), "id", "label", 5, 0)


@register("train_test_split", with_views(["ml_frame"], """
SELECT id, substr(md5(CAST(id AS VARCHAR) || '|0'), 1, 8) < '40000000' AS is_test FROM ml_frame"""))
def q_train_test_split(spark, sf_dir):
    return FT.train_test_split(_ml(spark, sf_dir).select("id"), "id", 0.25, 0)


@register("placebo_noise", with_views(["ml_frame"], """
SELECT id, round(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|0'), 1, 8)) AS BIGINT) / 4294967296.0, 6) AS x1 FROM ml_frame"""))
def q_placebo_noise(spark, sf_dir):
    out = FT.placebo_noise(_ml(spark, sf_dir).select("id", "x1"), "id", ["x1"], seed=0)
    return out.select("id", r6("x1").alias("x1"))


@register("placebo_corpus", """
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS position FROM embeddings),
     b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents)
SELECT CAST(a.position AS BIGINT) AS position, a.vec_id, b.doc_id FROM a JOIN b USING (position)""")
def q_placebo_corpus(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id")
    b = table(spark, sf_dir, "documents").select("doc_id")
    return FT.align_by_position(a, "vec_id", b, "doc_id").select("position", "vec_id", "doc_id")


# ---------------------------------------------------------------- metrics
_CM_SQL = """
WITH p AS (SELECT 'binary' AS dataset, label, prediction FROM preds_binary
           UNION ALL SELECT 'multiclass', label, prediction FROM preds_multiclass),
cm AS (SELECT dataset, label, prediction, count(*) AS n FROM p GROUP BY ALL)"""


@register("confusion_matrix", with_views(["preds_binary", "preds_multiclass"], _CM_SQL + """
SELECT dataset, label, prediction, CAST(n AS BIGINT) AS n FROM cm"""))
def q_confusion_matrix(spark, sf_dir):
    p = (A.preds_binary(spark, sf_dir).withColumn("dataset", F.lit("binary"))
         .unionByName(A.preds_multiclass(spark, sf_dir).withColumn("dataset", F.lit("multiclass"))))
    return M.confusion(p, by=["dataset"])


@register("classification_metrics", with_views(["preds_binary", "preds_multiclass"], _CM_SQL + """,
cls AS (SELECT dataset, label AS c FROM cm UNION SELECT dataset, prediction FROM cm),
per AS (
  SELECT cls.dataset, cls.c,
         coalesce((SELECT sum(n) FROM cm WHERE cm.dataset = cls.dataset AND cm.label = cls.c AND cm.prediction = cls.c), 0) AS tp,
         coalesce((SELECT sum(n) FROM cm WHERE cm.dataset = cls.dataset AND cm.label = cls.c), 0) AS n_true,
         coalesce((SELECT sum(n) FROM cm WHERE cm.dataset = cls.dataset AND cm.prediction = cls.c), 0) AS n_pred
  FROM cls
)
SELECT dataset, round(sum(tp) / sum(n_true), 6) AS accuracy,
       round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (n_true + n_pred) END), 6) AS f1_macro
FROM per GROUP BY dataset"""))
def q_classification_metrics(spark, sf_dir):
    p = (A.preds_binary(spark, sf_dir).withColumn("dataset", F.lit("binary"))
         .unionByName(A.preds_multiclass(spark, sf_dir).withColumn("dataset", F.lit("multiclass"))))
    m = M.classification_metrics(p, by=["dataset"])
    return m.select("dataset", r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"))


@register("rmse", with_views(["preds_multiclass"], """
SELECT round(sqrt(avg((CAST(prediction AS DOUBLE) - label) ^ 2)), 6) AS rmse FROM preds_multiclass"""))
def q_rmse(spark, sf_dir):
    return M.rmse(A.preds_multiclass(spark, sf_dir)).select(r6("rmse").alias("rmse"))


@register("ols_fit", with_views(["panel"], """
SELECT round(regr_slope(avg_price, qty), 6) AS slope, round(regr_intercept(avg_price, qty), 6) AS intercept,
       round(regr_r2(avg_price, qty), 6) AS r2, CAST(regr_count(avg_price, qty) AS BIGINT) AS n FROM panel"""))
def q_ols_fit(spark, sf_dir):
    p = A.panel(spark, sf_dir)
    return p.agg(r6(F.regr_slope("avg_price", "qty")).alias("slope"), r6(F.regr_intercept("avg_price", "qty")).alias("intercept"),
                 r6(F.regr_r2("avg_price", "qty")).alias("r2"), F.regr_count("avg_price", "qty").cast("long").alias("n"))


# ---------------------------------------------------------------- models (rows-only)
@register("assemble_features", with_views(["ml_frame"], """
SELECT id, label, CAST(i - 1 AS INT) AS pos, round(CAST(list_concat(emb, [x1, x2])[i] AS DOUBLE), 6) AS value
FROM ml_frame, LATERAL (SELECT unnest(range(1, len(emb) + 3)) AS i)"""))
def q_assemble_features(spark, sf_dir):
    """Text-side vector (embedding) and numeric columns attached by key."""
    ml = _ml(spark, sf_dir)
    num = ml.select("id", "x1", "x2")
    j = match.attach_by_key(ml.select("id", "emb", "label"), num, ["id"])
    v = FT.assemble_features(j, ["emb", "x1", "x2"])
    return (v.select("id", "label", F.posexplode(vector_to_array("features")).alias("pos", "value"))
             .withColumn("value", r6("value")))


@register("polynomial_features", with_views(["ml_frame"], """
SELECT id, round(x1, 6) AS p1, round(x1 * x1, 6) AS p2, round(x2, 6) AS p3, round(x1 * x2, 6) AS p4, round(x2 * x2, 6) AS p5 FROM ml_frame"""))
def q_polynomial_features(spark, sf_dir):
    v = FT.assemble_features(_ml(spark, sf_dir), ["x1", "x2"], "xy")
    out = MD.polynomial_features(v, "xy", 2)
    a = vector_to_array("poly")
    return out.select("id", *[r6(a[i]).alias(f"p{i + 1}") for i in range(5)])


@register("pca")
def q_pca(spark, sf_dir):
    out = MD.pca(_vec(spark, sf_dir), "features", 2)
    arr = vector_to_array("pca")
    return out.select("id", arr[0].alias("pc1"), arr[1].alias("pc2"))


def _split(spark, sf_dir):
    v = FT.train_test_split(_vec(spark, sf_dir), "id", 0.2, 0)
    return v.filter(~F.col("is_test")), v.filter(F.col("is_test"))


def _score(pred, name):
    m = M.classification_metrics(pred.select(F.col("label").cast("long").alias("label"),
                                             F.col("prediction").cast("long").alias("prediction")))
    return m.select(F.lit(name).alias("model"), "accuracy", "f1_macro")


@register("bagged_rbf_svm")
def q_bagged_rbf_svm(spark, sf_dir):
    """5 RBF SVMs on 1/5 bootstraps (random-Fourier approximation), vote."""
    tr, te = _split(spark, sf_dir)
    pred = MD.bagged_rbf_svm(tr, te, "emb", N_EMB)
    return _score(pred, "bagged_rbf_svm")


@register("rbf_svm")
def q_rbf_svm(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return _score(MD.rbf_svm(tr, te, "emb", N_EMB, gamma=1.0 / N_EMB, c=1.0), "rbf_svm")


@register("complement_nb")
def q_complement_nb(spark, sf_dir):
    # complement NB needs non-negative inputs; the scaler learns from the training rows alone
    tr, te = _split(spark, sf_dir)
    return _score(MD.scaled(MD.complement_nb("nn")).fit(tr).transform(te), "complement_nb")


@register("random_forest")
def q_random_forest(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return _score(MD.random_forest().fit(tr).transform(te), "random_forest")


@register("logistic")
def q_logistic(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return _score(MD.logistic(1.0, tr.count()).fit(tr).transform(te), "logistic")


@register("ridge")
def q_ridge(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    # the target x1 is the first coordinate, so it is taken out of the features
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rest = lambda d: d.withColumn("features", array_to_vector(F.expr("slice(_a, 2, size(_a) - 1)")))
    tr, te = (rest(d.withColumn("_a", vector_to_array("features"))) for d in (tr, te))
    pred = MD.ridge(1.0, tr.count(), label="x1").fit(tr).transform(te)
    return M.rmse(pred, "x1", "prediction").select(F.lit("ridge").alias("model"), "rmse")


@register("ols_summary")
def q_ols_summary(spark, sf_dir):
    """Coefficients, standard errors, t and p with a constant."""
    return MD.ols_summary(A.panel(spark, sf_dir), "avg_price", ["qty", "revenue"])


@register("grid_search")
def q_grid_search(spark, sf_dir):
    v = FT.stratified_folds(_vec(spark, sf_dir), "id", "label", 5, 0).persist()
    est = MD.logistic(1.0, 1).setMaxIter(25)
    cv = MD.grid_search(v, est, {est.regParam: [0.01, 0.1, 1.0]})
    rows = [(float(p[est.regParam]), float(m)) for p, m in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return spark.createDataFrame(rows, "reg_param DOUBLE, mean_accuracy DOUBLE")


_NB_CV_SQL = """
WITH pts AS (SELECT id, label, unnest(range(0, len(emb))) AS feature, CAST(unnest(emb) AS DOUBLE) AS value FROM ml_frame),
folds AS (SELECT id, label, CAST(s AS INTEGER) AS seed,
                 CAST((row_number() OVER (PARTITION BY s, label ORDER BY md5(CAST(id AS VARCHAR) || '|' || CAST(s AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold
          FROM ml_frame, range(0, 30) r(s)),
x AS (SELECT f.seed, f.fold, p.* FROM folds f JOIN pts p USING (id)),
held AS (SELECT x.*, h AS held FROM x, range(0, 5) r(h) WHERE x.fold <> h),
rng AS (SELECT seed, held, feature, min(value) AS lo, max(value) AS hi FROM held GROUP BY ALL),
cs AS (SELECT seed, held, feature, label, sum(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END) AS s
       FROM held JOIN rng USING (seed, held, feature) GROUP BY ALL),
alls AS (SELECT seed, held, feature, sum(s) AS s FROM cs GROUP BY ALL),
comp AS (SELECT a.seed, a.held, a.feature, l.label, a.s - coalesce(c.s, 0) + 1.0 AS c
         FROM alls a JOIN (SELECT DISTINCT label FROM ml_frame) l ON true
         LEFT JOIN cs c ON c.seed = a.seed AND c.held = a.held AND c.feature = a.feature AND c.label = l.label),
w AS (SELECT seed, held, feature, label, ln(sum(c) OVER (PARTITION BY seed, held, label) / c) AS w FROM comp),
sc AS (SELECT x.seed, x.fold, x.id, x.label, w.label AS cls,
              sum(greatest(CASE WHEN hi = lo THEN 0.5 ELSE (x.value - lo) / (hi - lo) END, 0) * w.w) AS p
       FROM x JOIN rng ON rng.seed = x.seed AND rng.held = x.fold AND rng.feature = x.feature
              JOIN w ON w.seed = x.seed AND w.held = x.fold AND w.feature = x.feature GROUP BY ALL),
pred AS (SELECT seed, fold, id, label, cls FROM sc QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY p DESC, cls) = 1),
c AS (SELECT seed, fold, label AS cls FROM pred UNION SELECT seed, fold, cls FROM pred),
per AS (SELECT c.seed, c.fold, c.cls, count(*) FILTER (p.label = c.cls AND p.cls = c.cls) AS tp,
               count(*) FILTER (p.label = c.cls) AS nt, count(*) FILTER (p.cls = c.cls) AS np
        FROM c JOIN pred p ON p.seed = c.seed AND p.fold = c.fold GROUP BY ALL)
SELECT seed, fold, round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(2.0 * tp / (nt + np)), 6) AS f1_macro
FROM per GROUP BY seed, fold"""


def _points(df, col: str):
    """The entries of an array column as (id, feature, value), to be scaled."""
    return (df.select("id", F.posexplode(col).alias("feature", "value"))
              .select("id", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value"), F.lit(True).alias("scale")))


@register("repeated_cv", with_views(["ml_frame"], _NB_CV_SQL))
def q_repeated_cv(spark, sf_dir):
    """Complement NB on embeddings, min-max scaled inside the fold, 5 folds x 30 seeds."""
    ml = _ml(spark, sf_dir)
    out = NB.repeated_nb_cv(_points(ml, "emb"), ml.select("id", "label"))
    return out.select("seed", "fold", r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"))


@register("ml_stages", with_views(["ml_frame"], """
WITH x AS (SELECT label, unnest(['x1', 'x2', 'x3']) AS feature, unnest([x1, x2, x3]) AS v FROM ml_frame),
r AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM x GROUP BY feature),
s AS (SELECT label, feature, sum((v - lo) / (hi - lo)) AS s FROM x JOIN r USING (feature) GROUP BY ALL),
c AS (SELECT l.label, t.feature, t.s - o.s + 1.0 AS c FROM (SELECT DISTINCT label FROM ml_frame) l, (SELECT feature, sum(s) AS s FROM s GROUP BY feature) t
      JOIN s o ON o.feature = t.feature WHERE o.label = l.label)
SELECT 1 AS stage, 'min' AS name, feature, round(lo, 6) AS value FROM r
UNION ALL SELECT 1, 'max', feature, round(hi, 6) FROM r
UNION ALL SELECT 2, 'class ' || label, feature, round(ln(sum(c) OVER (PARTITION BY label) / c), 6) FROM c"""))
def q_ml_stages(spark, sf_dir):
    """What a fitted Pipeline learned."""
    inputs = ["x1", "x2", "x3"]
    model = MD.ml_stages(_ml(spark, sf_dir), inputs)
    return MD.fitted_values(model, inputs, spark).withColumn("value", r6("value"))


# ---------------------------------------------------------------- end-to-end experiment
def _experiment(spark, sf_dir, placebo: bool = False, distance: bool = False, weights: bool = True, hashes: bool = False):
    """Every resolved filing with its panel features (qty, revenue), TF-IDF weights, next-quarter
    class and, with ``distance``, its note distance, as (data, points of the numbers, packed documents of the text).

    ``placebo``: a filing carries the weights of the conversation turn at its position
    instead of its own note's (J22).  Without ``weights`` the text itself is given, beside its row's label: ``(id, label, text)``."""
    from ..functions import periods as P
    from ..functions import text as X
    from ..operators import buckets as B
    from ..operators import tfidf
    from ..session import materialize
    from ..operators import clean, revisions
    from .q_filings import has_note, note_change, valid_notes, with_quarter

    panel = A.panel(spark, sf_dir)
    lab = B.bucket_by_entity(panel, "avg_price", out="label")
    target = match.attach_next_period_target(lab.select("symbol", "period", "qty", "revenue", "label"), ["label"],
                                             features=["qty", "revenue"], cast="long")
    # revisions are resolved and targets joined on keys alone; the texts are attached to what is left.  Where a
    # receipt number stands twice, its rows cannot be told apart by it, and the texts go along
    keys = materialize(has_note(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_no", "rcp_dt", "dic_cls"), "filing_keys")
    alone = not revisions.find_duplicate_keys(keys, ["rcp_no"]).limit(1).count()
    v = with_quarter(revisions.resolve_revisions(keys)).filter(F.col("quarter").isNotNull()) if alone else valid_notes(spark, sf_dir)
    data = v.select("rcp_no", "period", P.symbol_key("crp_cd").alias("symbol"), *([] if alone else ["foot_note"])).join(target, ["symbol", "period"])
    if distance:  # filings without a prior one have no distance and are left out
        data = data.join(note_change(spark, sf_dir).select("rcp_no", "dist_q").na.drop(), "rcp_no")
    data = data.select("rcp_no", "label_next", "qty", "revenue", *(["dist_q"] if distance else []), *([] if alone else ["foot_note"]))
    note = lambda d, id_col: d.select(F.col(id_col).alias("id"), "label", X.normalize_note("foot_note").alias("text"))
    data = materialize(data.withColumnsRenamed({"rcp_no": "id", "label_next": "label"}), "experiment_input")  # read by the folds and the points, and for its texts
    if alone:
        # a text is fetched where it is split into words, and leaves its task only as counts
        source = note(clean.prefer_consolidated(clean.split_missing_notes(A.filings(spark, sf_dir, data.select(F.col("id").alias("rcp_no"), "label")))[1]), "rcp_no")
    else:
        source, data = note(data, "id"), data.drop("foot_note")
    if placebo:
        key = F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 20, "0"), F.lpad(F.col("turn").cast("string"), 10, "0"))
        other = table(spark, sf_dir, "conversations").select(key.alias("key"), "text")
        pair = materialize(FT.align_by_position(data.select("id"), "id", other, "key"), "placebo_pairs")
        source = pair.select("id", "text")
        data = data.join(pair.select("id"), "id", "left_semi")
    text = source
    if weights:
        # ``hashes``: terms are known by the hash that directions are drawn from
        own = {"tokens": X.tokenize("text")} if hashes else {"words": F.col("text")}
        text = tfidf.packed_vectors(source, "id", merge=True, **own)
    numbers = lambda cols: data.select("id", F.explode(F.array(*(
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols))).alias("f")).select(
        "id", F.concat(F.lit("#"), F.col("f.feature")).alias("feature"), "f.value", F.lit(True).alias("scale"))
    return data, numbers, text


@register("text_signal_experiment")
def q_text_signal_experiment(spark, sf_dir):
    """Does the note change help to predict next quarter's company bucket?  Every filing with a prior one, with
    panel features and its note distance, target the bucket (G1) of the next calendar quarter (E4), scaling
    inside the fold, complement NB, 5 folds x 30 seeds (J18), then the one-sided test of the
    accuracies per seed (K8)."""
    from ..operators import stats as S
    data, numbers, _ = _experiment(spark, sf_dir, distance=True, weights=False)
    rows = None
    for variant, cols in (("numeric", ["qty", "revenue"]), ("text", ["qty", "revenue", "dist_q"])):
        res = NB.repeated_nb_cv(numbers(cols), data.select("id", "label")).withColumn("variant", F.lit(variant))
        rows = res if rows is None else rows.unionByName(res)
    per_seed = rows.groupBy("variant", "seed").agg(F.avg("accuracy").alias("accuracy"))
    return S.compare_samples(per_seed, "accuracy", "variant", [("numeric", "text")])


def _with_text(spark, sf_dir, placebo: bool):
    data, numbers, text = _experiment(spark, sf_dir, placebo)
    return NB.repeated_nb_cv(numbers(["qty", "revenue"]), data.select("id", "label"), rows=text)


@register("nb_with_text")
def q_nb_with_text(spark, sf_dir):
    """TF-IDF vectors beside panel features (E8, J1): complement NB, 5 folds x 30 seeds."""
    return _with_text(spark, sf_dir, False)


@register("placebo_experiment")
def q_placebo_experiment(spark, sf_dir):
    """The same with another corpus' vectors attached by position."""
    return _with_text(spark, sf_dir, True)


@register("write_vectors", with_views(["ml_frame"], """
SELECT id, CAST(i - 1 AS INT) AS pos, round(CAST(emb[i] AS DOUBLE), 6) AS value
FROM ml_frame, LATERAL (SELECT unnest(range(1, len(emb) + 1)) AS i)"""))
def q_write_vectors(spark, sf_dir):
    """Feature vectors stored by key and read back."""
    from ..sources import io
    from .q_filings import _written
    path = io.write_vectors(_vec(spark, sf_dir), _written(spark, "vectors"), "id")
    return (io.read_vectors(spark, path).select("id", F.posexplode(vector_to_array("features")).alias("pos", "value"))
              .withColumn("value", r6("value")))
