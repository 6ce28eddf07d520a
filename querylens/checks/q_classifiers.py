"""Classifier queries (M5-M11, M17, M19-M28): property-checked, no SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sqltext import FEATURE_COLUMNS
from ..operators import catalog as ca
from ..operators import history as hi
from ..operators import linear as li
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import querylog as ql
from ..operators import regression as rg
from ..operators import splits as sp
from ..plans import plan_tree as pt
from ..registry import register
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from .common import d6, r6, shared, with_ctes

_HOLD = ["db_3", "db_7"]
_CV_MODELS = list(mo.CLASSIFIERS)


def _table(spark, sf):
    return shared(spark, sf, "training_table", lambda: rg.training_table(
        fx.query_log(spark, sf), ca.schema_stats(fx.catalog_tables(spark, sf))).checkpoint())


def _cv(spark, sf):
    def run():
        scores, scored = mo.cross_validation(_table(spark, sf), FEATURE_COLUMNS, _CV_MODELS)
        return scores.checkpoint(), scored      # the rows are made by the one query that returns them
    return shared(spark, sf, "cross_validation", run)


def _m9(spark, sf):
    return _cv(spark, sf)[0]


def _m10(spark, sf):
    scores, _ = _cv(spark, sf)
    return mo.select_best(mo.cv_summary(scores), _CV_MODELS)


def _m11(spark, sf):
    scores, scored = _cv(spark, sf)
    best = mo.select_best(mo.cv_summary(scores), _CV_MODELS).first()      # no row without folds
    return scored([best["model"]] if best else [])


register("m9_cross_validate")(_m9)
register("m10_select_best")(_m10)
register("m11_out_of_fold_proba")(_m11)

# the choice itself on the fold scores of the prediction table
_F1 = """SELECT model, avg(f1) AS m, stddev_pop(f1) AS s FROM (
    SELECT model, fold, CASE WHEN sum(CASE WHEN y_true = 1 OR y_pred = 1 THEN 1 ELSE 0 END) > 0 THEN
        2.0 * sum(y_true * y_pred) / (sum(y_true) + sum(y_pred)) ELSE 0 END AS f1 FROM predictions GROUP BY model, fold) GROUP BY model"""
register("m10_best_of_scores", with_ctes(
    f"SELECT model, {d6('m')} AS f1_mean, {d6('s')} AS f1_std FROM f1 ORDER BY f1_mean DESC, model LIMIT 1", "predictions", extra=[("f1", _F1)]))(
    lambda spark, sf: mo.select_best(
        mo.cv_summary(me.fold_scores(fx.predictions(spark, sf)).select("model", F.col("f1").alias("test_f1"), F.lit(0.0).alias("fit_time_s")))
        .withColumn("f1_mean", r6("f1_mean")), ["model_0", "model_1", "model_2", "model_3"])
    .select("model", "f1_mean", r6("f1_std").alias("f1_std")))
register("m17_logistic_per_db")(lambda spark, sf: mo.logistic_per_db(_table(spark, sf), FEATURE_COLUMNS))


def _m5_m19(spark, sf):
    t = _table(spark, sf)
    h = sp.split_holdout(t, _HOLD)
    model = mo.fit_classifier(h.where(F.col("split") == "train"), FEATURE_COLUMNS, "Random Forest")
    hist = fx.history(spark, sf).select(F.col("id").alias("question_id"), F.col("database").alias("db_id"),
                                        F.col("sql_text").alias("sql"), F.lit("unknown").alias("difficulty"))
    from ..functions.sqltext import add_parsed_features, fill_missing_features
    feats = fill_missing_features(add_parsed_features(hist), FEATURE_COLUMNS, keep=["question_id"])
    return mo.predict_label(model, feats, FEATURE_COLUMNS)


register("m19_predict_label")(_m5_m19)


def _m20(spark, sf):
    model = mo.fit_classifier(_table(spark, sf), FEATURE_COLUMNS, "Random Forest")
    return mo.feature_importance(model, FEATURE_COLUMNS, spark)


register("m20_feature_importance")(_m20)


def _m21(spark, sf):
    t = _table(spark, sf)
    fit = li.fit_linear_models(t, rg.FULL_FEATURES, "log_runtime", models={"Ridge(a=1)": li.LINEAR_MODELS["Ridge(a=1)"]})
    return mo.signed_coefficients(fit, rg.FULL_FEATURES)


register("m21_signed_coefficients")(_m21)


def _m22(spark, sf):
    return shared(spark, sf, "two_geometries", lambda: mo.two_geometries(_table(spark, sf), FEATURE_COLUMNS, holdout=_HOLD))


register("m22_two_geometries")(_m22)
register("m23_two_geometries_fixed_model")(
    lambda spark, sf: mo.two_geometries(_table(spark, sf), FEATURE_COLUMNS, holdout=_HOLD,
                                        factory=mo.fixed_logistic))


def _with_plans(spark, sf):
    t = _table(spark, sf)
    nodes = fx.plan_nodes(spark, sf)
    queries = fx.query_log(spark, sf).select(F.col("question_id").alias("query_id"), "sql")
    tm = pt.tree_mean(nodes, queries, fx.named_tables(spark, sf), fx.named_columns(spark, sf), fx.named_indexes(spark))
    gv = pt.global_vector(queries, fx.named_tables(spark, sf))
    keep = t.select("question_id", "db_id", "label_binary", *FEATURE_COLUMNS)
    return shared(spark, sf, "planned_table", lambda: keep.join(tm.withColumnRenamed("query_id", "question_id"), "question_id").join(
        gv.withColumnRenamed("query_id", "question_id"), "question_id").checkpoint())


_TREE = [f"t{i}" for i in range(pt.NODE_DIM)]
_GLOB = [f"g{i}" for i in range(pt.GLOBAL_DIM)]
register("m24_feature_ablation")(lambda spark, sf: mo.feature_ablation(_with_plans(spark, sf), _GLOB, _TREE, holdout=_HOLD))


def _planned(spark, sf):
    return fx.plan_nodes(spark, sf).select(F.col("query_id").alias("question_id"))


register("m25_fairness_control")(lambda spark, sf: mo.fairness_control(
    _with_plans(spark, sf), _planned(spark, sf), FEATURE_COLUMNS, _TREE, holdout=_HOLD))
register("m25_matched_manifest", with_ctes(
    """SELECT question_id, db_id, CASE WHEN runtime_s >= p75 THEN 1 ELSE 0 END AS label_binary
       FROM query_log, (SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log) q
       WHERE (runtime_s >= p75 OR runtime_s <= p50) AND runtime_s > 0 AND question_id IN (SELECT query_id FROM plan_nodes)""",
    "query_log", "plan_nodes"))(lambda spark, sf: mo.matched_manifest(_table(spark, sf), _planned(spark, sf)))


def _m26(spark, sf):
    """Full log and the log down-sampled to the number of planned rows, with
    the CV choice, and tree features on the planned rows with the fixed model."""
    planned = _with_plans(spark, sf)
    small = sp.downsample_stratified(_table(spark, sf), planned.count(), holdout=_HOLD)
    parts = {"full": _m22(spark, sf), "downsampled": mo.two_geometries(small, FEATURE_COLUMNS, holdout=_HOLD),
             "tree": mo.two_geometries(planned, _TREE, holdout=_HOLD, factory=mo.fixed_logistic)}
    return mo._union([d.withColumn("variant", F.lit(v)) for v, d in parts.items()])


register("m26_size_match_control")(_m26)


def _m27(spark, sf):
    log = fx.query_log(spark, sf)
    stats = ca.schema_stats(fx.catalog_tables(spark, sf))
    med = ql.median_runtime(fx.run_log(spark, sf)).join(log.select("question_id", "sql", "difficulty"), "question_id")
    v2 = hi.replace_subset(log, med, ["db_0", "db_1", "db_2", "db_3", "db_4", "db_5", "db_6", "db_7", "db_8", "db_9", "db_10"])
    # the runs are brought together once, not by every pass of the quantiles
    ensure_checkpoint_dir(spark)
    v2 = v2.select("question_id", "db_id", "difficulty", "sql", "runtime_s").checkpoint()
    medians = rg.training_table(v2, stats)
    versions = {"query_log": _m22(spark, sf), "run_log_median": mo.two_geometries(medians, FEATURE_COLUMNS, holdout=_HOLD)}
    return mo._union([d.withColumn("version", F.lit(v)) for v, d in versions.items()])


register("m27_compare_snapshots")(_m27)
register("m28_learning_curve")(lambda spark, sf: mo.learning_curve(
    _table(spark, sf), FEATURE_COLUMNS, model_name=_m10(spark, sf).first()["model"]))


def _m6_m8(spark, sf):
    """M5-M8: all four classifiers on the unseen-database split, one row per model."""
    h = sp.split_holdout(_table(spark, sf).select("question_id", "db_id", "label_binary", *FEATURE_COLUMNS), _HOLD)
    return mo.compare_classifiers(h.where(F.col("split") == "train"), h.where(F.col("split") == "test"), FEATURE_COLUMNS)


register("m6_m8_classifier_comparison")(_m6_m8)


def _r6(spark, sf):
    from ..operators import reports as rp
    return rp.top_features(_m20(spark, sf), 10)


register("r6_top_features")(_r6)


def _r5(spark, sf):
    from ..operators import reports as rp
    from .q_models import per_db
    best = rg.best_per_db(per_db(spark, sf))
    return rp.coverage_vs_r2(best, ca.schema_stats(fx.catalog_tables(spark, sf)))


register("r5_coverage_vs_r2")(_r5)


def _emb(spark, sf):
    """Gram path on a wide input: ridge on the 64 embedding components per label."""
    from ..sources.tables import read_table
    e = read_table(spark, sf, "embeddings")
    n = len(e.first()["embedding"])
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)]
    df = e.select("vec_id", (F.col("label") % 2).alias("grp"), F.col("label").cast("double").alias("y"), *cols)
    fit = li.fit_linear_models(df, [f"e{i}" for i in range(n)], "y", ["grp"], {"Ridge(a=1)": li.LINEAR_MODELS["Ridge(a=1)"]})
    return fit.coefficients.select("grp", "model", "intercept", F.size("coef").alias("n_coef"), "n_train")


register("m3_ridge_embeddings_wide")(_emb)
