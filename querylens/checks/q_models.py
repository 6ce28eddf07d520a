"""Linear-model and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import linear as li
from ..operators import metrics as me
from ..operators import regression as rg
from ..registry import register
from ..sources import fixtures as fx
from .common import d6, r6, shared, with_ctes

_HOLD = ["db_3", "db_7"]


def _stats(spark, sf):
    return ca.schema_stats(fx.catalog_tables(spark, sf))


def _table(spark, sf):
    return shared(spark, sf, "training_table", lambda: rg.training_table(
        fx.query_log(spark, sf), ca.schema_stats(fx.catalog_tables(spark, sf))).checkpoint())


_KEPT = [("q", "SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log"),
         ("kept", """SELECT question_id, db_id, CAST(length(sql) AS DOUBLE) AS x, ln(runtime_s) AS y FROM (
              SELECT l.*, CASE WHEN runtime_s >= p75 THEN 1 WHEN runtime_s <= p50 THEN 0 ELSE NULL END AS lb FROM query_log l, q)
              WHERE lb IS NOT NULL AND runtime_s > 0""")]


def _m1(spark, sf):
    t = _table(spark, sf).select("question_id", "db_id", "query_length")
    mom = li.feature_moments(t, ["query_length"], ["db_id"])
    z = li.standardize(t, ["query_length"], mom, ["db_id"])
    return z.select("question_id", r6("query_length").alias("z"))


register("m1_standardize", with_ctes(
    "SELECT question_id, " + d6("(x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END")
    + " AS z FROM kept WINDOW w AS (PARTITION BY db_id)", "query_log", extra=_KEPT))(_m1)


def _one(model):
    def q(spark, sf):
        t = _table(spark, sf)
        fit = li.fit_linear_models(t, ["query_length"], "log_runtime", ["db_id"], {model: li.LINEAR_MODELS[model]})
        c = fit.coefficients
        return c.select("db_id", r6(F.element_at("coef", 1)).alias("slope"), r6("intercept").alias("intercept"))
    return q


register("m2_ols_one_feature", with_ctes(
    f"SELECT db_id, {d6('regr_slope(y, x)')} AS slope, {d6('regr_intercept(y, x)')} AS intercept FROM kept GROUP BY db_id",
    "query_log", extra=_KEPT))(_one("Linear"))

_RIDGE = ("(covar_pop(x, y) * count(*) / CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END) / (count(*) + 10.0)"
          " / CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END")
register("m3_ridge_one_feature", with_ctes(
    f"SELECT db_id, {d6(_RIDGE)} AS slope, {d6(f'avg(y) - ({_RIDGE}) * avg(x)')} AS intercept FROM kept GROUP BY db_id",
    "query_log", extra=_KEPT))(_one("Ridge(a=10)"))


def _coef_long(fit, features):
    c = fit.coefficients
    return c.select("db_id", "model", r6("intercept").alias("intercept"),
                    F.posexplode("coef").alias("pos", "w")).select(
        "db_id", "model", "intercept", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("pos") + 1).alias("feature"),
        r6("w").alias("w"))


register("m4_lasso_coefficients")(
    lambda spark, sf: _coef_long(li.fit_linear_models(_table(spark, sf), rg.FULL_FEATURES, "log_runtime", ["db_id"],
                                                      {"Lasso": li.LINEAR_MODELS["Lasso"]}), rg.FULL_FEATURES))

def per_db(spark, sf):
    """M12 with all five models, once per session."""
    return shared(spark, sf, "per_db", lambda: rg.regress_per_db(_table(spark, sf)).checkpoint())


def _refit(spark, sf):
    def build():
        fit, manifest = rg.refit_all(_table(spark, sf), rg.best_per_db(per_db(spark, sf)))
        return li.LinearFit(fit.coefficients.checkpoint()), manifest.checkpoint()
    return shared(spark, sf, "refit", build)


register("m12_regress_per_db")(per_db)
register("m13_best_per_db")(lambda spark, sf: rg.best_per_db(per_db(spark, sf)))
register("m14_refit_all")(lambda spark, sf: _refit(spark, sf)[1].drop("model_path"))
register("m14_linear_coefficients")(lambda spark, sf: _coef_long(_refit(spark, sf)[0], rg.FULL_FEATURES))


# the choice itself on a table of scores that SQL can compute too
def _scores(spark, sf):
    m = me.regression_metrics(fx.predictions(spark, sf).select(
        "db_id", "model", F.ln("runtime_s").alias("y"), F.ln("predicted_runtime_s").alias("p")), ["db_id", "model"], y_log="y", p_log="p")
    return m.select("db_id", "model", r6("r2_log").alias("r2_log"))


_ORDER = ["model_0", "model_1", "model_2", "model_3"]
_SCORES = f"""SELECT db_id, model, {d6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2_log
    FROM (SELECT db_id, model, ln(runtime_s) AS y, ln(predicted_runtime_s) AS p FROM predictions) GROUP BY db_id, model"""
_BEST = "SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY r2_log DESC, model) AS r FROM scores"
register("m13_best_of_scores", with_ctes("SELECT db_id, model, r2_log FROM best WHERE r = 1", "predictions",
                                         extra=[("scores", _SCORES), ("best", _BEST)]))(
    lambda spark, sf: rg.best_per_db(_scores(spark, sf), _ORDER))
register("r5_coverage_of_scores", with_ctes(
    f"""SELECT b.db_id, b.r2_log, {d6('s.cover')} AS index_coverage FROM best b JOIN (
          SELECT db_id, avg(CASE WHEN n_indexes > 0 THEN 1.0 ELSE 0.0 END) AS cover FROM catalog_tables GROUP BY db_id) s ON b.db_id = s.db_id
        WHERE r = 1""", "predictions", "catalog_tables", extra=[("scores", _SCORES), ("best", _BEST)]))(
    lambda spark, sf: rg.best_per_db(_scores(spark, sf), _ORDER).join(_stats(spark, sf), "db_id").select(
        "db_id", "r2_log", r6("schema_index_coverage").alias("index_coverage")))
register("m15_regress_holdout")(lambda spark, sf: rg.regress_holdout(_table(spark, sf), _HOLD)[0])
register("m16_regress_holdout_by_db")(lambda spark, sf: rg.regress_holdout(_table(spark, sf), _HOLD)[1])
register("m16_seen_baseline")(lambda spark, sf: rg.regress_seen_baseline(_table(spark, sf)))


def _m18(spark, sf):
    fit, manifest = _refit(spark, sf)
    h = fx.history(spark, sf).select(F.col("id").alias("question_id"), F.col("database").alias("db_id"),
                                     F.col("sql_text").alias("sql"), F.lit("unknown").alias("difficulty"))
    return rg.predict_runtime(h, _stats(spark, sf), fit, manifest)


register("m18_predict_runtime")(_m18)
