"""Classifiers and regressions on data with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylens.operators import linear as li
from querylens.operators import models as mo
from querylens.operators import regression as rg
from querylens.operators.trees import TreeSpec

FEATURES = ["x0", "x1"]


@pytest.fixture(scope="module")
def small_models():
    """The same operators with small forests."""
    keep_c, keep_t = dict(mo.CLASSIFIERS), dict(rg.TREE_MODELS)
    mo.CLASSIFIERS["Random Forest"] = TreeSpec(forest=True, trees=5, depth=4, some=True, seed=1)
    rg.TREE_MODELS.update({"RF": TreeSpec(forest=True, trees=3, depth=5, log=False, seed=1),
                           "GBM": TreeSpec(forest=False, trees=3, depth=3, rate=0.1, log=False, seed=1)})
    yield ["Logistic Regression", "Random Forest"]
    mo.CLASSIFIERS.update(keep_c)
    rg.TREE_MODELS.update(keep_t)


@pytest.fixture(scope="module")
def separable(spark):
    """Label 1 exactly where x0 > 0.5; five databases."""
    df = spark.range(400).select(
        F.col("id").alias("question_id"), F.concat(F.lit("db_"), (F.col("id") % 5).cast("string")).alias("db_id"),
        ((F.col("id") * 37 % 101) / 100.0).alias("x0"), ((F.col("id") * 53 % 97) / 97.0).alias("x1"))
    return df.withColumn("label_binary", (F.col("x0") > 0.5).cast("int")).cache()


def test_cross_validation_on_separable_data(separable, small_models):
    scores, oof = mo.cross_validate(separable, FEATURES, small_models, k=4)
    rows = scores.collect()
    assert {(r.model, r.fold) for r in rows} == {(m, f) for m in small_models for f in range(4)}
    assert all(r.test_f1 > 0.9 and r.train_f1 > 0.9 and r.test_roc_auc > 0.95 and r.train_accuracy > 0.9 for r in rows)
    assert all(r.fit_time_s > 0 and r.score_time_s > 0 for r in rows)
    # no leakage: every row is scored once per model, by a fit that did not see it
    per_model = oof.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("d")).collect()
    assert all(r.n == r.d == 400 for r in per_model)


def test_random_labels_do_not_leak(spark, small_models):
    noise = spark.range(300).select(F.col("id").alias("question_id"), F.lit("d").alias("db_id"),
                                    F.rand(1).alias("x0"), F.rand(2).alias("x1"), (F.rand(3) > 0.5).cast("int").alias("label_binary")).cache()
    scores, _ = mo.cross_validate(noise, FEATURES, ["Random Forest"], k=3)
    s = scores.agg(F.avg("test_roc_auc").alias("te"), F.avg("train_roc_auc").alias("tr")).first()
    assert abs(s.te - 0.5) < 0.15 < s.tr - 0.5


def test_selection_breaks_ties_by_order(spark):
    summary = spark.createDataFrame([("b", 0.8, 0.1, 1.0), ("a", 0.8, 0.2, 1.0), ("c", 0.7, 0.1, 1.0)],
                                    "model string, f1_mean double, f1_std double, fit_time_s double")
    assert mo.select_best(summary, ["a", "b", "c"]).first()["model"] == "a"
    assert mo.select_best(summary, ["b", "a", "c"]).first()["model"] == "b"
    best = rg.best_per_db(spark.createDataFrame([("d", "Lasso", 0.5), ("d", "RF", 0.5), ("e", "GBM", 0.1)], "db_id string, model string, r2_log double"))
    assert {r.db_id: r.model for r in best.collect()} == {"d": "Lasso", "e": "GBM"}


def test_two_geometries(separable, small_models):
    r = mo.two_geometries(separable, FEATURES, small_models, holdout=["db_1"], k=3).first()
    assert (r.rows, r.unseen_test_rows, r.unseen_train_rows) == (400, 80, 320) and r.seen_train_rows + r.seen_test_rows == 400
    assert r.unseen_best_model in small_models and r.seen_best_model in small_models
    assert min(r.unseen_f1, r.seen_f1, r.unseen_roc_auc, r.seen_roc_auc) > 0.9


def test_geometry_without_test_rows_is_null(separable):
    r = mo.two_geometries(separable, FEATURES, holdout=["absent"], factory=mo.fixed_logistic).first()
    assert r.unseen_f1 is None and r.unseen_best_model is None and r.unseen_test_rows == 0 and r.seen_f1 > 0.9


def test_geometry_of_one_class(separable):
    r = mo.two_geometries(separable.withColumn("label_binary", F.lit(1)), FEATURES, holdout=["db_1"], factory=mo.fixed_logistic).first()
    assert r.unseen_f1 is None and r.seen_f1 is None and r.slow_rows == 400


def test_real_errors_are_raised(separable):
    with pytest.raises(Exception):
        mo.two_geometries(separable, ["x0", "missing"], holdout=["db_1"], factory=mo.fixed_logistic)


def test_learning_curve(separable):
    rows = mo.learning_curve(separable, FEATURES, shares=(0.4, 1.0), k=2).collect()
    assert [(r.share, r.part) for r in rows] == [(0.4, "train"), (0.4, "validation"), (1.0, "train"), (1.0, "validation")]
    assert rows[0].train_rows == pytest.approx(80, abs=1) and rows[2].train_rows == pytest.approx(200, abs=1)
    assert all(r.f1 > 0.85 for r in rows)


def test_fairness_control(separable, small_models):
    planned = separable.where("question_id % 2 = 0").select("question_id")
    rows = {r.control: r for r in mo.fairness_control(separable, planned, FEATURES, ["x0"], small_models, ["db_1"], k=2).collect()}
    assert set(rows) == {"text_best_model", "text_logistic", "tree_logistic"} and all(r.rows == 200 for r in rows.values())
    assert mo.matched_manifest(separable, planned).count() == 200


# ---- regression -----------------------------------------------------------------

def runtimes(spark, n=200):
    df = spark.range(n).select(
        F.col("id").alias("question_id"), F.concat(F.lit("db_"), (F.col("id") % 4).cast("string")).alias("db_id"),
        ((F.col("id") * 37 % 101) / 100.0).alias("x0"), ((F.col("id") * 53 % 97) / 97.0).alias("x1"), F.lit(0).alias("label_binary"),
        F.lit(10.0).alias("schema_total_rows"), F.lit(5.0).alias("schema_max_table_rows"), F.lit(0.5).alias("schema_index_coverage"))
    return df.withColumn("log_runtime", 2 * F.col("x0") - 3 * F.col("x1") + F.when(F.col("db_id") == "db_0", 1.0).otherwise(0.0))


COLUMNS = ["x0", "x1", "schema_total_rows", "schema_max_table_rows", "schema_index_coverage"]


def test_groups_are_solved_like_lstsq(spark):
    df = runtimes(spark)
    fit = {(r.db_id, r.model): r for r in li.fit_linear_models(df, FEATURES, "log_runtime", ["db_id"]).coefficients.collect()}
    assert len(fit) == 4 * len(li.LINEAR_MODELS)
    for db in ("db_0", "db_3"):
        rows = df.where(F.col("db_id") == db).collect()
        a = np.array([[1.0, r.x0, r.x1] for r in rows])
        want = np.linalg.lstsq(a, np.array([r.log_runtime for r in rows]), rcond=None)[0]
        r = fit[db, "Linear"]
        assert [r.intercept, *r.coef] == pytest.approx(want) and r.n_train == len(rows)
    whole = li.fit_linear_models(df, FEATURES, "log_runtime", models={"Linear": ("ols", 0.0)}).coefficients.collect()
    assert len(whole) == 1 and whole[0].n_train == 200
    assert li.fit_linear_models(df.limit(0), FEATURES, "log_runtime", ["db_id"]).coefficients.count() == 0


def test_constant_target(spark):
    df = runtimes(spark).withColumn("log_runtime", F.lit(1.5))
    for r in li.fit_linear_models(df, FEATURES, "log_runtime", ["db_id"]).coefficients.collect():
        assert r.intercept == pytest.approx(1.5) and r.coef == pytest.approx([0.0, 0.0], abs=1e-9)


def test_per_db_models_refit_and_prediction(spark, small_models):
    df = runtimes(spark).cache()
    results = rg.regress_per_db(df, COLUMNS)
    rows = results.collect()
    assert {(r.db_id, r.model) for r in rows} == {(f"db_{i}", m) for i in range(4) for m in rg.PER_DB_MODELS}
    assert all(r.r2_log > 0.95 for r in rows if r.model == "Ridge(a=1)") and all(r.n == 50 and r.n_test == 10 for r in rows)
    # force a tree winner in one database and a database that is too small in another
    best = rg.best_per_db(results).withColumn("model", F.when(F.col("db_id") == "db_2", "RF").otherwise(F.col("model")))
    fit, manifest = rg.refit_all(df.where("db_id <> 'db_3' or question_id < 40"), best, COLUMNS)
    m = {r.db_id: r for r in manifest.collect()}
    assert set(m) == {"db_0", "db_1", "db_2"}          # 10 rows are under the gate of 15
    assert m["db_2"].kind == "tree" and m["db_2"].model_path and m["db_0"].kind == "linear"
    assert {r.db_id for r in fit.coefficients.select("db_id").collect()} == {"db_0", "db_1"}
    assert '"db_2"' in rg.manifest_json(manifest, COLUMNS)


def test_holdout(spark):
    overall, by_db = rg.regress_holdout(runtimes(spark), ["db_0"], FEATURES)
    assert overall.count() == len(li.LINEAR_MODELS) and {r.db_id for r in by_db.collect()} == {"db_0"}
    # db_0 is one higher than the databases it is predicted from
    assert {round(r.mae_log, 3) for r in overall.where("model = 'Linear'").collect()} == {1.0}
