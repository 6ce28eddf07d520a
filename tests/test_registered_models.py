"""Which models the registered classifier queries let compete."""

import inspect

import pytest

from querylens import registry
from querylens.checks import common, q_classifiers
from querylens.operators import models as mo

from .conftest import SMALL

registry.load_all()


@pytest.fixture
def evaluated(spark, monkeypatch):
    """(models, folds) of every two-geometry evaluation, or "fixed"; nothing
    is fitted and no plan features are computed."""
    seen, signature = [], inspect.signature(mo.two_geometries)

    def record(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        a = call.arguments
        seen.append("fixed" if a["factory"] else (tuple(a["models"]), a["k"]))
        return spark.createDataFrame([(len(seen),)], "evaluation int")

    monkeypatch.setattr(mo, "two_geometries", record)
    monkeypatch.setattr(q_classifiers, "_with_plans", q_classifiers._table)
    monkeypatch.setattr(common, "_SHARED", {})      # no other query sees these results
    return seen


ALL = (tuple(mo.CLASSIFIERS), 5)


def test_all_classifiers_compete_in_five_folds(spark, evaluated):
    registry.QUERIES["m22_two_geometries"](spark, SMALL)
    assert evaluated == [ALL]
    registry.QUERIES["m25_fairness_control"](spark, SMALL)
    assert evaluated[1:] == [ALL, "fixed", "fixed"]


def test_text_tables_choose_and_the_log_is_evaluated_once(spark, evaluated):
    sizes = registry.QUERIES["m26_size_match_control"](spark, SMALL)
    assert evaluated == [ALL, ALL, "fixed"]
    assert {r.variant: r.evaluation for r in sizes.collect()} == {"full": 1, "downsampled": 2, "tree": 3}
    versions = registry.QUERIES["m27_compare_snapshots"](spark, SMALL)
    assert evaluated[3:] == [ALL]
    assert {r.version: r.evaluation for r in versions.collect()} == {"query_log": 1, "run_log_median": 4}


def test_learning_curve_is_the_selected_models(spark, monkeypatch):
    scores = spark.createDataFrame([(m, f, 0.9 if m == "Gradient Boosting" else 0.5, 1.0) for m in mo.CLASSIFIERS for f in range(5)],
                                   "model string, fold int, test_f1 double, fit_time_s double")
    monkeypatch.setattr(q_classifiers, "_cv", lambda spark, sf: (scores, None))
    drawn = inspect.signature(mo.learning_curve)
    monkeypatch.setattr(mo, "learning_curve", lambda *a, **k: drawn.bind(*a, **k).arguments.get("model_name"))
    assert registry.QUERIES["m28_learning_curve"](spark, SMALL) == "Gradient Boosting"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_refit_reads_rows_by_a_filter(spark, monkeypatch):
    from pyspark.sql import functions as F

    from querylens.operators import regression as rg
    seen, fit = [], rg.fit_linear_models
    monkeypatch.setattr(rg, "fit_linear_models", lambda train, *a: seen.append(train) or fit(train, *a))
    rows = spark.range(120).select(F.when(F.col("id") % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit("d"), (F.col("id") % 4).cast("string"))).alias("db_id"),
                                   (F.col("id") * 0.5).alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    best = spark.createDataFrame([("d0", "Ridge(a=1)", 0.5), ("d1", "GBM", 0.4), ("d2", "Lasso", 0.3), ("d9", "Lasso", 0.1)], "db_id string, model string, r2_log double")
    coef, manifest = rg.refit_all(rows, best, ["x"], "y")
    assert "Join" not in _plan(seen[0]) and {r[0] for r in seen[0].select("db_id").distinct().collect()} == {"d0", "d2"}
    assert sorted((r["db_id"], r["model"], r["n_train"]) for r in coef.coefficients.collect()) == [("d0", "Ridge(a=1)", 30), ("d2", "Lasso", 30)]
    assert sorted((r["db_id"], r["kind"], r["n_train"]) for r in manifest.collect()) == [("d0", "linear", 30), ("d1", "tree", 30), ("d2", "linear", 30)]


def test_snapshots_bring_the_runs_together_once(spark, monkeypatch):
    from querylens.checks import q_classifiers as qc
    seen = []

    def stop(log, stats):
        seen.append(log)
        raise InterruptedError

    monkeypatch.setattr(qc.rg, "training_table", stop)
    with pytest.raises(InterruptedError):
        qc._m27(spark, SMALL)
    assert "Aggregate" not in _plan(seen[0]) and "Join" not in _plan(seen[0])
    assert seen[0].columns == ["question_id", "db_id", "difficulty", "sql", "runtime_s"] and seen[0].count() > 0
