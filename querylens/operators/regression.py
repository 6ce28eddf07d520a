"""Runtime regression per database and across databases.

Linear models come from the grouped Gram job of :mod:`.linear` (all
databases in one pass), tree models from :mod:`.trees`: all databases grow in
the same jobs, and one Arrow pass scores every row by its database's compiled
ensemble.  Metrics are one grouped aggregate over the scored test rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..functions.sqltext import FEATURE_COLUMNS, add_parsed_features, fill_missing_features
from .catalog import SCHEMA_FEATURES, join_catalog
from .fits import fit_all, fit_table, predict_by_key, score_all
from .labels import label_quantile, threshold_label
from .linear import LINEAR_MODELS, LinearFit, fit_linear_models, score_linear
from .metrics import regression_metrics
from .querylog import positive_runtime
from .splits import HOLDOUT_DATABASES, MIN_QUERIES, SEED, split_within_group
from .trees import Ensemble, TreeSpec

FULL_FEATURES = FEATURE_COLUMNS + SCHEMA_FEATURES
# Model order of the per-database comparison (ties keep this order).
PER_DB_MODELS = ["Ridge(a=1)", "Ridge(a=10)", "Lasso", "RF", "GBM"]
TREE_MODELS = {"RF": TreeSpec(forest=True, trees=100, log=False, seed=SEED),
               "GBM": TreeSpec(forest=False, trees=100, depth=3, rate=0.1, log=False, seed=SEED)}


def training_table(log: DataFrame, stats: DataFrame) -> DataFrame:
    """Labelled feature table: SQL features (nulls 0) + catalog statistics,
    quantile labels (mid dropped), positive runtimes and ``log_runtime``."""
    feats = add_parsed_features(log)
    keep = [c for c in log.columns]
    filled = fill_missing_features(feats, FEATURE_COLUMNS, keep=keep)
    joined = join_catalog(filled, stats)
    joined = joined.select(*[c for c in joined.columns if c not in SCHEMA_FEATURES],
                           *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SCHEMA_FEATURES])
    return positive_runtime(label_quantile(joined))


def _numbered(df: DataFrame) -> tuple[list, DataFrame]:
    """The databases in order and the rows with their number ``_db``."""
    dbs = sorted(r[0] for r in df.select("db_id").distinct().collect() if r[0] is not None)      # one row per database
    return dbs, df.join(df.sparkSession.createDataFrame(list(enumerate(dbs)), "_db int, db_id string"), "db_id")


def _tree_predictions(split: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``db_id, model, target, pred_log`` of the test rows by trees fitted on
    their database's training rows, all databases together."""
    dbs, numbered = _numbered(split.where(F.col("split") != "skipped"))
    rows = fit_table(numbered, features, target, 2 * F.col("_db") + (F.col("split") == "test").cast("int"), ["db_id"])
    sides = {r[0] for r in rows.df.select("_cell").distinct().collect()}
    jobs = [(i, m) for i in range(len(dbs)) if 2 * i in sides for m in TREE_MODELS]
    if not jobs:
        return split.sparkSession.createDataFrame([], f"db_id string, model string, `{target}` double, pred_log double")
    fitted = fit_all(rows, {i: {2 * i} for i, _ in jobs}, [(i, TREE_MODELS[m]) for i, m in jobs])
    scored = score_all(rows, [(n, model, {2 * i + 1: "test"}) for n, ((i, _), model) in enumerate(zip(jobs, fitted))])
    name = F.element_at(F.array(*[F.lit(m) for _, m in jobs]), F.col("job") + 1)
    return scored.select("db_id", name.alias("model"), F.col("_y").alias(target), F.col("raw").alias("pred_log")).checkpoint()


def regress_per_db(table: DataFrame, features: Sequence[str] = FULL_FEATURES, target: str = "log_runtime",
                   min_n: int = MIN_QUERIES, with_trees: bool = True) -> DataFrame:
    """Per database with at least ``min_n`` rows, an 80/20 split and
    five models; MAE / R2 on the log scale and in seconds (rounded 4, 4, 6,
    4), n, n_train, n_test, truncated slow percentage and catalog numbers."""
    cols0 = ["db_id", "question_id", target, "label_binary", *features]
    # materialised once: every per-database fit and the metrics read these rows
    split = split_within_group(table.select(*cols0), min_n=min_n).checkpoint()
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    lin = {k: v for k, v in LINEAR_MODELS.items() if k in PER_DB_MODELS}
    fit = fit_linear_models(train, features, target, ["db_id"], lin)
    cols = ["db_id", "question_id", target, *features]
    scored = score_linear(test.select(*cols), fit, features, ["db_id"]).select("db_id", "model", target, "pred_log")
    if with_trees:
        scored = scored.unionByName(_tree_predictions(split, features, target))
    m = regression_metrics(scored, ["db_id", "model"], y_log=target, p_log="pred_log")
    info = split.where(F.col("split") != "skipped").groupBy("db_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.floor(F.avg(F.col("label_binary").cast("double")) * 100).cast("long").alias("slow_pct"),
        F.first("schema_total_rows").cast("long").alias("total_rows"),
        F.first("schema_max_table_rows").cast("long").alias("max_table_rows"),
        F.first("schema_index_coverage").alias("index_coverage"))
    return info.join(m.drop("n"), "db_id").select(
        "db_id", "n", "n_train", "n_test", "slow_pct", "total_rows", "max_table_rows", "index_coverage", "model",
        F.round("mae_log", 4).alias("mae_log"), F.round("r2_log", 4).alias("r2_log"),
        F.round("mae_s", 6).alias("mae_s"), F.round("r2_s", 4).alias("r2_s"))


def best_per_db(results: DataFrame, model_order: Sequence[str] = PER_DB_MODELS) -> DataFrame:
    """The model with the highest ``r2_log`` per database; ties keep
    the model order."""
    order = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    w = Window.partitionBy("db_id").orderBy(F.desc("r2_log"), order)
    return results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def refit_all(table: DataFrame, best: DataFrame, features: Sequence[str] = FULL_FEATURES, target: str = "log_runtime",
              min_n: int = MIN_QUERIES, path: str | None = None) -> tuple[LinearFit, DataFrame]:
    """Refit each database's winning model on all its rows, for databases
    with at least ``min_n`` rows.  Linear winners go to the coefficient table;
    tree winners are fitted together and saved as compiled ensembles, one row
    per database of the Parquet table ``path`` (on the shared storage).
    Returns the coefficients and the manifest: db_id, model, kind, r2_log,
    n_train, target, n_features and model_path (null for linear models)."""
    spark = table.sparkSession
    rows = table.select("db_id", target, *features).checkpoint()
    sizes = rows.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_train")).where(F.col("n_train") >= min_n)
    won = best.select("db_id", "model", "r2_log").join(sizes, "db_id").checkpoint()
    linear = won.where(F.col("model").isin(list(LINEAR_MODELS)))
    winners = {r["db_id"]: r["model"] for r in won.collect()}      # one row per database
    trees = {db: m for db, m in winners.items() if m in TREE_MODELS}
    # a filter, not a join: the moments of all features stay in compiled code
    fit = fit_linear_models(rows.where(F.col("db_id").isin([db for db, m in winners.items() if m in LINEAR_MODELS])),
                            features, target, ["db_id"])
    coef = fit.coefficients.join(linear.select("db_id", "model"), ["db_id", "model"])
    folder = path or os.path.join(ensure_checkpoint_dir(spark), f"tree-models-{uuid.uuid4().hex[:8]}")
    paths = spark.createDataFrame([], "db_id string, model_path string")
    if trees:
        dbs, numbered = _numbered(rows.where(F.col("db_id").isin(list(trees))))
        own = fit_table(numbered, features, target, F.col("_db"))
        fitted = fit_all(own, {i: {i} for i in range(len(dbs))}, [(i, TREE_MODELS[trees[db]]) for i, db in enumerate(dbs)])
        spark.createDataFrame([(db, bytearray(m.to_bytes())) for db, m in zip(dbs, fitted)], "db_id string, ensemble binary").write.mode(
            "overwrite").parquet(folder)
        paths = spark.createDataFrame([(db, folder) for db in dbs], "db_id string, model_path string")
    kind = F.when(F.col("model").isin(list(TREE_MODELS)), "tree").otherwise("linear")
    manifest = won.join(paths, "db_id", "left").select(
        "db_id", "model", kind.alias("kind"), "r2_log", "n_train", F.lit(target).alias("target"),
        F.lit(len(features)).alias("n_features"), "model_path")
    return LinearFit(coef), manifest


def load_ensembles(manifest: DataFrame) -> dict[str, Ensemble]:
    """The compiled tree models that a manifest names, by database."""
    spark = manifest.sparkSession
    named = manifest.where(F.col("model_path").isNotNull()).select("db_id", "model_path").collect()      # one row per database
    out = {}
    for folder in sorted({r["model_path"] for r in named}):
        own = [r["db_id"] for r in named if r["model_path"] == folder]
        for r in spark.read.parquet(folder).where(F.col("db_id").isin(own)).collect():
            out[r["db_id"]] = Ensemble.from_bytes(bytes(r["ensemble"]))
    return out


def manifest_json(manifest: DataFrame, features: Sequence[str] = FULL_FEATURES) -> str:
    """The manifest as JSON text; it has one entry per database."""
    return json.dumps({"feature_order": list(features), "sql_features": FEATURE_COLUMNS, "schema_features": SCHEMA_FEATURES,
                       "databases": {r["db_id"]: {k: v for k, v in r.asDict().items() if k != "db_id"} for r in manifest.collect()}},
                      indent=2, sort_keys=True)


def regress_holdout(table: DataFrame, holdout: Sequence[str] = HOLDOUT_DATABASES,
                    features: Sequence[str] = FULL_FEATURES, target: str = "log_runtime") -> tuple[DataFrame, DataFrame]:
    """M15 + M16: train the four linear models on the other databases, test
    on the held-out ones; returns (overall metrics per model, metrics per
    model and held-out database)."""
    # materialised once: moments, Gram and scoring all read these rows
    table = table.select("db_id", "question_id", target, *features).checkpoint()
    test = table.where(F.col("db_id").isin(list(holdout)))
    train = table.where(~F.col("db_id").isin(list(holdout)))
    fit = fit_linear_models(train, features, target)
    scored = score_linear(test.select("db_id", "question_id", target, *features), fit, features)
    overall = regression_metrics(scored, ["model"], y_log=target, p_log="pred_log")
    by_db = regression_metrics(scored, ["model", "db_id"], y_log=target, p_log="pred_log")
    return overall, by_db


def regress_seen_baseline(table: DataFrame, features: Sequence[str] = FULL_FEATURES, target: str = "log_runtime",
                          model: str = "Ridge(a=1)") -> DataFrame:
    """M16 baseline: the same model trained on 80 % of every database
    (pooled) and tested on the remaining 20 %."""
    split = split_within_group(table.select("db_id", "question_id", target, *features), min_n=0).checkpoint()
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    fit = fit_linear_models(train, features, target, models={model: LINEAR_MODELS[model]})
    scored = score_linear(test.select("db_id", "question_id", target, *features), fit, features)
    return regression_metrics(scored, ["model"], y_log=target, p_log="pred_log")


def predict_runtime(queries: DataFrame, stats: DataFrame, fit: LinearFit, manifest: DataFrame | None = None,
                    features: Sequence[str] = FULL_FEATURES) -> DataFrame:
    """SQL features + catalog statistics -> log prediction of the
    database's stored model (coefficients, or the saved tree model named in
    ``manifest``) -> seconds, ms and the 50 ms label; a database without a
    model gets an error text and label 'unknown'."""
    feats = fill_missing_features(add_parsed_features(queries), FEATURE_COLUMNS, keep=queries.columns)
    joined = join_catalog(feats, stats)
    joined = joined.select(*[c for c in joined.columns if c not in SCHEMA_FEATURES],
                           *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SCHEMA_FEATURES])
    models = load_ensembles(manifest) if manifest is not None else {}
    rest = joined.where(F.col("db_id").isNull() | ~F.col("db_id").isin(list(models))) if models else joined
    j = rest.join(fit.coefficients.select("db_id", "intercept", "coef"), "db_id", "left")
    pred = F.col("intercept")
    for i, c in enumerate(features):
        pred = pred + F.element_at("coef", i + 1) * F.col(c).cast("double")
    scored = j.select(*queries.columns, F.when(F.col("coef").isNotNull(), pred).alias("_pred"))
    if models:      # one pass for all databases with trees
        by_tree = predict_by_key(joined, features, queries.columns, "db_id", models)
        scored = scored.unionByName(by_tree.select(*queries.columns, F.col("raw").alias("_pred")))
    has = F.col("_pred").isNotNull()
    secs = F.when(has, F.exp("_pred"))
    return scored.select(*queries.columns, secs.alias("predicted_runtime_s"), (secs * 1000).alias("predicted_ms"),
                         F.when(has, threshold_label(secs)).otherwise(F.lit("unknown")).alias("label"),
                         F.when(~has, F.concat(F.lit("no model for database "), F.col("db_id"))).alias("error"))
