"""Classifiers and their evaluation.

All fits of an evaluation - folds, sides, shares, databases, models - run
together: rows are written once with a cell (:mod:`.fits`), the logistic fits
share the passes of :mod:`.newton`, the tree fits those of :mod:`.trees`, and one
pass scores every row with every model that asks for it into one prediction
table ``(model, fold/group, y_true, y_pred, y_proba)``, over which every metric
is one grouped aggregation (:mod:`.metrics`).  Metrics read the number of rows per
value of that table (``n``); its rows are made where they are asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fits import FitTable, LogisticSpec, count_table, counted, fit_all, fit_table, predict_column, score_all, score_counts
from .metrics import binary_metrics, roc_auc
from .ranking import rank_within
from .splits import HOLDOUT_DATABASES, MIN_QUERIES, SEED, split_seen_pooled, split_status, split_within_group_stratified, \
    stratified_folds
from .trees import TreeSpec

LABEL = "label_binary"
_SCORED_DDL = "model string, fold int, y_true int, y_pred int, y_proba double"

# The reference's classifier set and its settings.
CLASSIFIERS: dict[str, LogisticSpec | TreeSpec] = {
    "Logistic Regression": LogisticSpec(penalty=1.0),
    "Random Forest": TreeSpec(forest=True, trees=200, some=True, seed=SEED),
    "Gradient Boosting": TreeSpec(forest=False, trees=200, depth=3, rate=0.1, seed=SEED),
    "XGBoost": TreeSpec(forest=False, trees=200, depth=6, rate=0.3, second_order=True, l2=1.0, min_curvature=1.0, seed=SEED),
}
#: M23's fixed model
fixed_logistic = LogisticSpec(penalty=1.0)


def named(job: Column | str, names: Sequence) -> Column:
    """The entry of ``names`` at the number in ``job``."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(job) + 1)


def as_predictions(scored: DataFrame, *columns: Column) -> DataFrame:
    return scored.select(*columns, F.col("_y").cast("int").alias("y_true"), (F.col("raw") > 0.5).cast("int").alias("y_pred"),
                         F.col("raw").alias("y_proba"))


def as_counts(rows: FitTable, wanted: Sequence[tuple], *columns: Column) -> DataFrame:
    """The prediction table as counts ``n``."""
    return as_predictions(score_counts(rows, wanted), *columns, F.col("n"))


def _fit_folds(rows: FitTable, folds: Mapping, models: Sequence[str]):
    """``(jobs, fitted models, seconds per fit)``: every model on every fold set
    of ``folds`` (name -> cells of its training rows)."""
    jobs = [(m, f) for m in models for f in folds]
    t0 = time.perf_counter()
    fitted = fit_all(rows, folds, [(f, CLASSIFIERS[m]) for m, f in jobs])
    return jobs, fitted, (time.perf_counter() - t0) / max(1, len(jobs))


def compare_classifiers(train: DataFrame, test: DataFrame, features: Sequence[str], models: Sequence[str] = tuple(CLASSIFIERS),
                        label: str = LABEL) -> DataFrame:
    """M5-M8: every model fitted on ``train``, ``test`` scored: metrics per model."""
    both = train.select(label, *features).withColumn("_t", F.lit(0)).unionByName(test.select(label, *features).withColumn("_t", F.lit(1)))
    rows = count_table(both, features, label, F.col("_t"))
    fitted = fit_all(rows, {"train": {0}}, [("train", CLASSIFIERS[m]) for m in models])
    scored = as_counts(rows, [(i, m, {1: "test"}) for i, m in enumerate(fitted)], named("job", models).alias("model")).checkpoint()
    return binary_metrics(scored, ["model"], weight="n").join(roc_auc(scored, ["model"], weight="n"), "model", "left")


def fit_classifier(train: DataFrame, features: Sequence[str], model_name: str, label: str = LABEL):
    """One fitted model on all rows."""
    rows = count_table(train, features, label, F.lit(0))
    return fit_all(rows, {"all": {0}}, [("all", CLASSIFIERS[model_name])])[0]


def cross_validate(table: DataFrame, features: Sequence[str], models: Sequence[str], k: int = 5,
                   label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """M9 + M11 + E17: stratified k folds (T6); every (model, fold) is fitted in
    the same jobs and scores both sides.  Returns (fold scores: model, fold,
    train_ and test_ f1, accuracy, precision, recall, roc_auc, fit_time_s,
    score_time_s, an equal share of the joint times;  out-of-fold scored
    rows).  No rows if a class is too small for two folds."""
    scores, scored = cross_validation(table, features, models, k, label)
    return scores, scored(models)


def cross_validation(table: DataFrame, features: Sequence[str], models: Sequence[str], k: int = 5,
                     label: str = LABEL) -> tuple[DataFrame, Callable[[Sequence[str]], DataFrame]]:
    """:func:`cross_validate` with the out-of-fold rows as a function of the
    models that are to score them."""
    folded = stratified_folds(table.select("question_id", label, *features), k=k, label_col=label)
    rows = fit_table(folded, features, label, F.col("fold"), ["question_id"])
    counts = counted(rows)
    ks = sorted(r[0] for r in counts.df.select("_cell").distinct().collect() if r[0] is not None)
    jobs, fitted, seconds = _fit_folds(counts, {f: {c for c in ks if c != f} for f in ks}, list(models))
    t0 = time.perf_counter()
    model, fold = named("job", [m for m, _ in jobs] or [""]).alias("model"), named("job", [int(f) for _, f in jobs] or [0]).alias("fold")
    if jobs:
        wanted = [(i, m, {c: "test" if c == f else "train" for c in ks}) for i, ((_, f), m) in enumerate(zip(jobs, fitted))]
        both = as_counts(counts, wanted, F.col("part").alias("_part"), model, fold)
    else:
        both = table.sparkSession.createDataFrame([], f"_part string, {_SCORED_DDL}, n long")

    def scored(some: Sequence[str]) -> DataFrame:
        held = [(i, m, {f: "test"}) for i, ((name, f), m) in enumerate(zip(jobs, fitted)) if name in some]
        if not held:
            return table.sparkSession.createDataFrame([], f"question_id {dict(table.dtypes)['question_id']}, {_SCORED_DDL}")
        return as_predictions(score_all(rows, held), F.col("question_id"), model, fold)

    both = both.checkpoint()      # scored once; the metrics read these counts
    scoring = (time.perf_counter() - t0) / max(1, len(jobs))
    key = ["model", "fold", "_part"]
    per = binary_metrics(both, key, weight="n").join(roc_auc(both, key, weight="n"), key, "left")
    names = ["f1", "accuracy", "precision", "recall", "roc_auc"]
    wide = per.groupBy("model", "fold").agg(*[F.max(F.when(F.col("_part") == p, F.col(c))).alias(f"{p}_{c}")
                                             for p in ("train", "test") for c in names])
    scores = wide.select("*", F.lit(seconds).alias("fit_time_s"), F.lit(scoring).alias("score_time_s")).orderBy("model", "fold")
    return scores, scored


def cv_summary(scores: DataFrame) -> DataFrame:
    """Per model mean and population std of the fold F1."""
    return scores.groupBy("model").agg(F.avg("test_f1").alias("f1_mean"), F.stddev_pop("test_f1").alias("f1_std"),
                                       F.avg("fit_time_s").alias("fit_time_s"))


def select_best(summary: DataFrame, model_order: Sequence[str]) -> DataFrame:
    """Highest mean CV F1; ties go to the earlier model."""
    order = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    w = Window.orderBy(F.desc("f1_mean"), order)  # one row per model
    return summary.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def logistic_per_db(table: DataFrame, features: Sequence[str], label: str = LABEL,
                    min_n: int = MIN_QUERIES) -> DataFrame:
    """Per database 80/20 (stratified when possible) with T9 status;
    logistic regression for the eligible ones, all in the same passes; f1,
    roc_auc, accuracy rounded to 6, slow percentage rounded half-even."""
    spark = table.sparkSession
    split = split_within_group_stratified(table.select("question_id", "db_id", label, *features), label_col=label).checkpoint()
    status = split_status(split, label_col=label, min_n=min_n).checkpoint()
    ok = sorted(r[0] for r in status.where(F.col("status") == "ok").select("db_id").collect())      # one row per database
    if ok:
        numbers = spark.createDataFrame(list(enumerate(ok)), "_db int, db_id string")
        side = 2 * F.col("_db") + (F.col("split") == "test").cast("int")
        rows = count_table(split.join(numbers, "db_id"), features, label, side)
        fitted = fit_all(rows, {i: {2 * i} for i in range(len(ok))}, [(i, CLASSIFIERS["Logistic Regression"]) for i in range(len(ok))])
        scored = as_counts(rows, [(i, m, {2 * i + 1: "test"}) for i, m in enumerate(fitted)], named("job", ok).alias("db_id")).checkpoint()
        m = binary_metrics(scored, ["db_id"], weight="n").join(roc_auc(scored, ["db_id"], weight="n"), "db_id", "left")
        m = m.select("db_id", F.round("f1", 6).alias("f1_slow"), F.round("roc_auc", 6).alias("roc_auc"),
                     F.round("accuracy", 6).alias("accuracy"))
    else:
        m = spark.createDataFrame([], "db_id string, f1_slow double, roc_auc double, accuracy double")
    return status.join(m, "db_id", "left").orderBy("db_id")


def predict_label(model, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("question_id",)) -> DataFrame:
    """Label, binary label and probability of 'slow' from a fitted model."""
    s = predict_column(df, features, list(keep), model)
    slow = F.col("raw") > 0.5
    return s.select(*keep, F.when(slow, "slow").otherwise("fast").alias("label"), slow.cast("int").alias("label_binary"),
                    F.col("raw").alias("probability_slow"))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Share of the trees' gain or |coefficient|, largest first."""
    rows = list(zip(features, map(float, model.importance())))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def signed_coefficients(fit, features: Sequence[str], model: str = "Ridge(a=1)") -> DataFrame:
    """Signed coefficients of the (global) Ridge(1) fit, largest |w| first."""
    c = fit.coefficients.where(F.col("model") == model)
    ex = c.select(F.posexplode("coef").alias("pos", "coef"))
    names = F.array(*[F.lit(f) for f in features])
    return ex.select(F.element_at(names, F.col("pos") + 1).alias("feature"), "coef").orderBy(F.desc(F.abs("coef")))


_METRICS = ("f1", "roc_auc", "accuracy")
_GEOMETRY_DDL = ", ".join(["rows long", "fast_rows long", "slow_rows long"] + [
    f"{g}_{x}" for g in ("unseen", "seen") for x in ("train_rows long", "test_rows long", "best_model string",
                                                   *(f"{m} double" for m in _METRICS))])


def two_geometries(table: DataFrame, features: Sequence[str], models: Sequence[str] = tuple(CLASSIFIERS),
                   holdout: Sequence[str] = HOLDOUT_DATABASES, label: str = LABEL, k: int = 5,
                   factory: LogisticSpec | None = None) -> DataFrame:
    """Unseen-database (holdout) and seen-database (pooled per-db
    80/20) evaluation, one wide row.  On each side the model of ``models``
    with the best cross-validated F1 on that side's training rows (ties, and
    classes too small for folds: the earlier one) is fitted (M22); with ``factory``
    that fixed model is (M23).  The folds of both sides are fitted together,
    and so are the two chosen models.  The numbers of a side are
    null when its training or test rows are empty or the training rows have
    one class."""
    spark = table.sparkSession
    table = table.select(*dict.fromkeys(["question_id", "db_id", label, *features])).checkpoint()       # every split reads these rows
    held = F.col("db_id").isin(list(holdout))
    y = F.col(label)
    row = table.agg(F.count(F.lit(1)).alias("rows"), F.count_if(y == 0).alias("fast_rows"),
                    F.count_if(y == 1).alias("slow_rows")).first().asDict()
    splits = {"unseen": table.withColumn("split", F.when(held, "test").otherwise("train")),
              "seen": split_seen_pooled(table, label_col=label).checkpoint()}
    parts, choose = [], not factory and len(models) > 1
    for i, (side, split) in enumerate(splits.items()):
        sizes = {r["split"]: r for r in split.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.min(y).alias("a"), F.max(y).alias("b")).collect()}
        for part in ("train", "test"):
            row[f"{side}_{part}_rows"] = sizes[part]["n"] if part in sizes else 0
        if "test" not in sizes or "train" not in sizes or sizes["train"]["a"] == sizes["train"]["b"]:
            continue
        train = split.where(F.col("split") == "train").drop("split")
        train = stratified_folds(train, k=k, label_col=label) if choose else train.withColumn("fold", F.lit(None).cast("int"))
        # cells of a side: the test rows, rows without fold, the folds
        cell = lambda c, i=i: (F.lit(i * (k + 2)) + c).cast("int").alias("_c")
        parts.append((side, i * (k + 2), train.select(label, *features, cell(F.coalesce(F.col("fold") + 2, F.lit(1))))
                      .unionByName(split.where(F.col("split") == "test").select(label, *features, cell(F.lit(0))))))
    if parts:
        whole = parts[0][2]
        for _, _, p in parts[1:]:
            whole = whole.unionByName(p)
        # one fixed fit reads its rows as they are: moments of weighted rows round otherwise, which can part tied scores
        rows = (fit_table if factory else count_table)(whole, features, label, F.col("_c"))
        chosen = _chosen(rows, parts, list(models), k) if choose else {side: models[0] for side, _, _ in parts}
        specs = {side: factory or CLASSIFIERS[chosen[side]] for side, _, _ in parts}
        fitted = fit_all(rows, {side: set(range(at + 1, at + k + 2)) for side, at, _ in parts}, [(side, specs[side]) for side, _, _ in parts])
        wanted = [(i, m, {at: "test"}) for i, ((_, at, _), m) in enumerate(zip(parts, fitted))]
        one = as_counts(rows, wanted, named("job", [side for side, _, _ in parts]).alias("_g")).checkpoint()
        for m in binary_metrics(one, ["_g"], weight="n").join(roc_auc(one, ["_g"], weight="n"), "_g", "left").collect():       # one row per side
            row[f"{m['_g']}_best_model"] = "Logistic Regression" if factory else chosen[m["_g"]]
            for metric in _METRICS:
                row[f"{m['_g']}_{metric}"] = float(m[metric]) if m[metric] is not None else None
    names = [c.split(" ")[0] for c in _GEOMETRY_DDL.split(", ")]
    return spark.createDataFrame([tuple(row.get(c) for c in names)], _GEOMETRY_DDL)


def _chosen(rows: FitTable, parts: list, models: list[str], k: int) -> dict[str, str]:
    """Per side the model with the highest mean F1 over its folds."""
    present = {r[0] for r in rows.df.select("_cell").distinct().collect()}
    folds, tests = {}, {}
    for side, at, _ in parts:
        own = [c for c in range(at + 2, at + k + 2) if c in present]
        for c in own:
            folds[side, c], tests[side, c] = {d for d in own if d != c}, c
    if not folds:
        return {side: models[0] for side, _, _ in parts}
    jobs, fitted, _ = _fit_folds(rows, folds, models)
    wanted = [(i, m, {tests[f]: "test"}) for i, ((_, f), m) in enumerate(zip(jobs, fitted))]
    f1: dict = {}
    for r in binary_metrics(as_counts(rows, wanted, F.col("job")), ["job"], weight="n").collect():        # one row per fit
        m, (side, _) = jobs[r["job"]]
        f1.setdefault((side, m), []).append(r["f1"])
    return {side: max(models, key=lambda m: (float(np.mean(f1[side, m])) if (side, m) in f1 else 0.0, -models.index(m)))
            for side, _, _ in parts}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_ablation(table: DataFrame, global_cols: Sequence[str], tree_cols: Sequence[str],
                     min_rows: int = 20, label: str = LABEL, holdout: Sequence[str] = HOLDOUT_DATABASES) -> DataFrame:
    """Fixed logistic model on global-only vs tree+global vectors, both
    geometries; needs at least ``min_rows`` rows."""
    if table.count() < min_rows:
        raise ValueError(f"feature ablation needs at least {min_rows} rows")
    parts = {"global_only": list(global_cols), "tree_plus_global": [*tree_cols, *global_cols]}
    return _union([two_geometries(table, cols, holdout=holdout, label=label, factory=fixed_logistic).withColumn("variant", F.lit(name))
                   for name, cols in parts.items()])


def matched_manifest(table: DataFrame, planned_keys: DataFrame, key: str = "question_id") -> DataFrame:
    """M25 manifest: the labelled rows that have plans, with database and label."""
    return table.join(planned_keys.select(key).distinct(), key, "left_semi").select(key, "db_id", LABEL)


def fairness_control(table: DataFrame, planned_keys: DataFrame, features: Sequence[str], tree_features: Sequence[str] = (),
                     models: Sequence[str] = tuple(CLASSIFIERS), holdout: Sequence[str] = HOLDOUT_DATABASES,
                     key: str = "question_id", k: int = 5) -> DataFrame:
    """The text-feature evaluation restricted to rows that have plans
    (left-semi join on the key), with the CV choice and with the fixed
    logistic model, and the fixed model on tree features."""
    matched = table.join(planned_keys.select(key).distinct(), key, "left_semi")
    rows = [two_geometries(matched, features, models, holdout, k=k).withColumn("control", F.lit("text_best_model")),
            two_geometries(matched, features, holdout=holdout, factory=fixed_logistic).withColumn("control", F.lit("text_logistic"))]
    if tree_features:
        rows.append(two_geometries(matched, list(tree_features), holdout=holdout, factory=fixed_logistic)
                    .withColumn("control", F.lit("tree_logistic")))
    return _union(rows)


def learning_curve(table: DataFrame, features: Sequence[str], shares=(0.2, 0.4, 0.6, 0.8, 1.0), k: int = 3,
                   model_name: str = "Logistic Regression", label: str = LABEL) -> DataFrame:
    """Mean train-fold and validation F1 when fitting on the first
    share of each training fold (md5 order).  A row carries, for every fold it
    trains, the first share that holds it; all shares and folds are fitted
    together."""
    keyed = table.select("question_id", label, *features).withColumn(
        "_h", F.md5(F.concat(F.col("question_id").cast("string"), F.lit("|"), F.lit(str(SEED)))))
    folded = stratified_folds(keyed, k=k, label_col=label).where(F.col("fold").isNotNull()).checkpoint()
    size = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    ks, total = sorted(size), sum(size.values())
    cutoffs = {f: [max(2, int(round(s * (total - size[f])))) for s in shares] for f in ks}
    # position among the rows outside fold f: position among all minus those of f before
    marked = folded.select("*", *[(F.col("fold") == f).cast("long").alias(f"_in{f}") for f in ks])
    ranked = rank_within(marked, [], [F.col("_h").asc()], sums=[f"_in{f}" for f in ks])
    base, cell = len(shares) + 1, F.col("fold")
    for i, f in enumerate(ks):
        at = F.col("_rn") - F.col(f"_cum__in{f}")
        first = F.lit(0)
        for c in cutoffs[f]:
            first = first + (at >= c).cast("int")          # shares that do not hold the row yet
        cell = cell + F.when(F.col("fold") == f, 0).otherwise(first) * (k * base ** i)
    rows = count_table(ranked, features, label, cell)
    cells = [r[0] for r in rows.df.select("_cell").distinct().collect()]
    jobs = [(s, f) for s in range(len(shares)) for f in ks]
    fits = {(s, f): {c for c in cells if c % k != f and c // (k * base ** i) % base <= s}
            for s in range(len(shares)) for i, f in enumerate(ks)}
    fitted = fit_all(rows, fits, [(j, CLASSIFIERS[model_name]) for j in jobs])
    wanted = [(i, m, {c: "train" for c in fits[j]} | {c: "validation" for c in cells if c % k == j[1]})
              for i, (j, m) in enumerate(zip(jobs, fitted))]
    scored = as_counts(rows, wanted, F.col("job"), F.col("part"), named("job", [float(shares[s]) for s, _ in jobs]).alias("share"),
                       named("job", [cutoffs[f][s] for s, f in jobs]).alias("train_rows"))
    m = binary_metrics(scored, ["share", "job", "part", "train_rows"], weight="n")
    return m.groupBy("share", "part").agg(F.avg("train_rows").alias("train_rows"), F.avg("f1").alias("f1")).orderBy("share", "part")
