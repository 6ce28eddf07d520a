"""Evaluation metrics as aggregations over a prediction table.

Input columns: ``y_true`` (0/1), ``y_pred`` (0/1), ``y_proba`` (score) and
any grouping columns.  Every metric works globally (``group_cols=()``) or
per group in one job.  Curve metrics first aggregate to distinct scores per
group (map-side partial aggregation), then take prefix sums with the
range-partitioned ranking, so neither a hot group nor a global order ends
up in one task.  Division by zero yields 0 (``zero_division=0``) or null
where the reference reports NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .ranking import exact_quantiles, rank_within


def safe_div(a: Column, b: Column, default=None) -> Column:
    d = F.lit(default) if default is not None else F.lit(None)
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(d.cast("double"))


def _count_if(cond: Column, weight: str | None) -> Column:
    """Rows with ``cond``; with ``weight`` a row stands for so many."""
    return F.count_if(cond) if weight is None else F.sum(F.when(cond, F.col(weight)).otherwise(0))


def _counts(y_true: str, y_pred: str, weight: str | None = None) -> list[Column]:
    t, p = F.col(y_true), F.col(y_pred)
    return [_count_if((t == 1) & (p == 1), weight).alias("tp"), _count_if((t == 0) & (p == 1), weight).alias("fp"),
            _count_if((t == 1) & (p == 0), weight).alias("fn"), _count_if((t == 0) & (p == 0), weight).alias("tn"),
            (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("support"), F.when(F.min(t) < F.max(t), 2).otherwise(1).alias("_n_classes")]


def confusion_matrix(df: DataFrame, group_cols: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Two rows per group (y_true 0 and 1) with counts ``pred_0``, ``pred_1``."""
    c = df.groupBy(*group_cols).agg(*_counts(y_true, y_pred)[:4])
    rows = F.array(F.struct(F.lit(0).alias("y_true"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
                   F.struct(F.lit(1).alias("y_true"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")))
    return c.select(*group_cols, F.inline(rows))


def confusion_normalised(df: DataFrame, group_cols: Sequence[str] = (), **kw) -> DataFrame:
    """Confusion matrix rows divided by their row total (null for an empty row)."""
    cm = confusion_matrix(df, group_cols, **kw)
    tot = F.col("pred_0") + F.col("pred_1")
    return cm.select(*group_cols, "y_true", safe_div(F.col("pred_0"), tot).alias("pred_0"),
                     safe_div(F.col("pred_1"), tot).alias("pred_1"))


def _metric_cols(safe: bool) -> list[Column]:
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "support"))
    m = {"accuracy": safe_div(tp + tn, n, 0.0), "precision": safe_div(tp, tp + fp, 0.0),
         "recall": safe_div(tp, tp + fn, 0.0), "f1": safe_div(2 * tp, 2 * tp + fp + fn, 0.0)}
    if safe:
        one_class = F.col("_n_classes") < 2
        m = {k: F.when(one_class, F.lit(None).cast("double")).otherwise(v) for k, v in m.items()}
    return [v.alias(k) for k, v in m.items()]


def binary_metrics(df: DataFrame, group_cols: Sequence[str] = (), safe: bool = False,
                   y_true="y_true", y_pred="y_pred", weight: str | None = None) -> DataFrame:
    """E3 (+E4 with ``safe``): support, accuracy, precision, recall, F1 per group.
    With ``weight`` a row stands for so many."""
    c = df.groupBy(*group_cols).agg(*_counts(y_true, y_pred, weight))
    return c.select(*group_cols, "support", *_metric_cols(safe))


def group_breakdown(df: DataFrame, by: str, **kw) -> DataFrame:
    """Per-group support and metrics, null when the group has one class."""
    return binary_metrics(df, [by], safe=True, **kw).orderBy(by)


def classification_report(df: DataFrame, group_cols: Sequence[str] = (), names=("fast", "slow"),
                          y_true="y_true", y_pred="y_pred") -> DataFrame:
    """E5: per class precision/recall/f1-score/support, then accuracy, macro
    and weighted averages (the accuracy row repeats the accuracy in every
    column, as the transposed report does)."""
    c = df.groupBy(*group_cols).agg(*_counts(y_true, y_pred)[:5])
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "support"))
    # class 1 metrics with tp/fp/fn; class 0 swaps roles: tp0 = tn, fp0 = fn, fn0 = fp
    p1, r1 = safe_div(tp, tp + fp, 0.0), safe_div(tp, tp + fn, 0.0)
    f1_1 = safe_div(2 * tp, 2 * tp + fp + fn, 0.0)
    p0, r0 = safe_div(tn, tn + fn, 0.0), safe_div(tn, tn + fp, 0.0)
    f1_0 = safe_div(2 * tn, 2 * tn + fn + fp, 0.0)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    acc = safe_div(tp + tn, n, 0.0)
    nd = n.cast("double")

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))

    rows = F.array(
        row(names[0], p0, r0, f1_0, s0), row(names[1], p1, r1, f1_1, s1),
        row("accuracy", acc, acc, acc, acc),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, nd),
        row("weighted avg", safe_div(p0 * s0 + p1 * s1, nd, 0.0), safe_div(r0 * s0 + r1 * s1, nd, 0.0),
            safe_div(f1_0 * s0 + f1_1 * s1, nd, 0.0), nd))
    return c.select(*group_cols, F.inline(rows))


def _score_table(df, group_cols, score, y_true, weight=None):
    return df.groupBy(*group_cols, score).agg(_count_if(F.col(y_true) == 1, weight).cast("double").alias("pos"),
                                              _count_if(F.col(y_true) == 0, weight).cast("double").alias("neg"))


def roc_auc(df: DataFrame, group_cols: Sequence[str] = (), score="y_proba", y_true="y_true",
            weight: str | None = None) -> DataFrame:
    """E6 (+E4): ROC AUC with tie-averaged ranks (Mann-Whitney); null when a
    group has only one class.  With ``weight`` a row stands for so many."""
    s = _score_table(df, group_cols, score, y_true, weight).withColumn("cnt", F.col("pos") + F.col("neg"))
    r = rank_within(s, group_cols, [F.col(score).asc()], sums=["cnt"])
    avg_rank = F.col("_cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2
    agg = r.groupBy(*group_cols).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                     F.sum(F.col("pos") * avg_rank).alias("rank_sum"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*group_cols, auc.alias("roc_auc"))


def _desc_curve(df, group_cols, score, y_true):
    s = _score_table(df, group_cols, score, y_true)
    return rank_within(s, group_cols, [F.col(score).desc()], sums=["pos", "neg"])


def roc_curve(df: DataFrame, group_cols: Sequence[str] = (), score="y_proba", y_true="y_true") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first."""
    r = _desc_curve(df, group_cols, score, y_true)
    return r.select(*group_cols, F.col(score).alias("threshold"),
                    safe_div(F.col("_cum_neg"), F.col("_tot_neg")).alias("fpr"),
                    safe_div(F.col("_cum_pos"), F.col("_tot_pos")).alias("tpr"))


def pr_curve(df: DataFrame, group_cols: Sequence[str] = (), score="y_proba", y_true="y_true") -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    r = _desc_curve(df, group_cols, score, y_true)
    return r.select(*group_cols, F.col(score).alias("threshold"),
                    safe_div(F.col("_cum_pos"), F.col("_cum_pos") + F.col("_cum_neg")).alias("precision"),
                    safe_div(F.col("_cum_pos"), F.col("_tot_pos")).alias("recall"))


def average_precision(df: DataFrame, group_cols: Sequence[str] = (), score="y_proba", y_true="y_true") -> DataFrame:
    """Sum over thresholds of (recall step) x precision."""
    r = _desc_curve(df, group_cols, score, y_true)
    prec = F.col("_cum_pos") / (F.col("_cum_pos") + F.col("_cum_neg"))
    step = safe_div(F.col("pos"), F.col("_tot_pos"))
    return r.groupBy(*group_cols).agg(F.sum(step * prec).alias("average_precision"))


def calibration_edges(n_bins: int = 10) -> list[float]:
    """Inner bin edges of ``linspace(0, 1, n_bins + 1)`` as floats."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def calibration_curve(df: DataFrame, group_cols: Sequence[str] = (), n_bins: int = 10,
                      score="y_proba", y_true="y_true") -> DataFrame:
    """Equal-width bins on [0, 1]; a value on an edge goes to the lower
    bin; empty bins are absent.  Returns bin, prob_true, prob_pred, count."""
    edges = F.array(*[F.lit(e) for e in calibration_edges(n_bins)])
    p = F.col(score).cast("double")
    b = F.size(F.filter(edges, lambda e: e < p))
    return (df.withColumn("bin", b).groupBy(*group_cols, "bin")
              .agg(F.avg(F.col(y_true).cast("double")).alias("prob_true"), F.avg(p).alias("prob_pred"),
                   F.count(F.lit(1)).alias("count")))


def _r2(sse: Column, sst: Column) -> Column:
    """sklearn convention for constant targets: 1 if perfect else 0."""
    return F.when(sst != 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0)


def regression_metrics(df: DataFrame, group_cols: Sequence[str] = (), y_log="log_runtime",
                       p_log="pred_log") -> DataFrame:
    """MAE, RMSE and R2 on the log scale and on seconds (exp)."""
    y, p = F.col(y_log), F.col(p_log)
    ys, ps = F.exp(y), F.exp(p)
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae_log"), F.avg((y - p) * (y - p)).alias("_mse_log"),
        F.sum((y - p) * (y - p)).alias("_sse_log"), (F.var_pop(y) * F.count(F.lit(1))).alias("_sst_log"),
        F.avg(F.abs(ys - ps)).alias("mae_s"), F.avg((ys - ps) * (ys - ps)).alias("_mse_s"),
        F.sum((ys - ps) * (ys - ps)).alias("_sse_s"), (F.var_pop(ys) * F.count(F.lit(1))).alias("_sst_s"))
    return agg.select(*group_cols, "n", "mae_log", F.sqrt("_mse_log").alias("rmse_log"),
                      _r2(F.col("_sse_log"), F.col("_sst_log")).alias("r2_log"),
                      "mae_s", F.sqrt("_mse_s").alias("rmse_s"), _r2(F.col("_sse_s"), F.col("_sst_s")).alias("r2_s"))


def history_metrics(df: DataFrame, group_cols: Sequence[str] = (), actual="runtime_s",
                    predicted="predicted_runtime_s") -> DataFrame:
    """R2 raw, R2 of log1p with predictions clipped at 0, MAE in ms, n;
    all null below two rows, R2 null when the target is constant.  Only
    moments are aggregated, so the state per group is constant-size."""
    y, p = F.col(actual), F.col(predicted)
    ly, lp = F.log1p(y), F.log1p(F.greatest(p, F.lit(0.0)))
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("_sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.sum((ly - lp) * (ly - lp)).alias("_lsse"), (F.var_pop(ly) * F.count(F.lit(1))).alias("_lsst"),
        F.avg(F.abs(y - p)).alias("_mae"))
    enough = F.col("n") >= 2
    return agg.select(
        *group_cols, F.col("n").cast("long").alias("n"),
        F.when(enough & (F.col("_sst") > 0), 1 - F.col("_sse") / F.col("_sst")).alias("r2"),
        F.when(enough & (F.col("_lsst") > 0), 1 - F.col("_lsse") / F.col("_lsst")).alias("r2_log"),
        F.when(enough, F.col("_mae") * 1000).alias("mae_ms"))


def rolling_r2(df: DataFrame, order_col="id", actual="runtime_s", predicted="predicted_runtime_s",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Log-scale R2 over the first k rows for every k >= 2 (k = 1 has
    none), via prefix sums of y, y^2 and squared error: sst_k = S_yy - S_y^2/k.
    y is taken relative to its group's mean, so the two terms do not cancel
    however many rows there are."""
    ly = F.log1p(F.col(actual))
    lp = F.log1p(F.greatest(F.col(predicted), F.lit(0.0)))
    logs = df.select(*group_cols, order_col, ly.alias("ly"), ((ly - lp) * (ly - lp)).alias("e2"))
    if group_cols:
        logs = logs.join(logs.groupBy(*group_cols).agg(F.avg("ly").alias("mean")), list(group_cols))
        y = F.col("ly") - F.col("mean")
    else:
        y = F.col("ly") - logs.agg(F.avg("ly")).scalar()
    base = logs.select(*group_cols, order_col, "e2", y.alias("y")).withColumn("y2", F.col("y") * F.col("y"))
    r = rank_within(base, group_cols, [F.col(order_col).asc()], sums=["y", "y2", "e2"])
    k = (F.col("_rn") + 1).cast("double")
    sst = F.col("_cum_y2") - F.col("_cum_y") * F.col("_cum_y") / k
    r2 = F.when((k >= 2) & (sst > 0), 1 - F.col("_cum_e2") / sst)
    return r.select(*group_cols, order_col, (F.col("_rn") + 1).alias("k"), r2.alias("r2_log"))


def error_analysis(df: DataFrame, by=("db_id", "difficulty"), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Misclassified rows per (db, difficulty), most first."""
    return (df.where(F.col(y_true) != F.col(y_pred)).groupBy(*by).agg(F.count(F.lit(1)).alias("n_errors"))
              .orderBy(F.desc("n_errors"), *by))


def fold_scores(df: DataFrame, model_col="model", fold_col="fold", **kw) -> DataFrame:
    """Per (model, fold) test metrics, ordered by model and fold."""
    m = binary_metrics(df, [model_col, fold_col], **kw)
    auc = roc_auc(df, [model_col, fold_col])
    return m.join(auc, [model_col, fold_col], "left").orderBy(model_col, fold_col)


def model_comparison(df: DataFrame, model_col="model", fold_col="fold") -> DataFrame:
    """Per model the fold-F1 mean and population std as ``mean±std``
    (4 dp) plus overall test metrics, sorted by test F1 descending."""
    per_fold = binary_metrics(df, [model_col, fold_col])
    cv = per_fold.groupBy(model_col).agg(F.avg("f1").alias("cv_f1_mean"), F.stddev_pop("f1").alias("cv_f1_std"))
    test = binary_metrics(df, [model_col])
    auc = roc_auc(df, [model_col])
    out = test.join(cv, model_col).join(auc, model_col, "left")
    return out.select(model_col, F.format_string("%.4f±%.4f", "cv_f1_mean", "cv_f1_std").alias("cv_f1"),
                      "cv_f1_mean", "cv_f1_std", F.col("accuracy").alias("test_accuracy"),
                      F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
                      F.col("f1").alias("test_f1"), F.col("roc_auc").alias("test_roc_auc")).orderBy(F.desc("test_f1"))


def fold_box_stats(scores: DataFrame, model_col="model", value="f1") -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of the per-fold scores per model.
    Quartiles use the exact distributed quantiles (groups are models).  Scores
    are sums over a shuffle: they are written before the quantiles' passes."""
    ensure_checkpoint_dir(scores.sparkSession)
    scores = scores.select(model_col, value).checkpoint()
    q = exact_quantiles(scores, value, [0.25, 0.5, 0.75], [model_col]).select(
        model_col, F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"))
    j = scores.select(model_col, value).join(q, model_col)
    iqr = F.col("q3") - F.col("q1")
    lo_ok = F.col(value) >= F.col("q1") - 1.5 * iqr
    hi_ok = F.col(value) <= F.col("q3") + 1.5 * iqr
    return j.groupBy(model_col, "q1", "median", "q3").agg(
        F.min(F.when(lo_ok, F.col(value))).alias("whisker_low"),
        F.max(F.when(hi_ok, F.col(value))).alias("whisker_high"),
        F.count_if(~lo_ok | ~hi_ok).alias("n_outliers"))


def wilcoxon_top_two(scores: DataFrame, model_col="model", fold_col="fold", value="f1") -> DataFrame:
    """Signed-rank statistic between the two models with the highest
    mean score, paired by fold: zero differences dropped, |d| ranks
    tie-averaged, statistic = min(W+, W-).  ``p_value`` is two-sided: exact
    for at most :data:`EXACT_PAIRS` untied differences, else the normal
    approximation with the correction of the variance for ties."""
    means = scores.groupBy(model_col).agg(F.avg(value).alias("_m"))
    w = Window.orderBy(F.desc("_m"), model_col)  # one row per model
    top = means.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    a = top.where(F.col("_r") == 1).select(F.col(model_col).alias("model_a"))
    b = top.where(F.col("_r") == 2).select(F.col(model_col).alias("model_b"))
    sa = scores.join(a, scores[model_col] == a["model_a"]).select("model_a", fold_col, F.col(value).alias("_a"))
    sb = scores.join(b, scores[model_col] == b["model_b"]).select("model_b", fold_col, F.col(value).alias("_b"))
    d = sa.join(sb, fold_col).select("model_a", "model_b", fold_col, (F.col("_a") - F.col("_b")).alias("d"))
    d = d.where(F.col("d") != 0)
    ad = Window.partitionBy("model_a", "model_b").orderBy(F.abs("d"))
    tie = Window.partitionBy("model_a", "model_b", F.abs("d"))
    ranked = d.withColumn("_rk", F.rank().over(ad)).withColumn("_cnt", F.count(F.lit(1)).over(tie))
    ranked = ranked.withColumn("rank", F.col("_rk") + (F.col("_cnt") - 1) / 2.0)
    return ranked.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("_cnt") * F.col("_cnt") - 1).alias("_ties")
    ).withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("p_value", _signed_rank_p()).drop("_ties")


EXACT_PAIRS = 20


def signed_rank_cdf(n: int) -> list[float]:
    """P(W+ <= w) for w = 0, 1, ... over the 2^n sign patterns of the ranks
    1..n: the number of subsets with each sum, built rank by rank."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for w, k in enumerate(ways):
            longer[w + rank] += k
        ways = longer
    total, out = 0, []
    for k in ways:
        total += k
        out.append(total / 2 ** n)
    return out


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 (Abramowitz & Stegun 26.2.17, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / F.lit((2 * 3.141592653589793) ** 0.5) * poly


def _signed_rank_p() -> Column:
    """Two-sided p-value from ``n``, ``statistic`` and ``_ties`` (sum over
    the differences of t^2 - 1, t being the size of the difference's tie)."""
    n = F.col("n")
    cdf = F.array(*[F.array(*[F.lit(x) for x in signed_rank_cdf(k)]) for k in range(EXACT_PAIRS + 1)])
    exact = F.least(F.lit(1.0), 2 * F.get(F.get(cdf, n.cast("int")), F.col("statistic").cast("int")))
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    normal = F.when(var > 0, F.least(F.lit(1.0), 2 * _normal_tail(F.abs(F.col("statistic") - mean) / F.sqrt(var)))).otherwise(F.lit(1.0))
    return F.when((n <= EXACT_PAIRS) & (F.col("_ties") == 0), exact).otherwise(normal)


def quality_band(r2) -> Column:
    """Strong / moderate / weak / negative; null -> not enough data."""
    r = F.col(r2) if isinstance(r2, str) else r2
    return (F.when(r.isNull(), "not enough data").when(r >= 0.7, "strong").when(r >= 0.4, "moderate")
             .when(r >= 0.0, "weak").otherwise("negative"))


def abs_error_ms(actual="runtime_s", predicted="predicted_runtime_s") -> Column:
    """|actual - predicted| in milliseconds."""
    return F.abs(F.col(actual) - F.col(predicted)) * 1000
