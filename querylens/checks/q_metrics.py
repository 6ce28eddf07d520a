"""Evaluation-metric queries (E1-E21) over the prediction fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..registry import register
from ..sources import fixtures as fx
from .common import d6, r6, with_ctes


def _p(spark, sf):
    return fx.predictions(spark, sf)


def _rnd(df, keep):
    return df.select(*[F.col(c) if c in keep else r6(c).alias(c) for c in df.columns])


_CNT = """count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
  count(*) AS support, count(DISTINCT y_true) AS ncls"""


def _mets(safe: bool) -> str:
    m = {"accuracy": "CASE WHEN support > 0 THEN (tp + tn)::DOUBLE / support ELSE 0 END",
         "precision": "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END",
         "recall": "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END",
         "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END"}
    if safe:
        m = {k: f"CASE WHEN ncls < 2 THEN NULL ELSE {v} END" for k, v in m.items()}
    return ", ".join(d6(v) + f" AS {k}" for k, v in m.items())


register("e1_confusion_matrix", with_ctes(
    """SELECT model, 0 AS y_true, tn::BIGINT AS pred_0, fp::BIGINT AS pred_1 FROM c
       UNION ALL SELECT model, 1, fn::BIGINT, tp::BIGINT FROM c""",
    "predictions", extra=[("c", f"SELECT model, {_CNT} FROM predictions GROUP BY model")]))(
    lambda spark, sf: me.confusion_matrix(_p(spark, sf), ["model"]))

register("e2_confusion_normalised", with_ctes(
    f"""SELECT model, 0 AS y_true, {d6('tn::DOUBLE / (tn + fp)')} AS pred_0, {d6('fp::DOUBLE / (tn + fp)')} AS pred_1 FROM c
       UNION ALL SELECT model, 1, {d6('fn::DOUBLE / (fn + tp)')}, {d6('tp::DOUBLE / (fn + tp)')} FROM c""",
    "predictions", extra=[("c", f"SELECT model, {_CNT} FROM predictions GROUP BY model")]))(
    lambda spark, sf: _rnd(me.confusion_normalised(_p(spark, sf), ["model"]), ["model", "y_true"]))

register("e3_binary_metrics", with_ctes(
    f"SELECT model, fold, support::BIGINT AS support, {_mets(False)} FROM c",
    "predictions", extra=[("c", f"SELECT model, fold, {_CNT} FROM predictions GROUP BY model, fold")]))(
    lambda spark, sf: _rnd(me.binary_metrics(_p(spark, sf), ["model", "fold"]), ["model", "fold", "support"]))

register("e4_safe_metrics_by_db", with_ctes(
    f"SELECT db_id, support::BIGINT AS support, {_mets(True)} FROM c",
    "predictions", extra=[("c", f"SELECT db_id, {_CNT} FROM predictions GROUP BY db_id")]))(
    lambda spark, sf: _rnd(me.binary_metrics(_p(spark, sf), ["db_id"], safe=True), ["db_id", "support"]))

register("e11_group_breakdown_difficulty", with_ctes(
    f"SELECT difficulty, support::BIGINT AS support, {_mets(True)} FROM c",
    "predictions", extra=[("c", f"SELECT difficulty, {_CNT} FROM predictions GROUP BY difficulty")]))(
    lambda spark, sf: _rnd(me.group_breakdown(_p(spark, sf), "difficulty"), ["difficulty", "support"]))

_REP = """m AS (SELECT model, tp, fp, fn, tn, support,
   CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r1,
   CASE WHEN 2*tp + fp + fn > 0 THEN 2.0 * tp / (2*tp + fp + fn) ELSE 0 END AS f1,
   CASE WHEN tn + fn > 0 THEN tn::DOUBLE / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS r0,
   CASE WHEN 2*tn + fn + fp > 0 THEN 2.0 * tn / (2*tn + fn + fp) ELSE 0 END AS f0,
   (tp + fn)::DOUBLE AS s1, (tn + fp)::DOUBLE AS s0, (tp + tn)::DOUBLE / support AS acc FROM c)"""


def _rep_rows():
    rows = [("'fast'", "p0", "r0", "f0", "s0"), ("'slow'", "p1", "r1", "f1", "s1"), ("'accuracy'", "acc", "acc", "acc", "acc"),
            ("'macro avg'", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "support::DOUBLE"),
            ("'weighted avg'", "(p0 * s0 + p1 * s1) / support", "(r0 * s0 + r1 * s1) / support",
             "(f0 * s0 + f1 * s1) / support", "support::DOUBLE")]
    return " UNION ALL ".join(
        f"SELECT model, {n} AS class, {d6(p)} AS precision, {d6(r)} AS recall, {d6(f)} AS f1_score, {d6(s)} AS support FROM m"
        for n, p, r, f, s in rows)


register("e5_classification_report",
         "WITH predictions AS (" + fx.DUCKDB_CTES["predictions"] + "), c AS (SELECT model, " + _CNT
         + " FROM predictions GROUP BY model), " + _REP + " " + _rep_rows())(
    lambda spark, sf: _rnd(me.classification_report(_p(spark, sf), ["model"]), ["model", "class"]))

_SCORES = "SELECT {g}, y_proba, count(*) FILTER (WHERE y_true = 1)::DOUBLE AS pos, count(*) FILTER (WHERE y_true = 0)::DOUBLE AS neg FROM predictions GROUP BY {g}, y_proba"

register("e6_roc_auc_by_db", with_ctes(
    """SELECT db_id, """ + d6("CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(pos * (cum - (pos + neg) + (pos + neg + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg)) END")
    + """ AS roc_auc FROM (SELECT *, sum(pos + neg) OVER (PARTITION BY db_id ORDER BY y_proba ROWS UNBOUNDED PRECEDING) AS cum FROM s)
       GROUP BY db_id""", "predictions", extra=[("s", _SCORES.format(g="db_id"))]))(
    lambda spark, sf: _rnd(me.roc_auc(_p(spark, sf), ["db_id"]), ["db_id"]))

_DESC = """SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg, sum(pos) OVER (PARTITION BY model) AS tpos,
   sum(neg) OVER (PARTITION BY model) AS tneg FROM s
   WINDOW w AS (PARTITION BY model ORDER BY y_proba DESC ROWS UNBOUNDED PRECEDING)"""

register("e7_roc_curve", with_ctes(
    f"SELECT model, y_proba AS threshold, {d6('CASE WHEN tneg <> 0 THEN cneg / tneg END')} AS fpr, "
    f"{d6('CASE WHEN tpos <> 0 THEN cpos / tpos END')} AS tpr FROM d",
    "predictions", extra=[("s", _SCORES.format(g="model")), ("d", _DESC)]))(
    lambda spark, sf: _rnd(me.roc_curve(_p(spark, sf), ["model"]), ["model"]))

register("e8_pr_curve", with_ctes(
    f"SELECT model, y_proba AS threshold, {d6('CASE WHEN cpos + cneg <> 0 THEN cpos / (cpos + cneg) END')} AS precision, "
    f"{d6('CASE WHEN tpos <> 0 THEN cpos / tpos END')} AS recall FROM d",
    "predictions", extra=[("s", _SCORES.format(g="model")), ("d", _DESC)]))(
    lambda spark, sf: _rnd(me.pr_curve(_p(spark, sf), ["model"]), ["model"]))

register("e9_average_precision", with_ctes(
    f"SELECT model, {d6('sum(CASE WHEN tpos <> 0 THEN pos / tpos END * cpos / (cpos + cneg))')} AS average_precision FROM d GROUP BY model",
    "predictions", extra=[("s", _SCORES.format(g="model")), ("d", _DESC)]))(
    lambda spark, sf: _rnd(me.average_precision(_p(spark, sf), ["model"]), ["model"]))

_EDGES = ", ".join(repr(e) for e in me.calibration_edges(10))
register("e10_calibration_curve", with_ctes(
    f"""SELECT model, bin, {d6('avg(y_true::DOUBLE)')} AS prob_true, {d6('avg(y_proba)')} AS prob_pred, count(*)::BIGINT AS count
        FROM (SELECT *, CAST(len(list_filter([{_EDGES}], lambda e: e < y_proba)) AS INTEGER) AS bin FROM predictions)
        GROUP BY model, bin""", "predictions"))(
    lambda spark, sf: _rnd(me.calibration_curve(_p(spark, sf), ["model"]), ["model", "bin", "count"]))


def _reg_input(spark, sf):
    p = _p(spark, sf)
    return p.select("db_id", F.ln("runtime_s").alias("log_runtime"), F.ln("predicted_runtime_s").alias("pred_log"))


register("e12_regression_metrics_by_db", with_ctes(
    "SELECT db_id, count(*)::BIGINT AS n, " + ", ".join([
        d6("avg(abs(y - p))") + " AS mae_log", d6("sqrt(avg((y - p) * (y - p)))") + " AS rmse_log",
        d6("CASE WHEN var_pop(y) * count(*) <> 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END") + " AS r2_log",
        d6("avg(abs(exp(y) - exp(p)))") + " AS mae_s", d6("sqrt(avg((exp(y) - exp(p)) * (exp(y) - exp(p))))") + " AS rmse_s",
        d6("CASE WHEN var_pop(exp(y)) * count(*) <> 0 THEN 1 - sum((exp(y) - exp(p)) * (exp(y) - exp(p))) / (var_pop(exp(y)) * count(*)) WHEN sum((exp(y) - exp(p)) * (exp(y) - exp(p))) = 0 THEN 1.0 ELSE 0.0 END") + " AS r2_s"])
    + " FROM (SELECT db_id, ln(runtime_s) AS y, ln(predicted_runtime_s) AS p FROM predictions) GROUP BY db_id",
    "predictions"))(
    lambda spark, sf: _rnd(me.regression_metrics(_reg_input(spark, sf), ["db_id"]), ["db_id", "n"]))

_HV = "SELECT * FROM history WHERE had_error = 0 AND runtime_s IS NOT NULL AND predicted_runtime_s IS NOT NULL"


def _hv(spark, sf):
    h = fx.history(spark, sf)
    return h.where((F.col("had_error") == 0) & F.col("runtime_s").isNotNull() & F.col("predicted_runtime_s").isNotNull())


register("e13_history_metrics_by_db", with_ctes(
    "SELECT database, count(*)::BIGINT AS n, "
    + d6("CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END") + " AS r2, "
    + d6("CASE WHEN count(*) >= 2 AND var_pop(ly) > 0 THEN 1 - sum((ly - lp) * (ly - lp)) / (var_pop(ly) * count(*)) END") + " AS r2_log, "
    + d6("CASE WHEN count(*) >= 2 THEN avg(abs(y - p)) * 1000 END") + " AS mae_ms "
    + "FROM (SELECT database, runtime_s AS y, predicted_runtime_s AS p, ln(1 + runtime_s) AS ly, ln(1 + greatest(predicted_runtime_s, 0)) AS lp FROM hv) GROUP BY database",
    "history", extra=[("hv", _HV)]))(
    lambda spark, sf: _rnd(me.history_metrics(_hv(spark, sf), ["database"]), ["database", "n"]))

register("e14_rolling_r2", with_ctes(
    "SELECT id, k, " + d6("CASE WHEN k >= 2 AND sy2 - sy * sy / k > 0 THEN 1 - se2 / (sy2 - sy * sy / k) END") + " AS r2_log FROM ("
    "SELECT id, row_number() OVER w AS k, sum(y) OVER w AS sy, sum(y * y) OVER w AS sy2, sum(e * e) OVER w AS se2 FROM ("
    "SELECT id, ln(1 + runtime_s) AS y, ln(1 + runtime_s) - ln(1 + greatest(predicted_runtime_s, 0)) AS e FROM hv) "
    "WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING))",
    "history", extra=[("hv", _HV)]))(
    lambda spark, sf: _rnd(me.rolling_r2(_hv(spark, sf)), ["id", "k"]))

register("e15_error_analysis", with_ctes(
    "SELECT db_id, difficulty, count(*)::BIGINT AS n_errors FROM predictions WHERE y_true <> y_pred GROUP BY db_id, difficulty",
    "predictions"))(
    lambda spark, sf: me.error_analysis(_p(spark, sf)))

_FOLD = f"SELECT model, fold, {_CNT} FROM predictions GROUP BY model, fold"
_FOLD_F1 = "SELECT model, fold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM fc"

register("e16_model_comparison", with_ctes(
    f"""SELECT t.model, printf('%.4f±%.4f', cv.m, cv.s) AS cv_f1, {d6('cv.m')} AS cv_f1_mean, {d6('cv.s')} AS cv_f1_std,
          {d6('(tp + tn)::DOUBLE / support')} AS test_accuracy,
          {d6('CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END')} AS test_precision,
          {d6('CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END')} AS test_recall,
          {d6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS test_f1,
          {d6('auc.a')} AS test_roc_auc
        FROM t JOIN (SELECT model, avg(f1) AS m, stddev_pop(f1) AS s FROM ff GROUP BY model) cv ON t.model = cv.model
        LEFT JOIN (SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(pos * (cum - (pos + neg) + (pos + neg + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg)) END AS a
                   FROM (SELECT *, sum(pos + neg) OVER (PARTITION BY model ORDER BY y_proba ROWS UNBOUNDED PRECEDING) AS cum FROM s) GROUP BY model) auc
          ON t.model = auc.model""",
    "predictions", extra=[("fc", _FOLD), ("ff", _FOLD_F1), ("t", f"SELECT model, {_CNT} FROM predictions GROUP BY model"),
                          ("s", _SCORES.format(g="model"))]))(
    lambda spark, sf: _rnd(me.model_comparison(_p(spark, sf)), ["model", "cv_f1"]))


def _fold_f1(spark, sf):
    return me.binary_metrics(_p(spark, sf), ["model", "fold"]).select("model", "fold", "f1")


register("e18_fold_box_stats", with_ctes(
    f"""SELECT b.model, {d6('q1')} AS q1, {d6('med')} AS median, {d6('q3')} AS q3,
          {d6('min(f1) FILTER (WHERE f1 >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
          {d6('max(f1) FILTER (WHERE f1 <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
          count(*) FILTER (WHERE f1 < q1 - 1.5 * (q3 - q1) OR f1 > q3 + 1.5 * (q3 - q1))::BIGINT AS n_outliers
        FROM ff JOIN (SELECT model, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS med, quantile_cont(f1, 0.75) AS q3
                      FROM ff GROUP BY model) b ON ff.model = b.model GROUP BY b.model, q1, med, q3""",
    "predictions", extra=[("fc", _FOLD), ("ff", _FOLD_F1)]))(
    lambda spark, sf: _rnd(me.fold_box_stats(_fold_f1(spark, sf)), ["model", "n_outliers"]))

# exact two-sided p-value: the share of the sign patterns of 1..n (n <= 10
# folds, no ties) whose smaller rank sum is at most the statistic
_BITS = " + ".join(f"CASE WHEN (s // {1 << i}) % 2 = 1 THEN {i + 1} ELSE 0 END" for i in range(10))
_PATTERNS = f"SELECT s, {_BITS} AS w FROM (SELECT unnest(range(0, 1024)) AS s)"
_TOP_TWO = """SELECT model_a, model_b, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus,
        sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus
      FROM (SELECT *, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM (
          SELECT a.model AS model_a, b.model AS model_b, a.fold, a.f1 - b.f1 AS d
          FROM ff a JOIN ff b ON a.fold = b.fold
          WHERE a.model = (SELECT model FROM mm ORDER BY m DESC, model LIMIT 1)
            AND b.model = (SELECT model FROM mm ORDER BY m DESC, model LIMIT 1 OFFSET 1)) WHERE d <> 0)
      GROUP BY model_a, model_b"""
register("e19_wilcoxon_top_two", with_ctes(
    f"""SELECT model_a, model_b, n::BIGINT AS n, {d6('w_plus')} AS w_plus, {d6('w_minus')} AS w_minus,
          {d6('least(w_plus, w_minus)')} AS statistic,
          {d6('avg(CASE WHEN least(w, n * (n + 1) / 2.0 - w) <= least(w_plus, w_minus) THEN 1.0 ELSE 0.0 END)')} AS p_value
        FROM top_two JOIN pat ON pat.s < pow(2, n) GROUP BY model_a, model_b, n, w_plus, w_minus""",
    "predictions", extra=[("fc", _FOLD), ("ff", _FOLD_F1), ("mm", "SELECT model, avg(f1) AS m FROM ff GROUP BY model"),
                          ("top_two", _TOP_TWO), ("pat", _PATTERNS)]))(
    lambda spark, sf: _rnd(me.wilcoxon_top_two(_fold_f1(spark, sf)), ["model_a", "model_b", "n"]))

_FOLD_AUC = """SELECT model, fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
        (sum(pos * (cum - (pos + neg) + (pos + neg + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg)) END AS a
      FROM (SELECT *, sum(pos + neg) OVER (PARTITION BY model, fold ORDER BY y_proba ROWS UNBOUNDED PRECEDING) AS cum FROM (
        SELECT model, fold, y_proba, sum(y_true) * 1.0 AS pos, sum(1 - y_true) * 1.0 AS neg FROM predictions GROUP BY model, fold, y_proba))
      GROUP BY model, fold"""
register("e17_cv_fold_scores", with_ctes(
    f"""SELECT fc.model, fc.fold, {d6('(tp + tn)::DOUBLE / support')} AS accuracy,
          {d6('CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END')} AS precision,
          {d6('CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END')} AS recall,
          {d6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1, {d6('auc.a')} AS roc_auc
        FROM fc LEFT JOIN auc ON fc.model = auc.model AND fc.fold = auc.fold""",
    "predictions", extra=[("fc", _FOLD), ("auc", _FOLD_AUC)]))(
    lambda spark, sf: _rnd(me.fold_scores(_p(spark, sf)).select("model", "fold", "accuracy", "precision", "recall", "f1", "roc_auc"),
                           ["model", "fold"]))


def _e20(spark, sf):
    m = me.history_metrics(_hv(spark, sf), ["database"])
    return m.select("database", me.quality_band("r2_log").alias("quality_band"))


register("e20_quality_band", with_ctes(
    """SELECT database, CASE WHEN r IS NULL THEN 'not enough data' WHEN r >= 0.7 THEN 'strong' WHEN r >= 0.4 THEN 'moderate'
         WHEN r >= 0.0 THEN 'weak' ELSE 'negative' END AS quality_band FROM (
         SELECT database, CASE WHEN count(*) >= 2 AND var_pop(ly) > 0 THEN 1 - sum((ly - lp) * (ly - lp)) / (var_pop(ly) * count(*)) END AS r
         FROM (SELECT database, ln(1 + runtime_s) AS ly, ln(1 + greatest(predicted_runtime_s, 0)) AS lp FROM hv) GROUP BY database)""",
    "history", extra=[("hv", _HV)]))(_e20)

register("e21_abs_error_ms", with_ctes(
    "SELECT id, " + d6("abs(runtime_s - predicted_runtime_s) * 1000") + " AS abs_error_ms FROM hv", "history", extra=[("hv", _HV)]))(
    lambda spark, sf: _hv(spark, sf).select("id", r6(me.abs_error_ms()).alias("abs_error_ms")))
