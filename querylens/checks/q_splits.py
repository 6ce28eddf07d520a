"""Split, fold and sampling queries (T1-T9) over the labelled query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import splits as sp
from ..registry import register
from ..sources import fixtures as fx
from .common import with_ctes

_KEPT = [("q", "SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log"),
         ("kept", """SELECT * FROM (SELECT l.question_id, l.db_id, l.difficulty,
              CASE WHEN runtime_s >= p75 THEN 1 WHEN runtime_s <= p50 THEN 0 ELSE NULL END AS label_binary
              FROM query_log l, q) WHERE label_binary IS NOT NULL""")]
_H = "md5(concat(CAST(question_id AS VARCHAR), '|', '42'))"


def _kept(spark, sf):
    return lb.label_quantile(fx.query_log(spark, sf)).select("question_id", "db_id", "difficulty", "label_binary")


def _alloc(part: str, stratum: str, n: str, draws: str) -> str:
    """DuckDB largest-remainder quota (same integer arithmetic as the Spark side)."""
    pb = f"PARTITION BY {part}" if part else ""
    return f"""SELECT *, fl + CASE WHEN row_number() OVER ({pb} ORDER BY rem DESC, {stratum}) <= dr - sum(fl) OVER ({pb}) THEN 1 ELSE 0 END AS quota
      FROM (SELECT *, ({draws}) AS dr, (({draws}) * {n}) // tot AS fl, (({draws}) * {n}) % tot AS rem
            FROM (SELECT *, sum({n}) OVER ({pb}) AS tot FROM cls))"""


register("t1_split_holdout", with_ctes(
    "SELECT question_id, CASE WHEN db_id IN ('db_3', 'db_7') THEN 'test' ELSE 'train' END AS split FROM kept",
    "query_log", extra=_KEPT))(
    lambda spark, sf: sp.split_holdout(_kept(spark, sf), ["db_3", "db_7"]).select("question_id", "split"))

register("t2_split_random_stratified", with_ctes(
    f"""SELECT question_id, CASE WHEN rn < n - quota THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY label_binary ORDER BY {_H}) - 1 AS rn FROM kept) k
        JOIN alloc USING (label_binary)""",
    "query_log", extra=_KEPT + [("cls", "SELECT label_binary, count(*) AS n FROM kept GROUP BY label_binary"),
                                ("alloc", _alloc("", "label_binary", "n", "tot - CAST(ceil(0.2 * tot) AS BIGINT)"))]))(
    lambda spark, sf: sp.split_random_stratified(_kept(spark, sf)).select("question_id", "split"))

register("t3_split_within_group", with_ctes(
    f"""SELECT question_id, CASE WHEN n < 15 THEN 'skipped' WHEN rn < CAST(ceil(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY {_H}) - 1 AS rn, count(*) OVER (PARTITION BY db_id) AS n FROM kept)""",
    "query_log", extra=_KEPT))(
    lambda spark, sf: sp.split_within_group(_kept(spark, sf)).select("question_id", "split"))

_T4 = [("cls", """SELECT db_id, label_binary, count(*) AS n, count(*) OVER (PARTITION BY db_id) AS ncls,
                  min(count(*)) OVER (PARTITION BY db_id) AS minc FROM kept GROUP BY db_id, label_binary"""),
       ("alloc", _alloc("db_id", "label_binary", "n", "tot - CAST(ceil(0.2 * tot) AS BIGINT)")),
       ("t4", f"""SELECT k.question_id, k.db_id, k.label_binary,
          CASE WHEN a.ncls > 1 AND a.minc >= 2 THEN (CASE WHEN rn_s < a.n - a.quota THEN 'test' ELSE 'train' END)
               ELSE (CASE WHEN rn_g < CAST(ceil(0.2 * a.tot) AS BIGINT) THEN 'test' ELSE 'train' END) END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY db_id, label_binary ORDER BY {_H}) - 1 AS rn_s,
                     row_number() OVER (PARTITION BY db_id ORDER BY {_H}) - 1 AS rn_g FROM kept) k
        JOIN alloc a ON k.db_id = a.db_id AND k.label_binary = a.label_binary""")]

register("t4_split_within_group_stratified", with_ctes(
    "SELECT question_id, split FROM t4", "query_log", extra=_KEPT + _T4))(
    lambda spark, sf: sp.split_within_group_stratified(_kept(spark, sf)).select("question_id", "split"))

register("t5_split_seen_pooled", with_ctes(
    "SELECT question_id, split FROM t4", "query_log", extra=_KEPT + _T4))(
    lambda spark, sf: sp.split_seen_pooled(_kept(spark, sf)).select("question_id", "split"))

register("t6_stratified_folds", with_ctes(
    f"""SELECT question_id, CASE WHEN kk >= 2 THEN CAST((row_number() OVER (PARTITION BY label_binary ORDER BY {_H}) - 1) % kk AS INTEGER) END AS fold
        FROM kept, (SELECT least(5, min(n)) AS kk FROM (SELECT count(*) AS n FROM kept GROUP BY label_binary))""",
    "query_log", extra=_KEPT))(
    lambda spark, sf: sp.stratified_folds(_kept(spark, sf)).select("question_id", "fold"))

register("t7_downsample_stratified", with_ctes(
    f"""SELECT question_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_H}) - 1 AS rn FROM st) s
        JOIN alloc USING (stratum) WHERE rn < quota""",
    "query_log", extra=_KEPT + [
        ("st", "SELECT *, concat(CASE WHEN db_id IN ('db_3', 'db_7') THEN 'unseen' ELSE 'seen' END, '|', CAST(label_binary AS VARCHAR)) AS stratum FROM kept"),
        ("cls", "SELECT stratum, count(*) AS n FROM st GROUP BY stratum"),
        ("alloc", _alloc("", "stratum", "n", "1000"))]))(
    lambda spark, sf: sp.downsample_stratified(_kept(spark, sf), 1000, holdout=["db_3", "db_7"]).select("question_id"))

register("t8_split_summary", with_ctes(
    """SELECT split, count(*)::BIGINT AS n_queries, count(*) FILTER (WHERE label_binary = 0)::BIGINT AS fast,
         count(*) FILTER (WHERE label_binary = 1)::BIGINT AS slow, array_to_string(list_sort(list_distinct(list(db_id))), ', ') AS databases
       FROM (SELECT *, CASE WHEN db_id IN ('db_3', 'db_7') THEN 'test' ELSE 'train' END AS split FROM kept) GROUP BY split""",
    "query_log", extra=_KEPT))(
    lambda spark, sf: sp.split_summary(sp.split_holdout(_kept(spark, sf), ["db_3", "db_7"])))

register("t9_split_status", with_ctes(
    """SELECT db_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE split = 'train')::BIGINT AS n_train,
         count(*) FILTER (WHERE split = 'test')::BIGINT AS n_test, CAST(round_even(avg(label_binary) * 100, 0) AS BIGINT) AS slow_pct,
         CASE WHEN count(*) < 15 THEN 'skipped_small'
              WHEN count(DISTINCT label_binary) FILTER (WHERE split = 'train') < 2 THEN 'degenerate_train'
              WHEN count(DISTINCT label_binary) FILTER (WHERE split = 'test') < 2 THEN 'degenerate_test' ELSE 'ok' END AS status
       FROM t4 GROUP BY db_id""", "query_log", extra=_KEPT + _T4))(
    lambda spark, sf: sp.split_status(sp.split_within_group_stratified(_kept(spark, sf))))
