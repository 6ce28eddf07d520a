"""File round trips (IO1-IO3, IO7) through the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..registry import register
from ..session import ensure_checkpoint_dir
from ..sources import files as io
from ..sources import fixtures as fx
from .common import d6, r6, with_ctes


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"io-{name}-{uuid.uuid4().hex[:8]}")


def _io1(spark, sf):
    q = fx.query_log(spark, sf).withColumn(
        "difficulty", F.when(F.col("difficulty") == "challenging", F.lit(None)).otherwise(F.col("difficulty")))
    path = _scratch(spark, "questions")
    io.write_json_arrays(q.select("question_id", "db_id", "sql", "difficulty"), path, rename={"sql": "SQL"})
    return io.read_questions(spark, path)


register("io1_read_questions", with_ctes(
    """SELECT question_id, db_id, sql, CASE WHEN difficulty = 'challenging' THEN 'unknown' ELSE difficulty END AS difficulty
       FROM query_log""", "query_log"))(_io1)


def _io2(spark, sf):
    path = _scratch(spark, "querylog-csv")
    io.write_query_log(fx.query_log(spark, sf).select("question_id", "db_id", "sql", "difficulty", "runtime_s"), path, "csv")
    back = io.read_query_log(spark, path, "csv")
    return back.select("question_id", "db_id", "sql", "difficulty", r6("runtime_s").alias("runtime_s"))


register("io2_query_log_csv", with_ctes(
    f"SELECT question_id, db_id, sql, difficulty, {d6('runtime_s')} AS runtime_s FROM query_log", "query_log"))(_io2)


def _io3(spark, sf):
    path = _scratch(spark, "history-jsonl")
    io.write_jsonl(fx.history(spark, sf), path)
    back = io.read_jsonl(spark, path, "id long, ts string, database string, sql_text string, runtime_s double, "
                                      "predicted_runtime_s double, had_error int")
    return back.select("id", "database", r6("runtime_s").alias("runtime_s"), "had_error")


register("io3_jsonl_roundtrip", with_ctes(
    f"SELECT id, database, {d6('runtime_s')} AS runtime_s, had_error FROM history", "history"))(_io3)


def _io7(spark, sf):
    path = _scratch(spark, "report")
    rep = lb.label_counts(lb.label_quantile(fx.query_log(spark, sf)), "db_id")
    io.write_report(rep, path, sort_by=["db_id", "label"])
    return spark.read.schema("db_id string, label string, n long").option("header", True).csv(path)


register("io7_report_sink", with_ctes(
    """SELECT db_id, label, count(*)::BIGINT AS n FROM (
         SELECT l.*, CASE WHEN runtime_s >= p75 THEN 'slow' WHEN runtime_s <= p50 THEN 'fast' ELSE 'mid' END AS label
         FROM query_log l, (SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log))
       WHERE label <> 'mid' GROUP BY db_id, label""", "query_log"))(_io7)
