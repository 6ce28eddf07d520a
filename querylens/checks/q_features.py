"""SQL-text feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext as st
from ..functions.sqltext import FEATURE_COLUMNS, add_parsed_features
from ..operators import querylog as ql
from ..registry import register
from ..sources import fixtures as fx
from .common import features_sql_cte, feature_list_sql, with_ctes

register("f0_sql_features", with_ctes(
    f"SELECT question_id, db_id, difficulty, {feature_list_sql()} FROM feat",
    "query_log", extra=[("feat", features_sql_cte("query_log"))]))(
    lambda spark, sf: st.add_parsed_features(fx.query_log(spark, sf)).drop("sql", "runtime_s"))


def _docs(spark, sf):
    from ..sources.tables import read_table
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang").select(
        "doc_id", F.col("lang").alias("db_id"), F.lit("doc").alias("difficulty"), F.col("text").alias("sql"))
    return st.add_parsed_features(d).drop("sql", "difficulty")


register("f0_document_text_features", with_ctes(
    f"SELECT doc_id, db_id, {feature_list_sql()} FROM feat",
    extra=[("docs", "SELECT doc_id, lang AS db_id, 'doc' AS difficulty, text AS sql FROM documents"),
           ("feat", features_sql_cte("docs"))]))(_docs)


def _q13(spark, sf):
    """The columns that Q13 chooses, with their totals: all but the reserved
    ones, and of a configured list those that are there."""
    feats = add_parsed_features(fx.query_log(spark, sf))
    every, some = ql.feature_columns(feats), ql.feature_columns(feats, ["n_joins", "absent", "query_length"])
    rows = feats.agg(*[F.sum(c).alias(c) for c in every]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("total"), F.lit(c in some).alias("configured")) for c in every])).alias("r"))
    return rows.select("r.feature", "r.total", "r.configured")


register("q13_feature_columns", with_ctes(
    "SELECT feature, total::BIGINT AS total, feature IN ('n_joins', 'query_length') AS configured FROM (SELECT "
    + ", ".join(f"sum({c}) AS {c}" for c in FEATURE_COLUMNS) + " FROM feat) UNPIVOT (total FOR feature IN (" + ", ".join(FEATURE_COLUMNS) + "))",
    "query_log", extra=[("feat", features_sql_cte("query_log"))]))(_q13)
