"""Query-log tables derived from the driver's parquet tables.

The reference works on a log of SQL queries with measured runtimes, a run
log, prediction tables, a query history, catalog statistics and plan rows.
Those inputs are not shipped, so equivalent tables are derived here from the
driver tables (``FIXTURES.md``).  Each builder is a plain projection of a
driver table, so its size grows with the scale factor.

``DUCKDB_CTES`` holds the same derivations as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# The eleven query shapes of the synthetic query log, by
# o_orderkey % 12 (shape 0 and 8 append o_custkey; shape 11 is the empty query).
QUERY_SHAPES = {
    1: "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 10",
    2: ("SELECT n.n_name, SUM(o.o_totalprice) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
        "JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING SUM(o.o_totalprice) > 1000"),
    3: "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 10 AND 20 AND o_orderstatus = 'O' OR o_custkey < 5",
    4: "SELECT p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_name LIKE '%red%'",
    5: ("SELECT c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
        "AND (o.o_totalprice > (SELECT AVG(o_totalprice) FROM orders)))"),
    6: "SELECT s_name FROM supplier UNION SELECT c_name FROM customer",
    7: "SELECT MAX(l_quantity), MIN(l_quantity), AVG(l_discount) FROM lineitem",
    9: "select `o_orderkey` from orders limit 5, 10;",
    10: ("SELECT COUNT(DISTINCT l_suppkey) FROM lineitem WHERE (l_tax > 0.01 AND (l_discount < 0.05 "
         "OR l_quantity > 10)) GROUP BY l_returnflag"),
}

# Plan rows repeated for every order (node_id, parent_id, detail)
# and the named catalog used for node-to-table matching.
PLAN_TEMPLATE = [
    (2, 0, "SCAN orders"),
    (5, 0, "SEARCH customer USING INTEGER PRIMARY KEY (rowid=?)"),
    (9, 5, "SEARCH nation USING COVERING INDEX ix_n (n_nationkey=?)"),
    (12, 0, "USE TEMP B-TREE FOR GROUP BY"),
    (15, 0, "USE TEMP B-TREE FOR ORDER BY"),
    (18, 0, "COMPOUND QUERY"),
    (21, 18, "CORRELATED SCALAR SUBQUERY 1"),
]
NAMED_TABLES = ["orders", "customer", "nation", "part", "supplier", "lineitem"]
# Index definitions of the named catalog (table, index name, SQL).
NAMED_INDEXES = [
    ("orders", "ix_o_cust", "CREATE INDEX ix_o_cust ON orders(o_custkey)"),
    ("customer", "ix_c_nation", "CREATE INDEX ix_c_nation ON customer(c_nationkey)"),
    ("nation", "ix_n", "CREATE INDEX ix_n ON nation (n_nationkey)"),
    ("lineitem", "ix_l_order", "CREATE INDEX ix_l_order ON lineitem(l_orderkey, l_linenumber)"),
]


def _db(col: str) -> Column:
    return F.concat(F.lit("db_"), (F.col(col) % 11).cast("string"))


def _difficulty() -> Column:
    s = F.col("o_orderstatus")
    return (F.when(s == "F", "simple").when(s == "O", "moderate").otherwise("challenging"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, db_id, difficulty, sql, runtime_s (one row per order)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    shape = (F.col("o_orderkey") % 12).cast("int")
    cust = F.col("o_custkey").cast("string")
    sql = F.when(shape == 0, F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE o_custkey = "), cust))
    for k, text in QUERY_SHAPES.items():
        sql = sql.when(shape == k, F.lit(text))
    sql = sql.when(shape == 8, F.concat(
        F.lit("SELECT o_orderkey\nFROM orders\nJOIN customer ON o_custkey = c_custkey\nWHERE c_acctbal > "), cust))
    sql = sql.otherwise(F.lit(""))
    return o.select(F.col("o_orderkey").alias("question_id"), _db("o_custkey").alias("db_id"),
                    _difficulty().alias("difficulty"), sql.alias("sql"),
                    (F.col("o_totalprice") / 100000.0).alias("runtime_s"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, db_id, run_no, elapsed_s, error: three timed runs per query."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    o = o.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run_no"))
    k = F.col("o_orderkey")
    failed = k % 50 == 0
    err = (F.when(~failed, F.lit(None).cast("string"))
           .when(k % 200 == 0, "query timeout > 30s")
           .when(k % 200 == 50, "no such table: foo")
           .when(k % 200 == 100, 'near "FORM": syntax error')
           .otherwise("database is locked"))
    elapsed = F.when(failed, F.lit(None).cast("double")).otherwise(
        F.col("o_totalprice") / 100000.0 * (1 + F.col("run_no") * 0.125))
    return o.select(k.alias("question_id"), _db("o_custkey").alias("db_id"), "run_no",
                    elapsed.alias("elapsed_s"), err.alias("error"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: 4 models, 5 folds, 101 tied score levels; db_0 is one-class."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    score = (F.col("o_orderkey") * 37) % 101
    rt = F.col("o_totalprice") / 100000.0
    return o.select(
        F.col("o_orderkey").alias("question_id"), _db("o_custkey").alias("db_id"),
        _difficulty().alias("difficulty"),
        F.concat(F.lit("model_"), (F.col("o_orderkey") % 4).cast("string")).alias("model"),
        (F.col("o_custkey") % 5).cast("int").alias("fold"),
        F.when((F.col("o_totalprice") >= 300000) & (F.col("o_custkey") % 11 != 0), 1).otherwise(0).alias("y_true"),
        F.when(score >= 50, 1).otherwise(0).alias("y_pred"),
        (score.cast("double") / 100).alias("y_proba"),
        rt.alias("runtime_s"),
        (rt * (0.5 + score.cast("double") / 100)).alias("predicted_runtime_s"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query history (id, ts, database, sql_text, runtime_s, predicted_runtime_s, had_error)."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    is_err = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"), "ts",
        _db("user_id").alias("database"),
        F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE o_custkey = "), F.col("user_id").cast("string")).alias("sql_text"),
        F.when(is_err, F.lit(None).cast("double")).otherwise(F.col("value") / 1000.0).alias("runtime_s"),
        F.when(F.col("user_id") % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.regexp_extract("props", "[0-9]+", 0).cast("double") / 1000).alias("predicted_runtime_s"),
        F.when(is_err, 1).otherwise(0).alias("had_error"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, table_name, table_pos, row_count, n_indexes (no rows for db_10)."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    return (p.where(F.col("p_partkey") % 11 != 10)
             .select(_db("p_partkey").alias("db_id"),
                     F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("table_name"),
                     F.col("p_partkey").cast("int").alias("table_pos"),
                     (F.col("p_size").cast("long") * 1000).alias("row_count"),
                     (F.col("p_partkey") % 3).cast("int").alias("n_indexes")))


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, node_id, parent_id, detail; some parents are filtered away (orphans)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    tmpl = F.array(*[F.struct(F.lit(n).alias("node_id"), F.lit(p).alias("parent_id"), F.lit(d).alias("detail"))
                     for n, p, d in PLAN_TEMPLATE])
    nodes = o.select(F.col("o_orderkey").alias("query_id"), F.inline(tmpl))
    return nodes.where((F.col("query_id") + F.col("node_id")) % 4 != 0)


def named_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-table catalog (table_name, table_pos, row_count) for name matching,
    with the tables' own row counts."""
    parts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).cast("int").alias("row_count")).select(
        F.lit(t).alias("table_name"), F.lit(i).alias("table_pos"), "row_count") for i, t in enumerate(NAMED_TABLES)]
    return reduce(DataFrame.union, parts)


def named_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, col_name) of the named catalog, read from the table schemas."""
    rows = [(t, f.name) for t in NAMED_TABLES for f in read_table(spark, sf_dir, t).schema.fields]
    return spark.createDataFrame(rows, "table_name string, col_name string")


def named_indexes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMED_INDEXES, "table_name string, index_name string, index_sql string")


BUILDERS = {
    "query_log": query_log, "run_log": run_log, "predictions": predictions,
    "history": history, "catalog_tables": catalog_tables, "plan_nodes": plan_nodes,
}


# ---------------------------------------------------------------------------
# DuckDB text of the same tables, for the oracle strings.
# ---------------------------------------------------------------------------

def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _query_log_sql() -> str:
    whens = ["WHEN 0 THEN concat('SELECT COUNT(*) FROM orders WHERE o_custkey = ', CAST(o_custkey AS VARCHAR))"]
    for k in range(1, 11):
        if k == 8:
            whens.append("WHEN 8 THEN concat('SELECT o_orderkey', chr(10), 'FROM orders', chr(10), "
                         "'JOIN customer ON o_custkey = c_custkey', chr(10), 'WHERE c_acctbal > ', CAST(o_custkey AS VARCHAR))")
        else:
            whens.append(f"WHEN {k} THEN {_sql_lit(QUERY_SHAPES[k])}")
    return ("SELECT o_orderkey AS question_id, concat('db_', CAST(o_custkey % 11 AS VARCHAR)) AS db_id, "
            "CASE WHEN o_orderstatus='F' THEN 'simple' WHEN o_orderstatus='O' THEN 'moderate' ELSE 'challenging' END AS difficulty, "
            "CASE CAST(o_orderkey % 12 AS INT) " + " ".join(whens) + " ELSE '' END AS sql, "
            "o_totalprice / 100000.0 AS runtime_s FROM orders")


DUCKDB_CTES = {
    "query_log": _query_log_sql(),
    "run_log": """SELECT o_orderkey AS question_id, concat('db_', CAST(o_custkey % 11 AS VARCHAR)) AS db_id, r.run_no,
  CASE WHEN o_orderkey % 50 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice / 100000.0 * (1 + r.run_no * 0.125) END AS elapsed_s,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(NULL AS VARCHAR)
       WHEN o_orderkey % 200 = 0 THEN 'query timeout > 30s'
       WHEN o_orderkey % 200 = 50 THEN 'no such table: foo'
       WHEN o_orderkey % 200 = 100 THEN 'near "FORM": syntax error'
       ELSE 'database is locked' END AS error
FROM orders CROSS JOIN (SELECT 0 AS run_no UNION ALL SELECT 1 UNION ALL SELECT 2) r""",
    "predictions": """SELECT o_orderkey AS question_id, concat('db_', CAST(o_custkey % 11 AS VARCHAR)) AS db_id,
  CASE WHEN o_orderstatus='F' THEN 'simple' WHEN o_orderstatus='O' THEN 'moderate' ELSE 'challenging' END AS difficulty,
  concat('model_', CAST(o_orderkey % 4 AS VARCHAR)) AS model, CAST(o_custkey % 5 AS INT) AS fold,
  CASE WHEN o_totalprice >= 300000 AND o_custkey % 11 <> 0 THEN 1 ELSE 0 END AS y_true,
  CASE WHEN (o_orderkey * 37) % 101 >= 50 THEN 1 ELSE 0 END AS y_pred,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS y_proba,
  o_totalprice / 100000.0 AS runtime_s,
  o_totalprice / 100000.0 * (0.5 + CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100) AS predicted_runtime_s
FROM orders""",
    "history": """SELECT event_id AS id, ts, concat('db_', CAST(user_id % 11 AS VARCHAR)) AS database,
  concat('SELECT COUNT(*) FROM orders WHERE o_custkey = ', CAST(user_id AS VARCHAR)) AS sql_text,
  CASE WHEN event_type = 'error' THEN CAST(NULL AS DOUBLE) ELSE value / 1000.0 END AS runtime_s,
  CASE WHEN user_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 1000 END AS predicted_runtime_s,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS had_error
FROM events""",
    "catalog_tables": """SELECT concat('db_', CAST(p_partkey % 11 AS VARCHAR)) AS db_id,
  concat('t_', CAST(p_partkey AS VARCHAR)) AS table_name, CAST(p_partkey AS INT) AS table_pos,
  CAST(p_size AS BIGINT) * 1000 AS row_count, CAST(p_partkey % 3 AS INT) AS n_indexes
FROM part WHERE p_partkey % 11 <> 10""",
    "plan_nodes": "SELECT o_orderkey AS query_id, n.node_id, n.parent_id, n.detail FROM orders CROSS JOIN ("
                  + " UNION ALL ".join(f"SELECT {n} AS node_id, {p} AS parent_id, {_sql_lit(d)} AS detail"
                                       for n, p, d in PLAN_TEMPLATE)
                  + ") n WHERE (o_orderkey + n.node_id) % 4 <> 0",
    "named_columns": " UNION ALL ".join(f"SELECT {_sql_lit(t)} AS table_name, column_name AS col_name FROM (DESCRIBE {t})"
                                        for t in NAMED_TABLES),
    "named_indexes": " UNION ALL ".join(f"SELECT {_sql_lit(t)} AS table_name, {_sql_lit(i)} AS index_name, {_sql_lit(q)} AS index_sql"
                                        for t, i, q in NAMED_INDEXES),
    "named_tables": " UNION ALL ".join(f"SELECT {_sql_lit(t)} AS table_name, {i} AS table_pos, (SELECT count(*) FROM {t}) AS row_count"
                                       for i, t in enumerate(NAMED_TABLES)),
}


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs it uses plus any extra (name, sql) CTEs."""
    parts = [f"{n} AS ({DUCKDB_CTES[n]})" for n in names]
    parts += [f"{n} AS ({s})" for n, s in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
