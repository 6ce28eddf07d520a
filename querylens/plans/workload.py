"""Relational workload: the query shapes the logged corpus consists of
(W1-W13) on the TPC-H-like tables, plus the timed workload runner (W0).

Every shape is written with the DataFrame API so Catalyst pushes filters and
projections into the parquet scans, picks join strategies (AQE switches to
broadcast when a side is measured small and splits skewed partitions) and
plans top-k as a per-partition ``TakeOrderedAndProject``.  Sort keys of
every top-k end with a unique column so the result is deterministic.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import TABLES, read_table


def _t(spark, sf, name, *cols):
    return read_table(spark, sf, name, *cols)


def w1_count(spark: SparkSession, sf: str) -> DataFrame:
    """COUNT(*) of a table."""
    return _t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("total_orders"))


def w2_sorted_top(spark: SparkSession, sf: str) -> DataFrame:
    """Projection + sort + limit."""
    c = _t(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    return c.orderBy("c_name", "c_custkey").limit(10)


def w3_join_group_top(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Join + group count + top k (orders with the most line items)."""
    o = _t(spark, sf, "orders", "o_orderkey", "o_orderdate")
    li = _t(spark, sf, "lineitem", "l_orderkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    g = j.groupBy("o_orderkey").agg(F.any_value("o_orderdate").alias("o_orderdate"),
                                    F.count("l_orderkey").alias("num_lines"))
    return g.orderBy(F.desc("num_lines"), "o_orderkey").limit(k)


def w3b_customers_most_orders(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """W3 (top 10 form): customers with the most orders."""
    c = _t(spark, sf, "customer", "c_custkey", "c_name")
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey")
    g = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey", "c_name").agg(
        F.count("o_orderkey").alias("num_orders"))
    return g.orderBy(F.desc("num_orders"), "c_custkey").limit(k)


def w4_join_filter_group_top(spark: SparkSession, sf: str) -> DataFrame:
    """Join + equality filter + group count + top 10 (customers with
    the most first line items)."""
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey")
    li = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber").where(F.col("l_linenumber") == 1)
    g = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("first_lines"))
    return g.orderBy(F.desc("first_lines"), "o_custkey").limit(10)


def w5_three_way_avg_top(spark: SparkSession, sf: str) -> DataFrame:
    """3-way join + IS NOT NULL + avg + top 5 (nations by mean order value)."""
    n = _t(spark, sf, "nation", "n_nationkey", "n_name")
    c = _t(spark, sf, "customer", "c_custkey", "c_nationkey")
    o = _t(spark, sf, "orders", "o_custkey", "o_totalprice").where(F.col("o_totalprice").isNotNull())
    j = n.join(c, n.n_nationkey == c.c_nationkey).join(o, c.c_custkey == o.o_custkey)
    g = j.groupBy("n_nationkey", "n_name").agg(F.avg("o_totalprice").alias("avg_price"))
    return g.orderBy(F.desc("avg_price"), "n_nationkey").limit(5)


def w6_join_in_sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Join + IN list + sort + limit (largest line items of open or finished orders)."""
    o = _t(spark, sf, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderstatus").isin("F", "O"))
    li = _t(spark, sf, "lineitem", "l_orderkey", "l_extendedprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_extendedprice", "o_orderstatus").orderBy(
        F.desc("l_extendedprice"), "l_orderkey", "o_orderstatus").limit(10)


def w7_having(spark: SparkSession, sf: str) -> DataFrame:
    """HAVING over a grouped join (customers with more than 15 orders)."""
    c = _t(spark, sf, "customer", "c_custkey", "c_mktsegment")
    o = _t(spark, sf, "orders", "o_custkey", "o_totalprice")
    g = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total_price"))
    return g.where(F.col("n_orders") > 15)


def w8_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """DISTINCT projection."""
    return _t(spark, sf, "customer", "c_mktsegment", "c_nationkey").distinct()


def w9_union(spark: SparkSession, sf: str) -> DataFrame:
    """UNION (distinct) of two name columns."""
    s = _t(spark, sf, "supplier", "s_name").select(F.col("s_name").alias("name"))
    c = _t(spark, sf, "customer", "c_name").select(F.col("c_name").alias("name"))
    return s.union(c).distinct()


def w10_between(spark: SparkSession, sf: str) -> DataFrame:
    """BETWEEN combined with AND / OR."""
    o = _t(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    cond = (F.col("o_totalprice").between(1000, 50000) & (F.col("o_orderstatus") == "O")) | (F.col("o_custkey") < 5)
    return o.where(cond).select("o_orderkey")


def w11_like(spark: SparkSession, sf: str) -> DataFrame:
    """LIKE pattern."""
    return _t(spark, sf, "part", "p_partkey", "p_name").where(F.col("p_name").like("%red%"))


def w12_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated EXISTS as a left-semi join: customers with an order
    above the mean order value."""
    c = _t(spark, sf, "customer", "c_custkey", "c_name")
    o = _t(spark, sf, "orders", "o_custkey", "o_totalprice")
    avg_price = o.select(F.avg("o_totalprice")).scalar()
    big = o.where(F.col("o_totalprice") > avg_price)
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi")


def w13_nested_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar subqueries nested two levels: orders above the mean order
    value of customers whose balance is above the mean balance."""
    c = _t(spark, sf, "customer", "c_custkey", "c_acctbal")
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    rich = c.where(F.col("c_acctbal") > c.select(F.avg("c_acctbal")).scalar())
    rich_avg = o.join(rich, o.o_custkey == rich.c_custkey, "left_semi").select(F.avg("o_totalprice")).scalar()
    return o.where(F.col("o_totalprice") > rich_avg).select("o_orderkey", "o_totalprice")


SHAPES = {
    "w1_count": w1_count, "w2_sorted_top": w2_sorted_top, "w3_join_group_top": w3_join_group_top,
    "w3b_customers_most_orders": w3b_customers_most_orders, "w4_join_filter_group_top": w4_join_filter_group_top,
    "w5_three_way_avg_top": w5_three_way_avg_top, "w6_join_in_sort_limit": w6_join_in_sort_limit,
    "w7_having": w7_having, "w8_distinct": w8_distinct, "w9_union": w9_union, "w10_between": w10_between,
    "w11_like": w11_like, "w12_exists": w12_exists, "w13_nested_scalar": w13_nested_scalar,
}


def register_tables(spark: SparkSession, sf: str) -> None:
    """Temp views for SQL text written against the driver tables."""
    for t in TABLES:
        read_table(spark, sf, t).createOrReplaceTempView(t)


def run_workload(spark: SparkSession, queries: list[tuple[str, str, str]], runs: int = 3,
                 timeout_s: float = 30.0) -> DataFrame:
    """Run each (question_id, db_id, sql) ``runs`` times with full
    materialisation (``noop`` sink), recording elapsed seconds, row count
    and error text per run; a run over ``timeout_s`` is cancelled through
    its job group.  The loop is over *queries* (a workload list), never over
    data rows; each query itself runs distributed.  Returns the run log
    (question_id, db_id, run_no, elapsed_s, row_count, error)."""
    import threading

    rows = []
    sc = spark.sparkContext
    for qid, db, sql in queries:
        for run_no in range(runs):
            group = f"querylens-w0-{qid}-{run_no}"
            err, elapsed, n = None, None, None
            timer = threading.Timer(timeout_s, lambda g=group: sc.cancelJobGroup(g))
            try:
                sc.setJobGroup(group, "workload run", interruptOnCancel=True)
                obs = Observation(f"rows_{qid}_{run_no}")
                df = spark.sql(sql).observe(obs, F.count(F.lit(1)).alias("n"))
                timer.start()
                t0 = time.perf_counter()
                df.write.format("noop").mode("overwrite").save()
                elapsed = time.perf_counter() - t0
                n = int(obs.get["n"])
            except Exception as exc:  # recorded, the run log keeps going
                msg = str(exc) or type(exc).__name__
                err = f"query timeout > {timeout_s:g}s" if "cancel" in msg.lower() else msg
            finally:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)
            rows.append((qid, db, run_no, elapsed, n, err))
            if err is not None:
                break  # first failure ends the question, as in the reference
    return spark.createDataFrame(rows, "question_id long, db_id string, run_no int, elapsed_s double, "
                                       "row_count long, error string")
