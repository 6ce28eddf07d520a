"""Reachability of plan nodes: any size, any depth, missing parents, cycles."""

from pyspark.sql import functions as F

from querylens.plans.plan_tree import reachable_nodes, table_of_node, with_depth


def brute(rows):
    plans = {}
    for q, n, p in rows:
        plans.setdefault(q, {})[n] = p
    out = {}
    for q, nodes in plans.items():
        roots = [n for n, p in nodes.items() if p is None or (p == 0 and 0 not in nodes)] or [min(nodes)]
        todo = [(n, 1) for n in roots]
        while todo:
            n, d = todo.pop()
            if (q, n) not in out:
                out[q, n] = d
                todo += [(m, d + 1) for m, p in nodes.items() if p == n and m not in roots]
    return out


def test_equals_brute_force(spark):
    import random
    rnd = random.Random(1)
    rows = []
    for q in range(300):
        ids = rnd.sample(range(0, 30), rnd.randrange(1, 12))
        rows += [(q, n, rnd.choice([None, 0, *ids, 99])) for n in ids]
    rows += [(1000, n, n - 1 if n > 1 else 0) for n in range(1, 151)]            # 150 deep
    rows += [(1001, 1, 2), (1001, 2, 1), (1001, 3, 3)]                            # cycles
    df = spark.createDataFrame(rows, "query_id long, node_id int, parent_id int").repartition(4)
    got = {(r.query_id, r.node_id): r.depth for r in reachable_nodes(df).collect()}
    assert got == brute(rows)
    assert got[1000, 150] == 150
    assert reachable_nodes(df.limit(0)).count() == 0


def test_two_million_nodes(spark):
    df = spark.range(500_000).select(F.col("id").alias("query_id"), F.inline(F.array(
        *[F.struct(F.lit(n).alias("node_id"), F.lit(n - 1).alias("parent_id")) for n in range(1, 5)])))
    r = reachable_nodes(df).agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("d")).first()
    assert (r.n, r.d) == (2_000_000, 5_000_000)


def test_columns_are_carried(spark):
    df = spark.createDataFrame([("q", 1, None, "SCAN a", 7.5), ("q", 2, 5, "SCAN b", 1.0)],
                               "query_id string, node_id int, parent_id int, detail string, cost double")
    rows = with_depth(df).collect()
    assert [tuple(r) for r in rows] == [("q", 1, None, "SCAN a", 7.5, 1)]


def test_names_of_several_words(spark):
    nodes = spark.createDataFrame([(1, 1, "SCAN order details"), (2, 1, "SCAN order-log USING INDEX i"), (3, 1, "SCAN border details"),
                                   (4, 1, "SCAN orders"), (5, 1, None)], "query_id long, node_id int, detail string")
    tables = spark.createDataFrame([("Order Details", 0, 1), ("order-log", 1, 1), ("orders", 2, 1), ("log", 3, 1)],
                                   "table_name string, table_pos int, row_count int")
    got = {r.query_id: r.table_name for r in table_of_node(nodes, tables).collect()}
    assert got == {1: "Order Details", 2: "order-log", 3: None, 4: "orders", 5: None}


def test_node_classes_are_worked_out_once(spark):
    """The one-hot columns compare a class that is there, they do not search the node text again."""
    from querylens.plans import plan_tree as pt
    nodes = spark.createDataFrame([(1, 2, 0, "SCAN a")], "query_id long, node_id long, parent_id long, detail string")
    queries = spark.createDataFrame([(1, "SELECT x FROM a")], "query_id long, sql string")
    tables = spark.createDataFrame([("a", 0, 5)], "table_name string, table_pos int, row_count int")
    columns = spark.createDataFrame([("a", "x")], "table_name string, col_name string")
    indexes = spark.createDataFrame([], "table_name string, index_name string, index_sql string")
    vectors = pt.node_vectors(nodes, queries, tables, columns, indexes)
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COMPOUND") == 2             # the name of the class, and one search for it
    row = vectors.first()
    assert (row.node_type, row.f1, row.f14) == ("SCAN", 1.0, 1.0) and sum(row[f"f{i}"] for i in range(15)) == 2.0


def test_tasks_hold_a_bounded_number_of_queries(spark, monkeypatch):
    """The rows of a task do not grow with the table, and results stay."""
    from querylens.plans import plan_tree as pt
    queries = spark.createDataFrame([(i, f"SELECT a FROM t JOIN u WHERE a = {i % 7} AND b > 1") for i in range(4000)], "query_id long, sql string")
    nodes = spark.createDataFrame([(i, n, 0, d) for i in range(4000) for n, d in ((2, "SCAN t"), (3 + i % 2, "SEARCH u USING INDEX x"))],
                                  "query_id long, node_id long, parent_id long, detail string")
    tables = spark.createDataFrame([("t", 0, 10), ("u", 1, 20)], "table_name string, table_pos int, row_count int")
    columns = spark.createDataFrame([("t", "a"), ("u", "b")], "table_name string, col_name string")
    indexes = spark.createDataFrame([("u", "x", "CREATE INDEX x ON u(b)")], "table_name string, index_name string, index_sql string")

    def run():
        df = pt.plan_features(nodes, queries, tables, columns, indexes)
        rows = df.select("*", F.spark_partition_id().alias("p")).collect()
        size = {}
        for r in rows:
            size[r["p"]] = size.get(r["p"], 0) + 1
        return {r["query_id"]: r["plan_vec"] for r in rows}, max(size.values())

    plain, _ = run()
    monkeypatch.setattr(pt, "PLAN_ROWS", 50)
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "5000")      # the catalog is broadcast, the queries are not, as in large tables
    try:
        spread, largest = run()
    finally:
        spark.conf.unset(name)
    assert spread == plain and len(plain) == 4000
    assert largest < 150
