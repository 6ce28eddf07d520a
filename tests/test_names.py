"""Names in texts against plain regular expressions."""

import random
import re

from pyspark.sql import functions as F

from querylens.plans import plan_tree as pt
from querylens.plans.names import Names, where_text

NAMES = ["orders", "order", "Order Items", "line-item", "a", "x_1", "über", "t.b", "ord"]
PARTS = ["orders", "Order", "ORDER ITEMS", "order items", "line-item", "a", "x_1", "x_12", "Über", "t.b", "T . b", "ord", ".", " . ", ",", "(", " ", " ", "_", "-", "9"]


def texts(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(1, 9))) for _ in range(n)]


def test_whole_words():
    find = Names(NAMES)
    for t in texts(3000):
        want = {i for i, n in enumerate(NAMES) if re.search(rf"(?i)(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", t)}
        assert find.whole_words(t) == want, t
    assert Names([]).whole_words("orders") == set()


def test_references():
    columns = ["ord", "a", "x_1", "Upper", "order", "t.b"]
    parts = [*PARTS, "upper", "Upper", "orders.a", "orders .\n ord", "xorders.a", "ORDERS.UPPER", "(a"]
    rnd = random.Random(8)
    find = Names(columns)
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 8)))
        for table in ("orders", "a", "Order Items"):
            want = sum(bool(re.search(rf"(?ai)\b{re.escape(table)}\s*\.\s*{re.escape(c)}\b", t) or re.search(rf"(?a)[,\s\(]{re.escape(c)}\b", t.lower()))
                       for c in columns)
            assert find.references(t).count(table, columns) == want, (t, table)


def test_where_text():
    assert where_text("SELECT 1", ["LIMIT"]) is None
    assert where_text("SELECT 1 WHERE A = 1 ORDER BY B LIMIT 3", ["LIMIT", "ORDER BY"]) == " A = 1 "


def test_nodes_of_one_hot_text(spark):
    """A text that all rows share, null texts, ties of position."""
    nodes = spark.range(300).select(F.col("id").alias("query_id"), F.lit(1).alias("node_id"), F.lit(0).alias("parent_id"),
                                    F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "SCAN b USING a").otherwise("SCAN zz").alias("detail"))
    tables = spark.createDataFrame([("b", 1, 10), ("a", 1, 10), ("c", 0, 10)], "table_name string, table_pos int, row_count long")
    got = {(r.detail, r.table_name): r.n for r in pt.table_of_node(nodes, tables).groupBy("detail", "table_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(None, None): 100, ("SCAN b USING a", "a"): 100, ("SCAN zz", None): 100}
    plan = pt.table_of_node(nodes, tables)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
