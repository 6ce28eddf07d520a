"""SQL-text features: shared counts are worked out once a row, with the values of Python's str methods."""

import re

from pyspark.sql import functions as F

from querylens.functions.sqltext import AGG_CALLS, FEATURE_COLUMNS, add_parsed_features, count_substr, fill_missing_features, has_substr, \
    nesting_depth

TEXTS = ["", " ", ";", ")(", "((a)(b", "))))", "COUNT(COUNT(x))", "select count(*), Sum(a) from t where a in (1) and b or c",
         "SELECT 1 FROM a\nJOIN b JOIN c JOIN d WHERE x AND y OR z GROUP BY q AND r", "where", "wherewhere exists (select 1) WHERE",
         "SELECT * FROM (SELECT MAX(a), MIN(b), AVG(c) FROM t) WHERE EXISTS (SELECT 2)", "é(ß)ſum(", "x IN(1)", "a LIKE 'b' BETWEEN 1",
         "no part AND OR here", "SELECT DISTINCT a UNION SELECT b HAVING c ORDER BY d LIMIT 1"]


def _log(spark):
    return spark.createDataFrame([(t, "db", "easy") for t in [*TEXTS, None]], "sql string, db_id string, difficulty string")


def test_each_pattern_is_counted_once_a_row(spark):
    """Aggregate calls, joins and SELECTs go into several features."""
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        feats = fill_missing_features(add_parsed_features(_log(spark)), keep=["db_id"])
        plan = feats._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    for pattern in [*AGG_CALLS, " JOIN ", "SELECT"]:
        assert len(re.findall(rf"replace\([^()]*, {re.escape(pattern)}, \)", plan)) == 1, pattern


def test_features_of_odd_texts(spark):
    got = {r["sql"]: r for r in add_parsed_features(_log(spark)).collect()}
    for t in ("", None):
        assert all(got[t][c] is None for c in FEATURE_COLUMNS)
    for t in TEXTS[1:]:
        u, r = t.upper().replace("ſ", "S"), got[t]
        calls = [u.count(c) for c in AGG_CALLS]
        assert [r["n_" + c[:-1].lower()] for c in AGG_CALLS] == calls and r["n_aggregations"] == sum(calls), t
        assert r["n_joins"] == u.count(" JOIN ") == r["n_tables_approx"] - 1, t
        assert (r["has_subquery"], r["n_subqueries"]) == (int(u.count("SELECT") > 1), max(0, u.count("SELECT") - 1)), t
        part = u.split("WHERE", 1)[1] if "WHERE" in u else None
        for stop in ["GROUP BY", "ORDER BY", "LIMIT", "HAVING", "UNION", ";"]:
            part = part.split(stop, 1)[0] if part is not None else None
        assert r["n_where_predicates"] == (0 if part is None else 1 + part.count(" AND ") + part.count(" OR ")), t
        assert r["has_in_clause"] == int(" IN (" in u or " IN(" in u) and r["has_exists"] == int("EXISTS" in u), t
        depth = most = 0
        for ch in t:
            depth += (ch == "(") - (ch == ")")
            most = max(most, depth)
        assert r["max_nesting_depth"] == most, t


def test_null_texts_stay_null(spark):
    s = F.col("s")
    r = spark.createDataFrame([(None,)], "s string").select(nesting_depth(s), has_substr(s, "x"), count_substr(s, "x")).first()
    assert list(r) == [None, None, None]
