"""Plan-tree feature queries (P1-P16) over the plan-row fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import plan_tree as pt
from ..registry import register
from ..sources import fixtures as fx
from .common import d6, r6


def _inputs(spark, sf):
    nodes = fx.plan_nodes(spark, sf)
    queries = fx.query_log(spark, sf).select(F.col("question_id").alias("query_id"), "sql")
    return nodes, queries, fx.named_tables(spark, sf), fx.named_columns(spark, sf), fx.named_indexes(spark)


# ---- DuckDB text ------------------------------------------------------------
def _has(e, s):
    return f"strpos({e}, '{s}') > 0"


def _op(d="upper(detail)"):
    return (f"CASE WHEN {_has(d, 'COMPOUND')} THEN 5 WHEN {_has(d, 'COROUTINE')} OR {_has(d, 'CO-ROUTINE')} THEN 7 "
            f"WHEN {_has(d, 'SUBQUERY')} THEN 6 WHEN {_has(d, 'SCAN')} AND NOT {_has(d, 'SEARCH')} THEN 1 "
            f"WHEN {_has(d, 'SEARCH')} THEN 2 WHEN {_has(d, 'TEMP')} OR {_has(d, 'SORT')} OR {_has(d, 'ORDER')} "
            f"THEN (CASE WHEN {_has(d, 'ORDER')} THEN 3 ELSE 4 END) WHEN {_has(d, 'LIST')} THEN 8 ELSE 9 END")


def _ac(d="upper(detail)"):
    return (f"CASE WHEN {_has(d, 'COVERING INDEX')} THEN 2 WHEN {_has(d, 'USING INDEX')} OR {_has(d, 'USING INTEGER PRIMARY KEY')} "
            f"THEN (CASE WHEN {_has(d, 'INTEGER PRIMARY KEY')} THEN 3 ELSE 1 END) WHEN {_has(d, 'SCAN')} THEN 4 ELSE 0 END")


def _wp(stops, u="upper(sql)"):
    e = f"substr({u}, strpos({u}, 'WHERE') + 5)"
    for s in stops:
        e = f"split_part({e}, '{s}', 1)"
    return e


def _cnt(e, p):
    return f"((length({e}) - length(replace({e}, '{p}', ''))) // {len(p)})"


_BASE = [
    ("plan_nodes", fx.DUCKDB_CTES["plan_nodes"]), ("query_log", fx.DUCKDB_CTES["query_log"]),
    ("tb", fx.DUCKDB_CTES["named_tables"]), ("cols", fx.DUCKDB_CTES["named_columns"]),
    ("idx", fx.DUCKDB_CTES["named_indexes"]),
    ("q", "SELECT question_id AS query_id, sql FROM query_log"),
    ("flag", """SELECT n.*, EXISTS (SELECT 1 FROM plan_nodes p WHERE p.query_id = n.query_id AND p.node_id = n.parent_id) AS pe
               FROM plan_nodes n"""),
    ("top", "SELECT query_id, node_id FROM flag WHERE parent_id IS NULL OR (parent_id = 0 AND NOT pe)"),
    ("roots", """SELECT * FROM top UNION ALL SELECT query_id, min(node_id) FROM plan_nodes
                WHERE query_id NOT IN (SELECT query_id FROM top) GROUP BY query_id"""),
    ("r(query_id, node_id, depth, path)", """SELECT query_id, node_id, 1, [node_id] FROM roots UNION ALL
        SELECT n.query_id, n.node_id, r.depth + 1, list_append(r.path, n.node_id) FROM r JOIN plan_nodes n
          ON n.query_id = r.query_id AND n.parent_id = r.node_id WHERE NOT list_contains(r.path, n.node_id)"""),
    ("rn", "SELECT n.*, r.depth FROM plan_nodes n JOIN r ON n.query_id = r.query_id AND n.node_id = r.node_id"),
    ("hit", """SELECT query_id, node_id, arg_min(table_name, table_pos) AS table_name FROM (
                 SELECT query_id, node_id, unnest(list_distinct(regexp_extract_all(lower(detail), '\\w+'))) AS tok FROM rn) x
               JOIN tb ON lower(tb.table_name) = x.tok GROUP BY query_id, node_id"""),
    ("nt", "SELECT rn.*, hit.table_name FROM rn LEFT JOIN hit ON rn.query_id = hit.query_id AND rn.node_id = hit.node_id"),
    ("pairs", "SELECT DISTINCT query_id, table_name FROM nt WHERE table_name IS NOT NULL"),
    ("cref", """SELECT p.query_id, p.table_name, least(count(*) FILTER (WHERE
                  regexp_matches(q.sql, concat('\\b\\Q', c.table_name, '\\E\\s*\\.\\s*\\Q', c.col_name, '\\E\\b'), 'i')
                  OR regexp_matches(lower(q.sql), concat('[,\\s\\(]\\Q', c.col_name, '\\E\\b'))), 20) AS cols_ref
               FROM pairs p JOIN q ON p.query_id = q.query_id JOIN cols c ON c.table_name = p.table_name GROUP BY p.query_id, p.table_name"""),
    ("ic", """SELECT DISTINCT c.table_name, c.col_name FROM cols c JOIN idx i ON c.table_name = i.table_name
              WHERE regexp_matches(i.index_sql, concat('\\b\\Q', c.col_name, '\\E\\b'), 'i')"""),
    ("hidx", f"""SELECT DISTINCT p.query_id, p.table_name, 1.0 AS has_idx_pred FROM pairs p JOIN q ON p.query_id = q.query_id
               JOIN ic ON ic.table_name = p.table_name
               WHERE strpos(upper(q.sql), 'WHERE') > 0 AND strpos({_wp(pt.GLOBAL_PRED_STOPS, 'upper(q.sql)')}, upper(ic.col_name)) > 0"""),
    ("tstat", """SELECT tb.table_name, tb.row_count, row_number() OVER (ORDER BY table_pos) AS order_pos, count(*) OVER () AS n_tables,
                  coalesce(nc.n, 0) AS n_columns FROM tb LEFT JOIN (SELECT table_name, count(*) AS n FROM cols GROUP BY table_name) nc
                  ON tb.table_name = nc.table_name"""),
    ("preds", f"""SELECT query_id, CASE WHEN strpos(upper(sql), 'WHERE') > 0 THEN
                   greatest(1, {_cnt(_wp(pt.NODE_PRED_STOPS), ' AND ')} + {_cnt(_wp(pt.NODE_PRED_STOPS), ' OR ')}) ELSE 0 END AS preds FROM q"""),
]


def _node_feats():
    op, ac = _op(), _ac()
    f = [f"CASE WHEN {op} = {i} THEN 1.0 ELSE 0.0 END" for i in range(10)]
    f += [f"CASE WHEN {ac} = {i} THEN 1.0 ELSE 0.0 END" for i in range(5)]
    k = "tstat.row_count IS NOT NULL"
    f += [f"CASE WHEN {k} THEN order_pos / greatest(n_tables, 1) ELSE 0.0 END",
          f"CASE WHEN {k} THEN ln(1 + greatest(tstat.row_count::DOUBLE, 0.0)) / 25.0 ELSE 0.0 END",
          f"CASE WHEN {k} THEN least(n_columns, 100) / 100.0 ELSE 0.0 END",
          f"CASE WHEN {k} THEN coalesce(cols_ref, 0) / 20.0 ELSE 0.0 END",
          f"CASE WHEN {k} THEN coalesce(has_idx_pred, 0.0) ELSE 0.0 END",
          f"CASE WHEN {k} THEN least(1.0, 10.0 / greatest(tstat.row_count::DOUBLE, 1.0)) ELSE 0.1 END",
          f"CASE WHEN {k} THEN least(coalesce(preds, 0), 20) / 20.0 ELSE 0.0 END", "1.0"]
    return f


_NV = ("nv", "SELECT nt.query_id, nt.node_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS f{i}" for i, e in enumerate(_node_feats()))
       + """ FROM nt LEFT JOIN tstat ON nt.table_name = tstat.table_name
             LEFT JOIN cref ON nt.query_id = cref.query_id AND nt.table_name = cref.table_name
             LEFT JOIN hidx ON nt.query_id = hidx.query_id AND nt.table_name = hidx.table_name
             LEFT JOIN preds ON nt.query_id = preds.query_id""")


def _root():
    v = ["1.0"] + ["0.0"] * 9 + ["1.0"] + ["0.0"] * 4
    v += ["0.0", "ln(1 + (SELECT count(*) FROM tb) * 100.0) / 25.0", "0.0", "0.0", "0.0", "0.1", "0.0", "1.0"]
    return v


_TM = ("tm", "SELECT query_id, " + ", ".join(f"(sum(f{i}) + {r}) / (count(*) + 1) AS t{i}" for i, r in enumerate(_root()))
       + " FROM nv GROUP BY query_id")


def _global_sql():
    u = "upper(sql)"
    j, fr = _cnt(u, " JOIN "), _cnt(u, " FROM ")
    wp = _wp(pt.GLOBAL_PRED_STOPS)
    pred = f"least(CASE WHEN {_has(u, 'WHERE')} THEN 1 + {_cnt(wp, ' AND ')} + {_cnt(wp, ' OR ')} ELSE 0 END, 20)"
    agg = (f"CASE WHEN {_has(u, 'COUNT(')} THEN 1 WHEN {_has(u, 'SUM(')} THEN 2 WHEN {_has(u, 'AVG(')} THEN 3 "
           f"WHEN {_has(u, 'MIN(')} THEN 4 WHEN {_has(u, 'MAX(')} THEN 5 ELSE 0 END")

    def fl(c):
        return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"

    g = [f"least(10, greatest(1, CASE WHEN {j} > 0 THEN {j} + 1 ELSE {fr} END)) / 10.0", f"{pred} / 20.0",
         fl(_has(u, "GROUP BY")), fl(_has(u, "ORDER BY")), fl(_has(u, "DISTINCT")), fl(_has(u, "LIMIT")),
         fl(f"{_cnt(u, 'SELECT')} > 1"), fl(f"{agg} > 0"), "length(sql) / 5000.0", "ln(1 + coalesce(est.est_rows, 0)) / 30.0"]
    g += [fl(f"{agg} = {i}") for i in range(6)]
    return g


_EST = [("refs", """SELECT DISTINCT query_id, unnest(list_concat(regexp_extract_all(sql, '(?i)FROM\\s+([A-Za-z_][A-Za-z0-9_]*)', 1),
                                                     regexp_extract_all(sql, '(?i)JOIN\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))) AS ref_table FROM q"""),
        ("est", "SELECT refs.query_id, sum(tb.row_count) AS est_rows FROM refs JOIN tb ON tb.table_name = refs.ref_table GROUP BY refs.query_id")]
_GV = ("gv", "SELECT q.query_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS g{i}" for i, e in enumerate(_global_sql()))
       + " FROM q LEFT JOIN est ON q.query_id = est.query_id")


def _with(body, extra=()):
    parts = list(_BASE) + list(extra)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + body


register("p1_classify_operator", _with(f"SELECT query_id, node_id, {_op()} AS op_index FROM plan_nodes"))(
    lambda spark, sf: fx.plan_nodes(spark, sf).select("query_id", "node_id", pt.classify_operator("detail").alias("op_index")))

register("p2_classify_access", _with(f"SELECT query_id, node_id, {_ac()} AS access_index FROM plan_nodes"))(
    lambda spark, sf: fx.plan_nodes(spark, sf).select("query_id", "node_id", pt.classify_access("detail").alias("access_index")))

register("p3_table_of_node", _with("SELECT query_id, node_id, table_name FROM nt"))(
    lambda spark, sf: pt.table_of_node(pt.with_depth(fx.plan_nodes(spark, sf)), fx.named_tables(spark, sf)).select("query_id", "node_id", "table_name"))

register("p5_reachable_nodes", _with("SELECT query_id, node_id, depth FROM r"))(
    lambda spark, sf: pt.reachable_nodes(fx.plan_nodes(spark, sf)))

register("p6_predicate_count", _with("SELECT query_id, CAST(preds AS INTEGER) AS preds FROM preds"))(
    lambda spark, sf: fx.query_log(spark, sf).select(F.col("question_id").alias("query_id"),
                                                     pt.predicate_count("sql").cast("int").alias("preds")))


def _p78(spark, sf):
    nodes, queries, tables, columns, indexes = _inputs(spark, sf)
    nd = pt.table_of_node(pt.with_depth(nodes), tables)
    pairs = nd.where(F.col("table_name").isNotNull()).select("query_id", "table_name").distinct()
    out = pt.query_table_features(pairs, queries, columns, indexes)
    return out.select("query_id", "table_name", F.coalesce("cols_ref", F.lit(0)).cast("long").alias("cols_ref"),
                      F.coalesce("has_idx_pred", F.lit(0.0)).alias("has_idx_pred"))


register("p7_p8_query_table_features", _with(
    """SELECT p.query_id, p.table_name, coalesce(cref.cols_ref, 0)::BIGINT AS cols_ref, coalesce(hidx.has_idx_pred, 0.0)::DOUBLE AS has_idx_pred
       FROM pairs p LEFT JOIN cref ON p.query_id = cref.query_id AND p.table_name = cref.table_name
       LEFT JOIN hidx ON p.query_id = hidx.query_id AND p.table_name = hidx.table_name"""))(_p78)

register("p9_node_vectors", _with(
    "SELECT query_id, node_id, " + ", ".join(d6(f"f{i}") + f" AS f{i}" for i in range(pt.NODE_DIM)) + " FROM nv", [_NV]))(
    lambda spark, sf: pt.node_vectors(*_inputs(spark, sf)).select(
        "query_id", "node_id", *[r6(f"f{i}").alias(f"f{i}") for i in range(pt.NODE_DIM)]))

register("p11_tree_mean", _with(
    "SELECT query_id, " + ", ".join(d6(f"t{i}") + f" AS t{i}" for i in range(pt.NODE_DIM)) + " FROM tm", [_NV, _TM]))(
    lambda spark, sf: pt.tree_mean(*_inputs(spark, sf)).select(
        "query_id", *[r6(f"t{i}").alias(f"t{i}") for i in range(pt.NODE_DIM)]))

register("p12_global_vector", _with(
    "SELECT query_id, " + ", ".join(d6(f"g{i}") + f" AS g{i}" for i in range(pt.GLOBAL_DIM)) + " FROM gv", _EST + [_GV]))(
    lambda spark, sf: pt.global_vector(_inputs(spark, sf)[1], fx.named_tables(spark, sf)).select(
        "query_id", *[r6(f"g{i}").alias(f"g{i}") for i in range(pt.GLOBAL_DIM)]))

register("p13_estimated_rows", _with(
    "SELECT q.query_id, coalesce(est.est_rows, 0)::BIGINT AS est_rows FROM q LEFT JOIN est ON q.query_id = est.query_id", _EST))(
    lambda spark, sf: pt.estimated_rows(_inputs(spark, sf)[1], fx.named_tables(spark, sf)).select(
        "query_id", F.col("est_rows").cast("long").alias("est_rows")))


def _p16(spark, sf):
    pf = pt.plan_features(*_inputs(spark, sf))
    return pf.select("query_id", F.posexplode("plan_vec").alias("pos", "value")).select(
        "query_id", F.col("pos").cast("int").alias("pos"), r6("value").alias("value"))


register("p16_plan_vector_long", _with(
    "SELECT query_id, pos, " + d6("v") + " AS value FROM (SELECT tm.query_id, unnest(["
    + ", ".join(f"t{i}" for i in range(pt.NODE_DIM)) + ", " + ", ".join(f"g{i}" for i in range(pt.GLOBAL_DIM))
    + "]) AS v, CAST(generate_subscripts([" + ", ".join(f"t{i}" for i in range(pt.NODE_DIM)) + ", "
    + ", ".join(f"g{i}" for i in range(pt.GLOBAL_DIM)) + "], 1) - 1 AS INTEGER) AS pos FROM tm JOIN gv ON tm.query_id = gv.query_id)",
    [_NV, _TM] + _EST + [_GV]))(_p16)


def _p15(spark, sf):
    q = fx.query_log(spark, sf)
    qid = F.concat(F.when(F.col("difficulty") == "simple", "synth_").otherwise("bird_"), F.col("db_id"), F.lit("_"),
                   F.col("question_id").cast("string"))
    return q.select("question_id", pt.db_from_query_id(qid).alias("db_from_id"))


register("p15_db_from_query_id", fx.with_ctes(
    """SELECT question_id, CASE WHEN starts_with(qid, 'synth_') AND len(string_split(qid, '_')) >= 3
         THEN string_split(qid, '_')[2] ELSE 'unknown' END AS db_from_id
       FROM (SELECT question_id, concat(CASE WHEN difficulty = 'simple' THEN 'synth_' ELSE 'bird_' END, db_id, '_',
             CAST(question_id AS VARCHAR)) AS qid FROM query_log)""", "query_log"))(_p15)

_ARRAYS = ", ".join("[" + ", ".join(d6(f"{v}{i}") for i in range(n)) + f"] AS {name}"
                    for name, v, n in (("tree_vec", "t", pt.NODE_DIM), ("global_vec", "g", pt.GLOBAL_DIM)))
register("p14_plan_features", _with(f"SELECT tm.query_id, {_ARRAYS} FROM tm JOIN gv ON tm.query_id = gv.query_id", [_NV, _TM] + _EST + [_GV]))(
    lambda spark, sf: pt.plan_features(*_inputs(spark, sf)).select(
        "query_id", *[F.transform(c, lambda x: r6(x)).alias(c) for c in ("tree_vec", "global_vec")]))
