"""Plan-tree features from a table of plan rows.

Input tables (flat; Spark schemas cannot be recursive):

* ``nodes(query_id, node_id, parent_id, detail)`` -- EXPLAIN QUERY PLAN rows
* ``queries(query_id, sql)``
* ``tables(table_name, table_pos, row_count)`` -- catalog of the database
* ``columns(table_name, col_name)`` and ``indexes(table_name, index_name, index_sql)``

Names of the catalog are found in node and SQL texts by an automaton over all
names at once (:mod:`.names`), a text at a time within the rows' own tasks, so
no text is ever the key of a shuffle; reachability below the synthetic ROOT is computed on
the nodes of a plan held together as one array, by pointer doubling over a
whole Arrow batch of plans, without a recursion or its limits; the tree mean
is 23 summed columns per query.  Every step is keyed by query id; from
``PLAN_ROWS`` queries on the number of partitions grows with them, so that the
rows a task sorts and sums do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import count_substr
from ..session import ship
from .names import Names, where_text

# One-hot vocabularies (order matters).
OPERATOR_TYPES = ["ROOT", "SCAN", "SEARCH", "SORT", "USE_TEMP", "COMPOUND", "SUBQUERY", "COROUTINE", "LIST", "OTHER"]
ACCESS_TYPES = ["NONE", "INDEX", "COVERING_INDEX", "INTEGER_PK", "SCAN_TABLE"]
NODE_DIM = len(OPERATOR_TYPES) + len(ACCESS_TYPES) + 8
GLOBAL_DIM = 16
PLAN_ROWS = 200_000
# Keywords ending the WHERE part for node predicates, global predicates and index checks.
NODE_PRED_STOPS = ["GROUP BY", "ORDER BY", "LIMIT", "HAVING", "EXCEPT", "UNION"]
GLOBAL_PRED_STOPS = ["GROUP BY", "ORDER BY", "LIMIT", "HAVING"]


def _has(u: Column, s: str) -> Column:
    return F.instr(u, s) > 0


def classify_operator(detail) -> Column:
    """Operator index into OPERATOR_TYPES, first match wins."""
    u = F.upper(F.col(detail) if isinstance(detail, str) else detail)
    idx = OPERATOR_TYPES.index
    return (F.when(_has(u, "COMPOUND"), idx("COMPOUND"))
             .when(_has(u, "COROUTINE") | _has(u, "CO-ROUTINE"), idx("COROUTINE"))
             .when(_has(u, "SUBQUERY"), idx("SUBQUERY"))
             .when(_has(u, "SCAN") & ~_has(u, "SEARCH"), idx("SCAN"))
             .when(_has(u, "SEARCH"), idx("SEARCH"))
             .when(_has(u, "TEMP") | _has(u, "SORT") | _has(u, "ORDER"),
                   F.when(_has(u, "ORDER"), idx("SORT")).otherwise(idx("USE_TEMP")))
             .when(_has(u, "LIST"), idx("LIST"))
             .otherwise(idx("OTHER")))


def classify_access(detail) -> Column:
    """Access index into ACCESS_TYPES, first match wins."""
    u = F.upper(F.col(detail) if isinstance(detail, str) else detail)
    idx = ACCESS_TYPES.index
    return (F.when(_has(u, "COVERING INDEX"), idx("COVERING_INDEX"))
             .when(_has(u, "USING INDEX") | _has(u, "USING INTEGER PRIMARY KEY"),
                   F.when(_has(u, "INTEGER PRIMARY KEY"), idx("INTEGER_PK")).otherwise(idx("INDEX")))
             .when(_has(u, "SCAN"), idx("SCAN_TABLE"))
             .otherwise(idx("NONE")))


def where_part(u: Column, stops) -> Column:
    part = F.substr(u, F.instr(u, "WHERE") + F.lit(5))
    for s in stops:
        part = F.substring_index(part, s, 1)
    return part


def plan_partitions(queries: DataFrame) -> int:
    """Partitions for rows keyed by query id, about ``PLAN_ROWS`` queries each;
    0 (the session's) for tables of no more than that."""
    n = queries.count()
    return max(-(-n // PLAN_ROWS), queries.sparkSession.sparkContext.defaultParallelism) if n > PLAN_ROWS else 0


def _spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def table_of_node(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """First catalog table (by position) named as a whole word in the
    node text, case-insensitively.  The rows stay where they are: every Arrow
    batch matches its distinct texts against all names at once.  The catalog
    of one database is the bound of what travels with the tasks."""
    ship(nodes.sparkSession)
    # ties of position: the smaller name
    known = sorted((r["table_pos"], r["table_name"]) for r in tables.select("table_name", "table_pos").distinct().collect())
    names = [n for _, n in known]

    def match(batches):
        import pyarrow as pa
        find = Names(names)
        for batch in batches:
            text = batch.column("detail").dictionary_encode()
            first = [min(find.whole_words(t), default=None) if t is not None else None for t in text.dictionary.to_pylist()]
            found = pa.array([None if i is None else names[i] for i in first], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found.take(text.indices)], names=[*batch.schema.names, "table_name"])

    schema = T.StructType([*nodes.schema.fields, T.StructField("table_name", T.StringType())])
    return nodes.mapInArrow(match, schema).select("detail", *[c for c in nodes.columns if c != "detail"], "table_name")


def with_depth(nodes: DataFrame) -> DataFrame:
    """P4 + P5: the rows of ``nodes`` that are reachable from the synthetic
    ROOT, with ``depth`` (ROOT children have depth 1).  Top level: null parent,
    or parent 0 when no node 0 exists; without any top-level node the smallest
    id is the only root.  Nodes below a missing non-zero parent, and cycles
    without a root, are unreachable.

    A plan's rows are gathered into one array (a plan is bounded by its SQL
    text; node ids are unique in it), so there is no join per level and no
    limit of depth.
    """
    plans = nodes.groupBy("query_id").agg(F.collect_list(F.struct(
        F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"),
        *[c for c in nodes.columns if c not in ("query_id", "node_id", "parent_id")])).alias("nodes"))

    def depths(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            lists = batch.column("nodes")
            size = np.diff(lists.offsets.to_numpy())
            rows = lists.flatten()
            n = len(rows)
            if not n:
                continue
            plan = np.repeat(np.arange(len(size)), size)
            node = rows.field("node_id").to_numpy()
            parents = rows.field("parent_id")
            no_parent = np.asarray(parents.is_null())
            parent = parents.fill_null(0).to_numpy()
            order = np.lexsort((node, plan))
            first = np.concatenate([[0], np.cumsum(size)])
            # row of the parent, n where it is missing
            name = np.unique(np.concatenate([node, parent]), return_inverse=True)[1]
            width = int(name.max()) + 1
            key = plan * width + name[:n]
            wanted = plan * width + name[n:]
            at = np.minimum(np.searchsorted(key[order], wanted), n - 1)
            up = np.where(~no_parent & (key[order][at] == wanted), order[at], n)
            root = no_parent | ((parent == 0) & (up == n))
            rootless = np.flatnonzero((np.bincount(plan[root], minlength=len(size)) == 0) & (size > 0))
            root[order[first[rootless]]] = True      # the smallest id
            # ancestor and distance, doubled until every pointer rests
            up = np.append(np.where(root, np.arange(n), up), n)
            far = np.append(np.where(root, 0, 1), 0)
            for _ in range(int(size.max()).bit_length() + 1):
                far = far + far[up]
                up = up[up]
            reached = np.append(root, False)[up[:n]]
            keep = pa.array(np.flatnonzero(reached))
            out = rows.take(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(plan[reached]))] + [out.field(i) for i in range(out.type.num_fields)]
                + [pa.array((far[:n][reached] + 1).astype(np.int32))],
                names=["query_id", *[out.type.field(i).name for i in range(out.type.num_fields)], "depth"])

    inner = plans.schema["nodes"].dataType.elementType.fields
    schema = T.StructType([plans.schema["query_id"], *inner, T.StructField("depth", T.IntegerType())])
    found = plans.mapInArrow(depths, schema)
    return found.select(*[F.col(c).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns], "depth")


def reachable_nodes(nodes: DataFrame) -> DataFrame:
    """P4 + P5 as ``(query_id, node_id, depth)``; see :func:`with_depth`."""
    return with_depth(nodes.select("query_id", "node_id", "parent_id")).select("query_id", "node_id", "depth")


def catalog_table_stats(tables: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Per catalog table: 1-based order position, #tables, row count,
    #columns and the columns covered by some index (whole word in its SQL)."""
    ncol = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    w = Window.orderBy("table_pos")  # catalog of one database: a handful of rows
    t = tables.select("table_name", "row_count", F.row_number().over(w).alias("order_pos"),
                      F.count(F.lit(1)).over(Window.partitionBy()).alias("n_tables"))
    return t.join(ncol, "table_name", "left").fillna(0, ["n_columns"])


def indexed_columns(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """(table_name, col_name) pairs whose name appears as a whole word in an index definition."""
    j = columns.join(indexes, "table_name")
    pat = F.concat(F.lit(r"(?i)\b\Q"), F.col("col_name"), F.lit(r"\E\b"))
    return j.where(F.rlike(F.col("index_sql"), pat)).select("table_name", "col_name").distinct()


def query_table_features(pairs: DataFrame, queries: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """P7 + P8 per (query, table): referenced-column count (cap 20) and an
    index on a predicate column.  Every Arrow batch looks at a distinct SQL
    text once; the columns of one database's catalog travel with the tasks.
    ``cols_ref`` is null for a table without columns in the catalog,
    ``has_idx_pred`` without such an index."""
    ship(queries.sparkSession)
    of_table: dict[str, list[str]] = {}
    for r in columns.select("table_name", "col_name").collect():
        of_table.setdefault(r["table_name"], []).append(r["col_name"])
    indexed: dict[str, list[str]] = {}
    for r in indexed_columns(columns, indexes).collect():
        indexed.setdefault(r["table_name"], []).append(r["col_name"].upper())
    names = sorted({c for some in of_table.values() for c in some})

    def features(batches):
        import pyarrow as pa
        find = Names(names)
        for batch in batches:
            texts: dict = {}
            refs, preds = [], []
            for sql, table in zip(batch.column("sql").to_pylist(), batch.column("table_name").to_pylist()):
                mine = of_table.get(table)
                if sql is None or mine is None:
                    refs.append(None if mine is None else 0)
                    preds.append(None)
                    continue
                if sql not in texts:
                    texts[sql] = find.references(sql), where_text(sql.upper(), GLOBAL_PRED_STOPS), {}
                seen, where, known = texts[sql]
                if table not in known:
                    known[table] = (min(20, seen.count(table, mine)),
                                    1.0 if where is not None and any(c in where for c in indexed.get(table, ())) else None)
                refs.append(known[table][0])
                preds.append(known[table][1])
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("table_name"), pa.array(refs, pa.int64()), pa.array(preds, pa.float64())],
                                             names=["query_id", "table_name", "cols_ref", "has_idx_pred"])

    q = pairs.select("query_id", "table_name").join(queries.select("query_id", "sql"), "query_id")
    schema = T.StructType([q.schema["query_id"], q.schema["table_name"], T.StructField("cols_ref", T.LongType()),
                           T.StructField("has_idx_pred", T.DoubleType())])
    return q.mapInArrow(features, schema)


def predicate_count(sql) -> Column:
    """0 without WHERE, else max(1, #AND + #OR) in the WHERE part."""
    u = F.upper(F.col(sql) if isinstance(sql, str) else sql)
    wp = where_part(u, NODE_PRED_STOPS)
    return F.when(_has(u, "WHERE"), F.greatest(F.lit(1), count_substr(wp, " AND ") + count_substr(wp, " OR "))).otherwise(0)


def node_vectors(nodes: DataFrame, queries: DataFrame, tables: DataFrame, columns: DataFrame,
                 indexes: DataFrame) -> DataFrame:
    """The 23 node features as columns f0..f22 for every reachable node."""
    parts = plan_partitions(queries)
    queries = _spread(queries, parts, "query_id")
    # classes worked out once per node: behind an Arrow pass they are columns, not expressions
    reached = with_depth(_spread(nodes, parts, "query_id"))
    nd = table_of_node(reached.withColumns({"_op": classify_operator("detail"), "_ac": classify_access("detail")}), tables)
    stats = catalog_table_stats(tables, columns, indexes)
    named = table_of_node(reached.select("query_id", "detail"), tables).where(F.col("table_name").isNotNull())
    pairs = _spread(named.select("query_id", "table_name"), parts, "query_id").distinct()
    qt = _spread(query_table_features(pairs, queries, columns, indexes), parts, "query_id", "table_name")
    x = (_spread(nd, parts, "query_id", "table_name").join(stats, "table_name", "left").join(qt, ["query_id", "table_name"], "left")
           .join(queries.select("query_id", predicate_count("sql").alias("_preds")), "query_id", "left"))
    known = F.col("row_count").isNotNull()
    op, ac = F.col("_op"), F.col("_ac")
    feats = [F.when(op == i, 1.0).otherwise(0.0) for i in range(len(OPERATOR_TYPES))]
    feats += [F.when(ac == i, 1.0).otherwise(0.0) for i in range(len(ACCESS_TYPES))]
    rows = F.greatest(F.col("row_count").cast("double"), F.lit(0.0))
    rest = [
        F.when(known, F.col("order_pos") / F.greatest(F.col("n_tables"), F.lit(1))).otherwise(0.0),
        F.when(known, F.log1p(rows) / 25.0).otherwise(0.0),
        F.when(known, F.least(F.col("n_columns"), F.lit(100)) / 100.0).otherwise(0.0),
        F.when(known, F.coalesce(F.col("cols_ref"), F.lit(0)) / 20.0).otherwise(0.0),
        F.when(known, F.coalesce(F.col("has_idx_pred"), F.lit(0.0))).otherwise(0.0),
        F.when(known, F.least(F.lit(1.0), 10.0 / F.greatest(F.col("row_count").cast("double"), F.lit(1.0)))).otherwise(0.1),
        F.when(known, F.least(F.coalesce(F.col("_preds"), F.lit(0)), F.lit(20)) / 20.0).otherwise(0.0),
        F.lit(1.0),
    ]
    allf = [c.cast("double").alias(f"f{i}") for i, c in enumerate(feats + rest)]
    return x.select("query_id", "node_id", "depth", "detail", "table_name",
                    F.element_at(F.array(*[F.lit(o) for o in OPERATOR_TYPES]), op + 1).alias("node_type"),
                    *allf)


def root_vector(n_tables: Column) -> list[Column]:
    """P10: the ROOT node's 23 features."""
    v = [F.lit(1.0 if i == 0 else 0.0) for i in range(len(OPERATOR_TYPES))]
    v += [F.lit(1.0 if i == 0 else 0.0) for i in range(len(ACCESS_TYPES))]
    v += [F.lit(0.0), F.log1p(n_tables.cast("double") * 100) / 25.0, F.lit(0.0), F.lit(0.0), F.lit(0.0),
          F.lit(0.1), F.lit(0.0), F.lit(1.0)]
    return v


def tree_mean(nodes: DataFrame, queries: DataFrame, tables: DataFrame, columns: DataFrame,
              indexes: DataFrame) -> DataFrame:
    """Element-wise mean over ROOT and all reachable nodes (t0..t22).
    Queries without plan rows have no row (P14 keeps only planned queries)."""
    nv = node_vectors(nodes, queries, tables, columns, indexes)
    sums = nv.groupBy("query_id").agg(F.count(F.lit(1)).alias("_k"),
                                      *[F.sum(f"f{i}").alias(f"_s{i}") for i in range(NODE_DIM)])
    n_tables = tables.agg(F.count(F.lit(1))).scalar()
    root = root_vector(n_tables)
    return sums.select("query_id", *[((F.col(f"_s{i}") + root[i]) / (F.col("_k") + 1)).alias(f"t{i}")
                                     for i in range(NODE_DIM)])


def referenced_tables(queries: DataFrame) -> DataFrame:
    """Distinct identifiers after FROM / JOIN (unquoted), per query."""
    s = F.col("sql")
    names = F.array_distinct(F.concat(
        F.regexp_extract_all(s, F.lit(r"(?i)FROM\s+([A-Za-z_][A-Za-z0-9_]*)"), 1),
        F.regexp_extract_all(s, F.lit(r"(?i)JOIN\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)))
    return queries.select("query_id", F.explode(names).alias("ref_table"))


def estimated_rows(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Sum of catalog row counts over the referenced tables (case-sensitive names)."""
    ref = referenced_tables(queries)
    t = tables.select(F.col("table_name").alias("ref_table"), "row_count")
    est = ref.join(t, "ref_table").groupBy("query_id").agg(F.sum("row_count").alias("est_rows"))
    return queries.select("query_id").join(est, "query_id", "left").fillna(0, ["est_rows"])


def global_vector(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """The 16 query-level features g0..g15."""
    queries = _spread(queries, plan_partitions(queries), "query_id")
    s = F.col("sql")
    u = F.upper(s)
    joins = count_substr(u, " JOIN ")
    froms = count_substr(u, " FROM ")
    total_tables = F.least(F.lit(10), F.greatest(F.lit(1), F.when(joins > 0, joins + 1).otherwise(froms)))
    wp = where_part(u, GLOBAL_PRED_STOPS)
    pred = F.least(F.when(_has(u, "WHERE"), 1 + count_substr(wp, " AND ") + count_substr(wp, " OR ")).otherwise(0),
                   F.lit(20))
    agg_idx = (F.when(_has(u, "COUNT("), 1).when(_has(u, "SUM("), 2).when(_has(u, "AVG("), 3)
                .when(_has(u, "MIN("), 4).when(_has(u, "MAX("), 5).otherwise(0))
    est = estimated_rows(queries, tables)
    q = queries.join(est, "query_id", "left")

    def flag(c):
        return F.when(c, 1.0).otherwise(0.0)

    g = [total_tables / 10.0, pred / 20.0, flag(_has(u, "GROUP BY")), flag(_has(u, "ORDER BY")),
         flag(_has(u, "DISTINCT")), flag(_has(u, "LIMIT")), flag(count_substr(u, "SELECT") > 1),
         flag(agg_idx > 0), F.length(s) / 5000.0, F.log1p(F.col("est_rows").cast("double")) / 30.0]
    g += [flag(agg_idx == i) for i in range(6)]
    return q.select("query_id", *[c.cast("double").alias(f"g{i}") for i, c in enumerate(g)])


def plan_features(nodes: DataFrame, queries: DataFrame, tables: DataFrame, columns: DataFrame,
                  indexes: DataFrame) -> DataFrame:
    """P14 + P16: tree mean and global vector per planned query, and their
    39-value concatenation ``plan_vec``."""
    tm = tree_mean(nodes, queries, tables, columns, indexes)
    gv = global_vector(queries, tables)
    j = tm.join(gv, "query_id")
    tree = F.array(*[F.col(f"t{i}") for i in range(NODE_DIM)])
    glob = F.array(*[F.col(f"g{i}") for i in range(GLOBAL_DIM)])
    return j.select("query_id", tree.alias("tree_vec"), glob.alias("global_vec"), F.concat(tree, glob).alias("plan_vec"))


def db_from_query_id(qid) -> Column:
    """``synth_<db>_...`` gives <db>; anything else 'unknown'."""
    q = F.col(qid) if isinstance(qid, str) else qid
    parts = F.split(q, "_")
    return F.when(q.startswith("synth_") & (F.size(parts) >= 3), parts[1]).otherwise(F.lit("unknown"))
