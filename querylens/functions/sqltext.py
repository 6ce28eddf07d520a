"""SQL-text functions as native column expressions.

The features are substring counts over the upper-cased text, exactly as in
the reference (not token-aware): ``' JOIN '`` needs a space on both sides,
so a join that starts a line is not counted.  Everything here is a pure
projection, evaluated inside whole-stage codegen with no Python UDF, so it
scales with the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature names and order of the reference's SQL-text feature set.
FEATURE_COLUMNS = [
    "n_tokens", "query_length", "n_joins", "n_tables_approx", "n_where_predicates",
    "has_group_by", "has_order_by", "has_having", "has_distinct", "has_limit", "has_union",
    "n_subqueries", "has_subquery", "max_nesting_depth",
    "n_count", "n_sum", "n_avg", "n_max", "n_min", "n_aggregations",
    "has_between", "has_in_clause", "has_like", "has_exists", "has_correlated_subquery",
]

# Keywords that end the WHERE part, and the aggregate call prefixes.
WHERE_STOPPERS = ["GROUP BY", "ORDER BY", "LIMIT", "HAVING", "UNION", ";"]
AGG_CALLS = ["COUNT(", "SUM(", "AVG(", "MAX(", "MIN("]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_substr(text: Column, pattern: str) -> Column:
    """Non-overlapping occurrences of ``pattern`` (Python ``str.count``)."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
    return (removed / F.lit(len(pattern))).cast("int")


def has_substr(text: Column, pattern: str) -> Column:
    return F.contains(text, F.lit(pattern)).cast("int")


def strip_sql(sql) -> Column:
    """Q1: strip surrounding whitespace, then a trailing run of ';'."""
    s = F.regexp_replace(_c(sql), r"(?U)^\s+|\s+\z", "")
    return F.regexp_replace(s, r";+\z", "")


# The dialect rewrites of Q2.
def normalize_dialect(sql) -> Column:
    """Q2: MySQL-flavoured text to SQLite-flavoured text; non-strings become ''."""
    s = F.coalesce(_c(sql).cast("string"), F.lit(""))
    s = F.replace(s, F.lit("`"), F.lit(""))
    s = F.regexp_replace(s, r"(?iU)LIMIT\s+(\d+)\s*,\s*(\d+)", "LIMIT $2 OFFSET $1")
    s = F.regexp_replace(s, r"(?iU)\bNOW\(\)", "datetime('now')")
    s = F.regexp_replace(s, r"(?isU)GROUP_CONCAT\s*\((.*?)\s+SEPARATOR\s+.*?\)", "GROUP_CONCAT($1)")
    s = F.regexp_replace(s, r"(?iU)\s+COLLATE\s+[A-Za-z0-9_]+", "")
    s = strip_sql(s)
    return F.regexp_replace(s, r"(?U)\s+\z", "")


def normalize_ws(sql) -> Column:
    """Q3: collapse whitespace runs to one space and trim."""
    return F.regexp_replace(F.regexp_replace(_c(sql), r"(?U)\s+", " "), r"^ | \z", "")


def query_key(db_id="db_id", question_id="question_id", sql="sql") -> Column:
    """K1: ``db::qid::id`` when the id is present and not blank, else ``db::sql::<normalised sql>``."""
    qid = _c(question_id).cast("string")
    db = F.coalesce(_c(db_id).cast("string"), F.lit(""))
    has_id = qid.isNotNull() & (F.trim(qid) != "")
    return F.when(has_id, F.concat(db, F.lit("::qid::"), qid)).otherwise(
        F.concat(db, F.lit("::sql::"), normalize_ws(F.coalesce(_c(sql).cast("string"), F.lit("")))))


def _where_part(u: Column) -> Column:
    pos = F.instr(u, "WHERE")
    part = F.substr(u, pos + F.lit(5))
    for stop in WHERE_STOPPERS:
        part = F.substring_index(part, stop, 1)
    return part


def nesting_depth(sql) -> Column:
    """Max running balance of '(' minus ')' (never below 0 as the start value)."""
    text = _c(sql)
    parens = F.regexp_extract_all(text, F.lit(r"[()]"), 0)
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc, ch):
        d = acc["d"] + F.when(ch == "(", 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.when(~F.contains(text, F.lit("(")), 0).otherwise(F.aggregate(parens, init, step)["m"])


def _counts(u: Column) -> dict[str, Column]:
    """The counts that several features use."""
    return {"SELECT": count_substr(u, "SELECT"), " JOIN ": count_substr(u, " JOIN "), **{c: count_substr(u, c) for c in AGG_CALLS}}


def _feature_exprs(s: Column, u: Column, wp: Column, counts: dict[str, Column], has_where: Column) -> list[Column]:
    f: dict[str, Column] = {}
    f["n_tokens"] = F.regexp_count(s, F.lit(r"(?U)\S+"))
    f["query_length"] = F.length(s)
    n_sel, f["n_joins"] = counts["SELECT"], counts[" JOIN "]
    f["n_tables_approx"] = f["n_joins"] + 1
    f["n_where_predicates"] = F.when(has_where, 1 + count_substr(wp, " AND ") + count_substr(wp, " OR ")).otherwise(0)
    for name, kw in [("has_group_by", "GROUP BY"), ("has_order_by", "ORDER BY"), ("has_having", "HAVING"),
                     ("has_distinct", "DISTINCT"), ("has_limit", "LIMIT"), ("has_union", "UNION")]:
        f[name] = has_substr(u, kw)
    f["n_subqueries"] = F.greatest(F.lit(0), n_sel - 1)
    f["has_subquery"] = (n_sel > 1).cast("int")
    f["max_nesting_depth"] = nesting_depth(s)
    for call in AGG_CALLS:
        f["n_" + call[:-1].lower()] = counts[call]
    f["n_aggregations"] = f["n_count"] + f["n_sum"] + f["n_avg"] + f["n_max"] + f["n_min"]
    f["has_between"] = has_substr(u, "BETWEEN")
    f["has_in_clause"] = (F.contains(u, F.lit(" IN (")) | F.contains(u, F.lit(" IN("))).cast("int")
    f["has_like"] = has_substr(u, "LIKE")
    f["has_exists"] = has_substr(u, "EXISTS")
    f["has_correlated_subquery"] = ((n_sel > 1) & (F.contains(u, F.lit("EXISTS")) | (count_substr(u, "WHERE") > 1))).cast("int")
    empty = s.isNull() | (s == "")
    return [F.when(empty, F.lit(None).cast("int")).otherwise(f[n].cast("int")).alias(n) for n in FEATURE_COLUMNS]


def sql_feature_columns(sql="sql") -> list[Column]:
    """The 25 SQL-text features (F1-F25) as one list of expressions; empty
    text gives nulls.  :func:`add_parsed_features` stages the shared parts."""
    s = _c(sql)
    u = F.upper(s)
    return _feature_exprs(s, u, _where_part(u), _counts(u), F.contains(u, F.lit("WHERE")))


def require_columns(df: DataFrame, cols) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def add_parsed_features(df: DataFrame, sql: str = "sql") -> DataFrame:
    """append the 25 features (requires db_id, difficulty).  The
    upper-cased text, its WHERE part and the counts that several features use are
    projected once (narrow projections, no shuffle)."""
    require_columns(df, ["db_id", "difficulty", sql])
    staged = df.select("*", F.upper(F.col(sql)).alias("_u"))
    staged = staged.select("*", F.contains(F.col("_u"), F.lit("WHERE")).alias("_hw"))
    counts = _counts(F.col("_u"))
    staged = staged.select("*", F.when(F.col("_hw"), _where_part(F.col("_u"))).alias("_wp"),
                           *[c.alias(f"_n{i}") for i, c in enumerate(counts.values())])
    once = {name: F.col(f"_n{i}") for i, name in enumerate(counts)}
    feats = _feature_exprs(F.col(sql), F.col("_u"), F.col("_wp"), once, F.col("_hw"))
    return staged.select(*df.columns, *feats)


def fill_missing_features(df: DataFrame, feature_cols=FEATURE_COLUMNS, keep=()) -> DataFrame:
    """Q10: features in manifest order with nulls as 0; a missing feature becomes 0."""
    present = set(df.columns)
    feats = [(F.coalesce(F.col(c), F.lit(0)) if c in present else F.lit(0)).alias(c) for c in feature_cols]
    return df.select(*keep, *feats)
