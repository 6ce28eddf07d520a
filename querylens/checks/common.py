"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sqltext import FEATURE_COLUMNS
from ..sources.fixtures import with_ctes  # noqa: F401  (re-export)

# Intermediates shared by several registered queries within one session
# (e.g. the labelled training table, one cross-validation run), materialised
# once.  ``clear_shared()`` drops them; bench.py calls it before each timing.
_SHARED: dict = {}


def shared(spark, sf_dir: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def clear_shared() -> None:
    _SHARED.clear()


def r6(c, digits: int = 6) -> Column:
    """Round half up to ``digits`` places with plain double arithmetic,
    ``floor(x * 10^d + 0.5) / 10^d``, which DuckDB evaluates bit-identically
    (see :func:`d6`); values beyond 1e12 are left as they are."""
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    rounded = F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.isnan(x) | (F.abs(x) > F.lit(1e12)), x).otherwise(rounded)


def d6(expr: str, digits: int = 6) -> str:
    """DuckDB text of :func:`r6`."""
    scale = f"{float(10 ** digits)!r}"
    return (f"(CASE WHEN isnan(({expr})::DOUBLE) OR abs({expr}) > 1e12 THEN ({expr})::DOUBLE "
            f"ELSE floor(({expr})::DOUBLE * {scale} + 0.5) / {scale} END)")


def feature_list_sql(prefix: str = "") -> str:
    return ", ".join(prefix + c for c in FEATURE_COLUMNS)


# DuckDB text of the 25 SQL-text features over a relation with column `sql`.
def _cnt(expr: str, pat: str) -> str:
    p = pat.replace("'", "''")
    return f"CAST((length({expr}) - length(replace({expr}, '{p}', ''))) / {len(pat)} AS INTEGER)"


def _has(expr: str, pat: str) -> str:
    return f"CAST(strpos({expr}, '{pat}') > 0 AS INTEGER)"


def features_sql_cte(src: str) -> str:
    """SELECT *, <25 features> FROM src  (DuckDB).  Uses a paren-depth side table."""
    u = "upper(sql)"
    wp = ("split_part(split_part(split_part(split_part(split_part(split_part("
          f"substr({u}, strpos({u}, 'WHERE') + 5), 'GROUP BY', 1), 'ORDER BY', 1), 'LIMIT', 1), 'HAVING', 1), 'UNION', 1), ';', 1)")
    nsel = _cnt(u, "SELECT")
    f = {
        "n_tokens": "CAST(len(regexp_extract_all(sql, '\\S+')) AS INTEGER)",
        "query_length": "CAST(length(sql) AS INTEGER)",
        "n_joins": _cnt(u, " JOIN "),
        "n_tables_approx": _cnt(u, " JOIN ") + " + 1",
        "n_where_predicates": f"CASE WHEN strpos({u}, 'WHERE') > 0 THEN 1 + {_cnt(wp, ' AND ')} + {_cnt(wp, ' OR ')} ELSE 0 END",
        "has_group_by": _has(u, "GROUP BY"), "has_order_by": _has(u, "ORDER BY"),
        "has_having": _has(u, "HAVING"), "has_distinct": _has(u, "DISTINCT"),
        "has_limit": _has(u, "LIMIT"), "has_union": _has(u, "UNION"),
        "n_subqueries": f"greatest(0, {nsel} - 1)",
        "has_subquery": f"CAST({nsel} > 1 AS INTEGER)",
        "max_nesting_depth": "greatest(0, coalesce(_depth.max_depth, 0))",
        "n_count": _cnt(u, "COUNT("), "n_sum": _cnt(u, "SUM("), "n_avg": _cnt(u, "AVG("),
        "n_max": _cnt(u, "MAX("), "n_min": _cnt(u, "MIN("),
        "n_aggregations": " + ".join(_cnt(u, a) for a in ["COUNT(", "SUM(", "AVG(", "MAX(", "MIN("]),
        "has_between": _has(u, "BETWEEN"),
        "has_in_clause": f"CAST(strpos({u}, ' IN (') > 0 OR strpos({u}, ' IN(') > 0 AS INTEGER)",
        "has_like": _has(u, "LIKE"), "has_exists": _has(u, "EXISTS"),
        "has_correlated_subquery": f"CAST({nsel} > 1 AND (strpos({u}, 'EXISTS') > 0 OR {_cnt(u, 'WHERE')} > 1) AS INTEGER)",
    }
    cols = ", ".join(f"CASE WHEN sql IS NULL OR sql = '' THEN NULL ELSE CAST({f[c]} AS INTEGER) END AS {c}"
                     for c in FEATURE_COLUMNS)
    # paren depth: running balance over the '(' / ')' characters of each distinct text
    depth = (f"(SELECT sql AS _dsql, max(bal) AS max_depth FROM ("
             f"SELECT sql, sum(CASE WHEN ch = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY sql ORDER BY i "
             f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal FROM ("
             f"SELECT sql, unnest(regexp_extract_all(sql, '[()]')) AS ch, generate_subscripts(regexp_extract_all(sql, '[()]'), 1) AS i "
             f"FROM (SELECT DISTINCT sql FROM {src}))) GROUP BY sql) _depth")
    return (f"SELECT {src}.*, {cols} FROM {src} LEFT JOIN {depth} ON {src}.sql = _depth._dsql")
