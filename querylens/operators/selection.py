"""Ranks and selections in hash order by counting, without a sort of all rows.

The order is that of a uniform hash in hexadecimal (md5 of a key), so its first
digits are buckets of known position: one aggregate counts the rows of a
stratum per bucket, running sums over at most ``16 ** DIGITS`` counts give every
bucket's first rank.  A selection of the first ``q`` rows then needs no order
but inside the one bucket that ``q`` falls into; a full rank needs one shuffle
by bucket and a sort inside each.  Both are plain lazy plans: nothing is written
when they are built, and as buckets are values, not sampled bounds, two
executions agree.

The hash comes from a key that identifies a row; rows that repeat a key are
next to each other in one bucket, in the order of a hash of all columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4


def _same(strata: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(s).eqNullSafe(F.col(f"{prefix}{s}")) for s in strata] or [F.lit(True)]


def _bucket(h: str) -> Column:
    return F.substring(h, 1, DIGITS)


def _offsets(df: DataFrame, strata: Sequence[str], h: str) -> DataFrame:
    """Per stratum and bucket its rows ``_c`` and the rows ``_before`` it; strata
    are renamed with a leading ``_o_``."""
    counts = df.groupBy(*[F.col(s).alias(f"_o_{s}") for s in strata], _bucket(h).alias("_ob")).agg(F.count(F.lit(1)).alias("_c"))
    # at most 16 ** DIGITS rows of a stratum
    before = Window.partitionBy(*[f"_o_{s}" for s in strata]).orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))


def _order(df: DataFrame, h: str) -> list[Column]:
    return [F.col(h).asc(), F.xxhash64(*df.columns).asc()]


def hash_rank(df: DataFrame, strata: Sequence[str], h: str, out: str = "_rn") -> DataFrame:
    """Add the 0-based position of every row within its stratum in the order of
    the hexadecimal hash column ``h``."""
    strata = list(strata)
    offsets = _offsets(df, strata, h).drop("_c")
    within = F.row_number().over(Window.partitionBy(*strata, "_bk").orderBy(*_order(df, h)))
    numbered = df.withColumn("_bk", _bucket(h)).withColumn("_in", within)
    joined = numbered.join(offsets, [*_same(strata, "_o_"), F.col("_bk") == F.col("_ob")])
    return joined.select(*df.columns, (F.col("_before") + F.col("_in") - 1).alias(out))


def first_rows(df: DataFrame, strata: Sequence[str], h: str, quotas: DataFrame, out: str = "_first") -> DataFrame:
    """Add whether a row is among the first ``_quota`` of its stratum in the
    order of the hexadecimal hash column ``h``.  ``quotas`` has the strata and
    ``_quota``; without a row there, or for a null stratum value without one,
    nothing is selected."""
    strata = list(strata)
    wanted = quotas.select(*[F.col(s).alias(f"_w_{s}") for s in strata], F.col("_quota"))
    known = [F.col(f"_o_{s}").eqNullSafe(F.col(f"_w_{s}")) for s in strata] or [F.lit(True)]
    # the bucket a quota falls into: one row per stratum
    cut = (_offsets(df, strata, h).join(wanted, known).where("_before < _quota").groupBy(*[f"_o_{s}" for s in strata])
           .agg(F.max("_ob").alias("_cut"), F.max_by(F.col("_quota") - F.col("_before"), "_ob").alias("_rest")))
    joined = df.withColumn("_bk", _bucket(h)).join(cut, _same(strata, "_o_"), "left")
    at = F.col("_cut").isNotNull() & (F.col("_bk") == F.col("_cut"))
    sure = joined.where(~at).select(*df.columns, F.coalesce(F.col("_bk") < F.col("_cut"), F.lit(False)).alias(out))
    within = F.row_number().over(Window.partitionBy(*strata, "_bk").orderBy(*_order(df, h)))
    open_ = joined.where(at).withColumn("_in", within).select(*df.columns, (F.col("_in") <= F.col("_rest")).alias(out))
    return sure.unionByName(open_)
