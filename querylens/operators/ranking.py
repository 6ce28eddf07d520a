"""Row numbers, prefix sums and exact quantiles without single-task groups.

A window ``partitionBy(g).orderBy(v)`` sends every row of a group to one
task; with one database (or one label) holding a third of the rows that
task becomes the job.  The helpers here instead range-partition on the full
sort key ``(group…, order…, tiebreak)``, so a hot group is spread over many
range partitions, number rows inside each partition, and add per-(partition,
group) offsets computed from a small aggregate (at most partitions + groups
rows).

Two executions of one range exchange may choose different range bounds
(the bounds come from a sample), so the sorted, id-stamped rows are
materialised once with a reliable ``checkpoint()`` into the shared folder
named by ``spark.checkpoint.dir``; every later branch reads those rows, and
the lineage is cut, so a lost executor cannot make the branches disagree.
Callers pass narrow frames (keys and the columns they need).

Quantiles need no order at all: :func:`values_at` counts values by the digits
of an order-preserving key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship

#: Right shifts of a key that leave its first 22, 43 and all bits.
SHIFTS = (42, 21, 0)
LARGE_GROUPS = 10_000

def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _num_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def rank_within(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column | str],
                sums: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Add ``_rn`` (0-based position within group in ``order``), ``_n`` (group
    size) and, for each column in ``sums``, ``_cum_<c>`` (inclusive running
    sum within the group) and ``_tot_<c>`` (group total).

    Ties in ``order`` are broken by a hash of the whole row, so equal keys
    are still spread over partitions and the numbering is deterministic up to
    rows that are identical in every column.
    """
    group_cols = list(group_cols)
    order = _cols(order)
    p = num_partitions or _num_partitions(df)
    tb = F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tb")
    keyed = df.select("*", tb)
    sort_key = [F.col(g).asc_nulls_first() for g in group_cols] + order + [F.col("_tb").asc()]
    base = (keyed.repartitionByRange(p, *sort_key)
                 .sortWithinPartitions(*sort_key)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(df.sparkSession)
    base = base.checkpoint(eager=True)
    # per (partition, group): first row id, row count and sums
    part_aggs = [F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt")]
    part_aggs += [F.sum(c).alias(f"_psum_{c}") for c in sums]
    per_part = base.groupBy("_pid", *group_cols).agg(*part_aggs)
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offs = [F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
            F.sum("_cnt").over(whole).alias("_n")]
    for c in sums:
        offs.append(F.coalesce(F.sum(f"_psum_{c}").over(before), F.lit(0)).alias(f"_poff_{c}"))
        offs.append(F.sum(f"_psum_{c}").over(whole).alias(f"_tot_{c}"))
    ren = {g: f"_og{i}" for i, g in enumerate(group_cols)}
    offsets = per_part.select(F.col("_pid").alias("_opid"), *[F.col(g).alias(ren[g]) for g in group_cols],
                              "_first", *offs)
    cond = [F.col("_pid") == F.col("_opid")] + [F.col(g).eqNullSafe(F.col(ren[g])) for g in group_cols]
    joined = base.join(offsets, on=cond, how="inner")
    out = [F.col(c) for c in df.columns]
    out.append((F.col("_off") + F.col("_mid") - F.col("_first")).alias("_rn"))
    out.append(F.col("_n"))
    if sums:
        # running sum inside each (partition, group) slice; each slice is at
        # most one range partition, so this window is bounded per task
        w = (Window.partitionBy("_pid", *group_cols)
             .orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0))
        for c in sums:
            out.append((F.col(f"_poff_{c}") + F.sum(c).over(w)).alias(f"_cum_{c}"))
            out.append(F.col(f"_tot_{c}"))
    return joined.select(*out)


def _with_key(df: DataFrame) -> DataFrame:
    """Add ``_key``, a long in the order of the double ``_v``: the exponent and
    the fraction of its magnitude as one number, with its sign.  Zeros of both
    signs are equal, NaN comes last.  Those are the bits of the double, read
    from Arrow batches."""
    def run(batches):
        for batch in batches:
            v = batch.column("_v").to_numpy(zero_copy_only=False)
            size = v.view(np.int64) & np.int64((1 << 63) - 1)
            key = np.where(np.isnan(v), np.int64((2047 << 52) + 1), np.where(np.signbit(v), -size, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "_key"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_key", T.LongType())]))


def _holding(counted: DataFrame, bucket: Sequence[str], order: str) -> DataFrame:
    """Rows of ``counted`` (``_c`` values each, in ``order`` within ``bucket``)
    that hold a position of ``_wanted``, with those positions from their start."""
    before = Window.partitionBy(*bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    here = F.filter("_wanted", lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_c")))
    held = placed.withColumn("_wanted", here).where(F.size("_wanted") > 0)
    return held.withColumn("_wanted", F.transform("_wanted", lambda w: F.struct(w["i"].alias("i"), (w["at"] - F.col("_before")).alias("at"))))


def _sized(counted: DataFrame, groups: Sequence[str], positions: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """Add the group's size ``_n`` and its positions ``_wanted`` (number, position)."""
    n = counted.withColumn("_n", F.sum("_c").over(Window.partitionBy(*groups)).cast("long"))
    at = F.array(*[p.cast("long") for p in positions(F.col("_n"))])
    return n.withColumn("_wanted", F.transform(at, lambda x, i: F.struct(i.alias("i"), x.alias("at"))))


def _by_digits(values: DataFrame, groups: list[str], positions: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """``groups, _n, _wanted, _v`` of few groups: every pass counts the values
    per further bits of their key, only the buckets that hold a wanted position
    go on, and a full key is one value."""
    ship(values.sparkSession)
    keyed = _with_key(values)
    open_ = None
    for last, shift in zip((None, *SHIFTS), SHIFTS):
        digits = F.shiftright("_key", shift).alias("_p")
        found = [F.count(F.lit(1)).alias("_c")] + ([F.max("_v").alias("_v")] if shift == 0 else [])
        if open_ is None:
            counted = _sized(keyed.groupBy(*groups, digits).agg(*found), groups, positions)
            held = _holding(counted, groups, "_p")
        else:
            same = [F.col(g).eqNullSafe(F.col(f"_o{g}")) for g in groups] + [F.shiftright("_key", last) == F.col("_up")]
            # at most one row per group and position
            rows = keyed.join(F.broadcast(open_), same)
            held = _holding(rows.groupBy(*groups, "_up", "_n", "_wanted", digits).agg(*found), [*groups, "_up"], "_p")
        open_ = held.select(*[F.col(g).alias(f"_o{g}") for g in groups], F.col("_p").alias("_up"), "_n", "_wanted")
    return held.select(*groups, "_n", "_wanted", "_v")


def values_at(df: DataFrame, value_col: str, positions: Callable[[Column], Sequence[Column]],
              group_cols: Sequence[str] = (), large_groups: int | None = LARGE_GROUPS) -> DataFrame:
    """``group…, n, values``: the sorted non-null values of each group at the
    0-based ``positions(n)``.

    Values are counted by the leading bits of an order-preserving key, 21 or 22
    more in each of three passes, so what is shuffled are counters, at most
    4 M of a bucket, however many different values there are.  That is done for the
    ``large_groups`` groups with most rows, whose few open buckets are small
    enough to broadcast; any other group has at most a ``large_groups``-th of all
    rows, and its values are aggregated to (value, count) and brought together.
    ``None`` is for groups that are few by their nature, such as columns.

    A lazy plan that reads ``df`` in several passes: its values have to be the
    same in each.  Sums of doubles over a shuffle are not, write those first.
    """
    groups = [f"_g{i}" for i in range(len(group_cols))]
    values = (df.select(*[F.col(c).alias(g) for c, g in zip(group_cols, groups)], F.col(value_col).cast("double").alias("_v"))
              .where(F.col("_v").isNotNull()))
    if groups and large_groups is not None:
        large = (values.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
                 .orderBy(F.col("_size").desc(), *groups).limit(large_groups)
                 .select(*[F.col(g).alias(f"_l{g}") for g in groups]))
        same = [F.col(g).eqNullSafe(F.col(f"_l{g}")) for g in groups]
        # at most large_groups rows
        counted = values.join(F.broadcast(large), same, "left_anti").groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
        small = _holding(_sized(counted, groups, positions), groups, "_v").select(*groups, "_n", "_wanted", "_v")
        held = _by_digits(values.join(F.broadcast(large), same, "left_semi"), groups, positions).unionByName(small)
    else:
        held = _by_digits(values, groups, positions)
    picked = (held.select(*groups, "_n", "_v", F.explode("_wanted.i").alias("_i"))
              .groupBy(*groups).agg(F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m")))
    at = [F.col("_m")[F.lit(i)] for i in range(len(positions(F.lit(0))))]
    return picked.select(*[F.col(g).alias(c) for c, g in zip(group_cols, groups)], "n", F.array(*at).alias("values"))


def exact_quantiles(df: DataFrame, value_col: str, qs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles (numpy/pandas default, DuckDB
    ``quantile_cont``) per group: columns ``group… , n, quantiles`` where
    ``quantiles`` is ``array<double>`` in the order of ``qs``.  Nulls are
    ignored."""
    def positions(n: Column) -> list[Column]:
        at = [F.lit(float(q)) * (n - 1).cast("double") for q in qs]
        return [f(x).cast("long") for x in at for f in (F.floor, F.ceil)]

    picked = values_at(df, value_col, positions, group_cols)
    outs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("n") - 1).cast("double")
        lo, hi = F.col("values")[2 * i], F.col("values")[2 * i + 1]
        outs.append(lo + (hi - lo) * (pos - F.floor(pos).cast("double")))
    return picked.select(*group_cols, "n", F.array(*outs).alias("quantiles"))


def global_quantiles(df: DataFrame, value_col: str, qs: Sequence[float]) -> list[Column]:
    """Scalar-subquery columns, one per q, holding the global quantile.

    The quantile table is one row; Spark runs it once as a subquery and the
    values are attached to every row without a join.
    """
    arr = exact_quantiles(df, value_col, qs).select("quantiles").scalar()
    return [arr[i] for i in range(len(qs))]
