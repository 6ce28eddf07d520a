"""Deterministic splits, folds and stratified samples.

Random permutations of the reference cannot be reproduced; rows are ordered
by ``md5(key || '|' || seed)`` instead, which DuckDB computes identically.
Sizes follow the reference: test size ``ceil(test_size * n)``, strata in
proportion with largest remainders (integer arithmetic, ties by class).
A selection counts rows per leading digits of the hash and orders only the
bucket a quota falls into (:mod:`.selection`), so no stratum is sorted or
gathered into a single task and nothing is written; quota tables have one row
per stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import first_rows, hash_rank

# Fixed values (reference configuration).
SEED = 42
TEST_SIZE = 0.2
MIN_QUERIES = 15
HOLDOUT_DATABASES = ["formula_1", "financial"]


def shuffle_key(key_col: str = "question_id", seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(key_col).cast("string"), F.lit("|"), F.lit(str(seed))))


def split_holdout(df: DataFrame, dbs: Sequence[str], db_col: str = "db_id") -> DataFrame:
    """``split`` = test for the listed databases, train otherwise.
    Raises when a side is empty (two cheap existence probes)."""
    out = df.withColumn("split", F.when(F.col(db_col).isin(list(dbs)), "test").otherwise("train"))
    if out.where(F.col("split") == "test").isEmpty() or out.where(F.col("split") == "train").isEmpty():
        raise ValueError("database-aware split produced an empty train or test set")
    return out


def _largest_remainder(counts: DataFrame, part_cols: Sequence[str], stratum_col: str, n_col: str,
                       draws: Column) -> DataFrame:
    """Add ``_quota``: ``draws`` spread over strata in proportion to ``n_col``
    (floor plus one for the largest remainders; ties by stratum)."""
    w_all = Window.partitionBy(*part_cols)
    c = counts.withColumn("_tot", F.sum(n_col).over(w_all)).withColumn("_draws", draws)
    num = F.col("_draws") * F.col(n_col)
    c = c.withColumn("_rem", num % F.col("_tot"))
    c = c.withColumn("_fl", ((num - F.col("_rem")) / F.col("_tot")).cast("long"))
    c = c.withColumn("_need", F.col("_draws") - F.sum("_fl").over(w_all))
    order = Window.partitionBy(*part_cols).orderBy(F.desc("_rem"), F.col(stratum_col))
    c = c.withColumn("_quota", F.col("_fl") + (F.row_number().over(order) <= F.col("_need")).cast("long"))
    return c.drop("_fl", "_rem", "_need", "_draws")


def _assign(df: DataFrame, quotas: DataFrame, strata: list[str], key_col: str, seed: int,
            quota_col: str, inside: str, outside: str, out_col: str = "split") -> DataFrame:
    """Rows whose md5 rank within the stratum is below the quota get ``inside``."""
    keyed = df.withColumn("_h", shuffle_key(key_col, seed))
    marked = first_rows(keyed, strata, "_h", quotas.withColumn("_quota", F.col(quota_col)))
    return marked.select(*df.columns, F.when(F.col("_first"), inside).otherwise(outside).alias(out_col))


def split_random_stratified(df: DataFrame, label_col: str = "label_binary", key_col: str = "question_id",
                            test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Stratified test share ``ceil(test_size * n)``; train quotas per
    class by largest remainder, test takes the rest of each class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    tot = F.sum("_n").over(Window.partitionBy())  # one row per class
    n_train = tot - F.ceil(F.lit(float(test_size)) * tot)
    q = _largest_remainder(counts, [], label_col, "_n", n_train)
    q = q.withColumn("_test_q", F.col("_n") - F.col("_quota"))
    return _assign(df, q, [label_col], key_col, seed, "_test_q", "test", "train")


def split_within_group(df: DataFrame, group_col: str = "db_id", key_col: str = "question_id",
                       test_size: float = TEST_SIZE, min_n: int = MIN_QUERIES, seed: int = SEED) -> DataFrame:
    """Independent test share per group, ``ceil(test_size * n)``; groups
    below ``min_n`` rows get ``split = 'skipped'``."""
    counts = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    q = counts.select(group_col, "_n", F.ceil(F.lit(float(test_size)) * F.col("_n")).cast("long").alias("_test_q"))
    out = _assign(df, q, [group_col], key_col, seed, "_test_q", "test", "train")
    small = counts.where(F.col("_n") < min_n).select(F.col(group_col).alias("_small"))
    out = out.join(small, out[group_col] == small["_small"], "left")
    return out.withColumn("split", F.when(F.col("_small").isNotNull(), "skipped").otherwise(F.col("split"))).drop("_small")


def _group_quotas(df: DataFrame, group_col: str, label_col: str, test_size: float) -> DataFrame:
    """One row per stratum ``(group, _slabel)`` with ``_test_q`` (rows ranked
    below it are test) and ``_train_first`` (tiny groups: the first
    ``_train_q`` rows are train).  ``_slabel`` is the label when the group is
    stratified (two classes, the smaller with at least 2 rows), else null.
    Sizes are bounded by groups x classes."""
    counts = df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
    g = Window.partitionBy(group_col)
    counts = (counts.withColumn("_gn", F.sum("_n").over(g))
                    .withColumn("_ncls", F.count(F.lit(1)).over(g))
                    .withColumn("_minc", F.min("_n").over(g)))
    strat = (F.col("_ncls") > 1) & (F.col("_minc") >= 2)
    n_train = F.col("_gn") - F.ceil(F.lit(float(test_size)) * F.col("_gn"))
    q = _largest_remainder(counts, [group_col], label_col, "_n", n_train)
    per_class = q.where(strat).select(group_col, F.col(label_col).alias("_slabel"),
                                      (F.col("_n") - F.col("_quota")).alias("_test_q"))
    plain = (counts.where(~strat).groupBy(group_col).agg(F.first("_gn").alias("_gn"))
             .select(group_col, F.lit(None).cast(df.schema[label_col].dataType).alias("_slabel"),
                     F.ceil(F.lit(float(test_size)) * F.col("_gn")).cast("long").alias("_test_q")))
    return per_class.unionByName(plain)


def _assign_groups(df: DataFrame, quotas: DataFrame, group_col: str, label_col: str, key_col: str,
                   seed: int) -> DataFrame:
    """One ranking pass over all groups: stratified groups rank inside
    (group, label), the others inside (group)."""
    strat_groups = quotas.where(F.col("_slabel").isNotNull()).select(F.col(group_col).alias("_sg")).distinct()
    # one row per stratified group: bounded by the number of groups
    x = df.join(strat_groups, df[group_col] == strat_groups["_sg"], "left")
    x = x.withColumn("_slabel", F.when(F.col("_sg").isNotNull(), F.col(label_col))).drop("_sg")
    out = _assign(x, quotas, [group_col, "_slabel"], key_col, seed, "_test_q", "test", "train")
    return out.drop("_slabel")


def split_within_group_stratified(df: DataFrame, group_col: str = "db_id", label_col: str = "label_binary",
                                  key_col: str = "question_id", test_size: float = TEST_SIZE,
                                  seed: int = SEED) -> DataFrame:
    """T4: per group 80/20, stratified by label only when the group has two
    classes and the smaller has at least 2 rows; otherwise plain.  All
    groups are assigned in one ranking pass."""
    q = _group_quotas(df, group_col, label_col, test_size)
    return _assign_groups(df, q, group_col, label_col, key_col, seed)


def split_seen_pooled(df: DataFrame, group_col: str = "db_id", label_col: str = "label_binary",
                      key_col: str = "question_id", test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """T5: per group; fewer than 5 rows -> the first max(1, round(0.8 n))
    shuffled rows train, the rest test; otherwise T4.  One job for all groups:
    a tiny group is one unstratified stratum whose test quota is
    n - max(1, round(0.8 n)), taken from the end of its md5 order."""
    q = _group_quotas(df, group_col, label_col, test_size)
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    tiny = sizes.where(F.col("_n") < 5).select(
        group_col, F.lit(None).cast(df.schema[label_col].dataType).alias("_slabel"),
        F.greatest(F.lit(1), F.bround(F.col("_n") * 0.8, 0).cast("long")).alias("_train_q"))
    q = q.join(tiny.select(group_col), group_col, "left_anti").withColumn("_train_q", F.lit(None).cast("long"))
    q = q.unionByName(tiny.withColumn("_test_q", F.lit(None).cast("long")))
    strat_groups = q.where(F.col("_slabel").isNotNull()).select(F.col(group_col).alias("_sg")).distinct()
    x = df.join(strat_groups, df[group_col] == strat_groups["_sg"], "left")
    x = x.withColumn("_slabel", F.when(F.col("_sg").isNotNull(), F.col(label_col))).drop("_sg")
    # the first rows of a stratum are test, those of a tiny group train
    quotas = q.select(group_col, "_slabel", F.coalesce("_train_q", "_test_q").alias("_quota"))
    marked = first_rows(x.withColumn("_h", shuffle_key(key_col, seed)), [group_col, "_slabel"], "_h", quotas)
    few = tiny.select(F.col(group_col).alias("_tiny"), F.lit(True).alias("_is_tiny"))
    j = marked.join(few, F.col(group_col).eqNullSafe(F.col("_tiny")) & F.col("_slabel").isNull(), "left")
    is_tiny = F.coalesce("_is_tiny", F.lit(False))
    return j.select(*df.columns, F.when(F.col("_first") == is_tiny, "train").otherwise("test").alias("split"))


def stratified_folds(df: DataFrame, k: int = 5, label_col: str = "label_binary", key_col: str = "question_id",
                     seed: int = SEED) -> DataFrame:
    """``fold`` = (rank within class) mod k', k' = min(k, smallest class);
    no folds (null) when the smallest class has fewer than 2 rows."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    kk = counts.select(F.least(F.lit(k), F.min("_n")).alias("_k")).select("_k").scalar()
    keyed = df.withColumn("_h", shuffle_key(key_col, seed)).withColumn("_k", kk)
    r = hash_rank(keyed, [label_col], "_h")
    fold = F.when(F.col("_k") >= 2, (F.col("_rn") % F.col("_k")).cast("int"))
    return r.select(*df.columns, fold.alias("fold"))


def downsample_stratified(df: DataFrame, target_rows: int, label_col: str = "label_binary",
                          db_col: str = "db_id", key_col: str = "question_id",
                          holdout: Sequence[str] = HOLDOUT_DATABASES, seed: int = SEED) -> DataFrame:
    """Sample ``target_rows`` rows; strata = seen/unseen x label with
    largest-remainder quotas; unstratified when there are more strata than
    rows wanted or a stratum has fewer than 2 rows; whole table when the
    target covers it."""
    n = df.count()
    if target_rows >= n:
        return df
    st = F.concat(F.when(F.col(db_col).isin(list(holdout)), "unseen").otherwise("seen"),
                  F.lit("|"), F.col(label_col).cast("int").cast("string"))
    sdf = df.withColumn("_stratum", st)
    counts = sdf.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    stats = counts.agg(F.count(F.lit(1)).alias("k"), F.min("_n").alias("m")).first()
    if target_rows >= stats["k"] and stats["m"] >= 2:
        q = _largest_remainder(counts, [], "_stratum", "_n", F.lit(int(target_rows)).cast("long"))
        out = _assign(sdf, q, ["_stratum"], key_col, seed, "_quota", "keep", "drop", out_col="_s")
    else:
        quotas = df.sparkSession.range(1).select(F.lit(int(target_rows)).cast("long").alias("_quota"))
        out = _assign(sdf, quotas, [], key_col, seed, "_quota", "keep", "drop", out_col="_s")
    return out.where(F.col("_s") == "keep").select(*df.columns)


def split_summary(df: DataFrame, split_col: str = "split", label_col: str = "label_binary",
                  db_col: str = "db_id") -> DataFrame:
    """Per side n, fast, slow and the sorted database list."""
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col(label_col) == 0).alias("fast"),
        F.count_if(F.col(label_col) == 1).alias("slow"),
        F.concat_ws(", ", F.array_sort(F.collect_set(F.col(db_col).cast("string")))).alias("databases"))


def split_status(split_df: DataFrame, group_col: str = "db_id", label_col: str = "label_binary",
                 split_col: str = "split", min_n: int = MIN_QUERIES) -> DataFrame:
    """Per group skipped_small / degenerate_train / degenerate_test / ok,
    with n, n_train, n_test and the rounded (half-even) slow percentage."""
    tr, te = F.col(split_col) == "train", F.col(split_col) == "test"
    g = split_df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(tr).alias("n_train"), F.count_if(te).alias("n_test"),
        F.count_distinct(F.when(tr, F.col(label_col))).alias("_ctr"),
        F.count_distinct(F.when(te, F.col(label_col))).alias("_cte"),
        F.avg(F.col(label_col).cast("double")).alias("_rate"))
    status = (F.when(F.col("n") < min_n, "skipped_small").when(F.col("_ctr") < 2, "degenerate_train")
               .when(F.col("_cte") < 2, "degenerate_test").otherwise("ok"))
    small = F.col("n") < min_n
    return g.select(group_col, "n",
                    F.when(~small, F.col("n_train")).alias("n_train"), F.when(~small, F.col("n_test")).alias("n_test"),
                    F.bround(F.col("_rate") * 100, 0).cast("long").alias("slow_pct"), status.alias("status"))
