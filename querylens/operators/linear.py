"""Linear models fitted from Gram statistics aggregated by Spark (M1-M4,
M12-M16, M18).

Per group (database, or one global group) Spark aggregates in two passes
over the training rows: (1) count, mean and population std of every
feature; (2) the standardized cross-products ``sum z_i z_j``, ``sum z_j y``,
``sum y`` and ``sum y^2``.  Both passes are single grouped aggregates with
map-side partial aggregation, so a database holding a third of the rows
only adds partial buffers.  The p x p systems (p = number of features, about
30) are solved on the executors, one grouped task per database, and nothing
per group passes through the driver:

* OLS        ``w = lstsq(G, c)`` (minimum-norm, as LAPACK least squares)
* Ridge(a)   ``w = (G + a I)^-1 c``; intercept unpenalised
* Lasso(a)   coordinate descent on the Gram matrix for
             ``(1/2n)|y - Zw|^2 + a|w|_1``

Coefficients are folded back to raw feature units and scored with a
broadcast join of the coefficient table (one row per group and model).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Fixed values (reference configuration).
LINEAR_MODELS = {"Linear": ("ols", 0.0), "Ridge(a=1)": ("ridge", 1.0), "Ridge(a=10)": ("ridge", 10.0),
                 "Lasso": ("lasso", 0.01)}
LASSO_MAX_ITER = 5000


def _x(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def feature_moments(df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group n, mean and population std of each feature (nulls as 0)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(features):
        aggs += [F.avg(_x(c)).alias(f"_mu{i}"), F.stddev_pop(_x(c)).alias(f"_sd{i}")]
    return df.groupBy(*group_cols).agg(*aggs)


def standardize(df: DataFrame, features: Sequence[str], moments: DataFrame,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """M1: ``z = (x - mean) / std`` with population std; a zero std divides by 1.
    ``moments`` has one row per group; without groups it is a single row, which
    is broadcast."""
    feats = list(features)
    # the divisors are worked out once per group, not per row
    sd = [F.when(F.col(f"_sd{i}") > 0, F.col(f"_sd{i}")).otherwise(F.when(F.col(f"_sd{i}").isNotNull(), F.lit(1.0))).alias(f"_sd{i}")
          for i in range(len(feats))]
    moments = moments.select(*group_cols, *[f"_mu{i}" for i in range(len(feats))], *sd)
    if group_cols:
        j = df.join(moments, list(group_cols), "left")
    else:
        j = df.withColumn("_k", F.lit(1)).join(F.broadcast(moments.withColumn("_k", F.lit(1))), "_k").drop("_k")
    zs = [((_x(c) - F.col(f"_mu{i}")) / F.col(f"_sd{i}")).alias(c) for i, c in enumerate(feats)]
    keep = [c for c in df.columns if c not in feats]
    return j.select(*keep, *zs)


def _partial_gram(group_cols, feats, target):
    """mapInArrow body: one partial Gram vector per (partition, group)."""
    iu = np.triu_indices(len(feats))

    def run(batches):
        acc: dict = {}
        kinds: list = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*feats, target)]
            x, y = np.column_stack(columns[:-1]) if feats else np.zeros((n, 0)), columns[-1]
            keyed = [batch.column(g).dictionary_encode(null_encoding="encode") for g in group_cols]
            kinds = [k.dictionary.type for k in keyed]
            code = np.zeros(n, np.int64)
            for k in keyed:
                code = code * len(k.dictionary) + k.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0, [True]]))
            for i, j in zip(cuts, cuts[1:]):
                rows = order[i:j]
                key = tuple(k[int(rows[0])].as_py() for k in keyed)
                Z, t = x[rows], y[rows]
                vec = np.concatenate([[len(t), t.sum(), t @ t], Z.T @ t, (Z.T @ Z)[iu]])
                acc[key] = acc[key] + vec if key in acc else vec
        if acc:
            names = [pa.array([k[i] for k in acc], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*names, pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))],
                                             names=[*group_cols, "_stats"])
    return run


def gram_table(df: DataFrame, features: Sequence[str], target: str,
               group_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Pass 1: moments per group.  Pass 2: standardized sums ``n, sum y,
    sum y^2, sum z y, sum z z^T`` -- numpy per partition and group over Arrow
    batches, then an ordinary grouped sum of the
    partial vectors by position.  Returns (moments, long sums) where the
    long table has one row per group and position (``_pos``, ``_v``) in the
    order n, sy, syy, c_0..c_{p-1}, upper triangle of G row by row."""
    ship(df.sparkSession)
    feats = list(features)
    group_cols = list(group_cols)
    mom = feature_moments(df, feats, group_cols)
    z = standardize(df.select(*group_cols, *feats, F.col(target).cast("double").alias(target)), feats, mom, group_cols)
    z = z.select(*group_cols, *feats, target)
    gtypes = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group_cols)
    schema = (gtypes + ", " if gtypes else "") + "_stats array<double>"
    partial = z.mapInArrow(_partial_gram(group_cols, feats, target), schema)
    summed = (partial.select(*group_cols, F.posexplode("_stats").alias("_pos", "_v"))
                     .groupBy(*group_cols, "_pos").agg(F.sum("_v").alias("_v")))
    return mom, summed


def _solve(kind: str, alpha: float, G: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    p = len(c)
    if p == 0:
        return np.zeros(0)
    if kind == "ols":
        return np.linalg.lstsq(G, c, rcond=None)[0]
    if kind == "ridge":
        return np.linalg.solve(G + alpha * np.eye(p), c)
    # lasso: coordinate descent on (1/2n)|y - Zw|^2 + alpha |w|_1
    w = np.zeros(p)
    thr = alpha * n
    diag = np.diag(G).copy()
    for _ in range(LASSO_MAX_ITER):
        max_step = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            rho = c[j] - G[j] @ w + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - thr, 0.0) / diag[j]
            max_step = max(max_step, abs(new - w[j]))
            w[j] = new
        if max_step < 1e-12:
            break
    return w


@dataclass
class LinearFit:
    coefficients: DataFrame  # group..., model, intercept, coef array<double> (raw units), n_train


def fit_linear_models(train: DataFrame, features: Sequence[str], target: str = "log_runtime",
                      group_cols: Sequence[str] = (), models: dict | None = None) -> LinearFit:
    """M2-M4 for every group: the group's Gram numbers and moments meet in
    one grouped task, which solves all models.  Without groups all rows are
    one group.  Returns the coefficient table; no rows, no coefficients."""
    feats, groups = list(features), list(group_cols)
    p = len(feats)
    models = dict(models or LINEAR_MODELS)
    mom, summed = gram_table(train, feats, target, groups)
    # moments as further positions behind the Gram numbers
    width = 3 + p + p * (p + 1) // 2
    extra = F.array(*[F.col(f"_mu{i}") for i in range(p)], *[F.col(f"_sd{i}") for i in range(p)])
    rest = mom.select(*groups, F.posexplode(extra).alias("_pos", "_v")).select(
        *groups, (F.col("_pos") + F.lit(width)).alias("_pos"), "_v")
    numbers = summed.unionByName(rest)
    keys = groups or ["_all"]
    if not groups:
        numbers = numbers.withColumn("_all", F.lit(1))

    def solve(key, rows):
        import pandas as pd
        v = np.zeros(width + 2 * p)
        v[rows["_pos"].to_numpy()] = rows["_v"].to_numpy()
        n = int(v[0])
        if not n:
            return pd.DataFrame(columns=[*groups, "model", "intercept", "coef", "n_train"])
        gram = np.zeros((p, p))
        gram[np.triu_indices(p)] = v[3 + p:width]
        gram = gram + gram.T - np.diag(np.diag(gram))
        mu, sd = v[width:width + p], v[width + p:]
        sd = np.where(sd > 0, sd, 1.0)
        out = []
        for name, (kind, alpha) in models.items():
            # sum z (y - ybar) = sum z y because z is centred on the training rows
            b = _solve(kind, alpha, gram, v[3:3 + p], n) / sd
            out.append((*(key if groups else ()), name, float(v[1] / n - b @ mu), b.tolist(), n))
        return pd.DataFrame(out, columns=[*groups, "model", "intercept", "coef", "n_train"])

    ddl = "".join(f"{g} {train.schema[g].dataType.simpleString()}, " for g in groups)
    return LinearFit(numbers.groupBy(*keys).applyInPandas(
        solve, ddl + "model string, intercept double, coef array<double>, n_train long"))


def score_linear(df: DataFrame, fit: LinearFit, features: Sequence[str], group_cols: Sequence[str] = (),
                 out_col: str = "pred_log") -> DataFrame:
    """Apply every fitted model: one output row per (row, model).  The
    coefficient table has one row per group and model; without groups that is
    one row per model, which is broadcast."""
    feats = list(features)
    coefs = fit.coefficients
    if group_cols:
        j = df.join(coefs, list(group_cols), "inner")
    else:
        j = df.withColumn("_k", F.lit(1)).join(F.broadcast(coefs.withColumn("_k", F.lit(1))), "_k").drop("_k")
    pred = F.col("intercept")
    for i, c in enumerate(feats):
        pred = pred + F.element_at("coef", i + 1) * _x(c)
    return j.withColumn(out_col, pred).drop("intercept", "coef", "n_train")


def one_feature_closed_form(df: DataFrame, x: str, y: str, alpha: float, group_cols: Sequence[str] = ()) -> DataFrame:
    """Ridge / OLS with one standardized feature in closed form:
    ``w_z = S_zy / (n + alpha)`` -> raw slope ``w_z / std`` (for checks)."""
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
                                    F.stddev_pop(x).alias("sx"), F.covar_pop(x, y).alias("cxy"))
    sd = F.when(F.col("sx") > 0, F.col("sx")).otherwise(1.0)
    wz = (F.col("cxy") * F.col("n") / sd) / (F.col("n") + F.lit(alpha))
    slope = wz / sd
    return g.select(*group_cols, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
