"""L2-penalised logistic regression for many fits in the same passes (M5, M9,
M17, M22-M28).

A fit minimises the sum of the log losses of its rows plus ``penalty / 2 |w|^2``
over features standardized with the fit's own moments; the intercept is free.
Rows of a cell that are equal in all features and the label are one row with a
weight, brought together once.  One pass over them gives, for every fit that has not converged, the loss,
the gradient and the matrix of second derivatives: sums over Arrow batches,
added up by a grouped aggregate.  The driver solves one small system per fit
(p + 1 numbers each) and halves a step that does not lower the loss.  The
penalty makes the problem strictly convex in ``w``, so the steps end; a fit that
does not is an error, never a silent result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_PASSES = 60
TOLERANCE = 1e-10


@dataclass
class Logistic:
    """``coef`` per standardized feature; ``mean`` and ``scale`` of the training rows."""

    intercept: float
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = self.intercept + ((x - self.mean) / self.scale) @ self.coef
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def importance(self) -> np.ndarray:
        return np.abs(self.coef)


def weight(df: DataFrame) -> Column:
    """How many rows a row stands for: ``_w``, or 1 without that column."""
    return F.col("_w") if "_w" in df.columns else F.lit(1).cast("long")


def moments(df: DataFrame, columns: Sequence[str]) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """Per cell: rows, sum of the labels, means and sums of squared deviations
    of the features; a row with ``_w`` counts as so many.  One row per cell
    reaches the driver."""
    if "_w" not in df.columns:
        aggs = [F.count(F.lit(1)).alias("n"), F.sum("_y").alias("t")]
        aggs += [F.array(*[f(c) for c in columns]).alias(name) for name, f in (("m", F.avg), ("v", F.var_pop))]
        return {r["_cell"]: (float(r["n"]), float(r["t"]), np.array(r["m"], float), np.array(r["v"], float) * r["n"])
                for r in df.groupBy("_cell").agg(*aggs).collect()}
    w = F.col("_w")
    first = df.groupBy("_cell").agg(F.sum("_w").alias("n"), F.sum(w * F.col("_y")).alias("t"),
                                    F.array(*[F.sum(w * F.col(c)) / F.sum("_w") for c in columns]).alias("m")).collect()
    cells = [r for r in first if r["_cell"] is not None]
    if not cells:
        return {}
    means = df.sparkSession.createDataFrame([(r["_cell"], r["m"]) for r in cells], "_cell int, m array<double>")
    near = df.join(F.broadcast(means), "_cell")      # one row per cell
    second = {r["_cell"]: r["v"] for r in near.groupBy("_cell").agg(F.array(
        *[F.sum(w * (F.col(c) - F.col("m")[i]) * (F.col(c) - F.col("m")[i])) for i, c in enumerate(columns)]).alias("v")).collect()}
    return {r["_cell"]: (float(r["n"]), float(r["t"]) if r["t"] is not None else 0.0, np.array(r["m"], float), np.array(second[r["_cell"]], float))
            for r in cells}


def pooled(parts: list, p: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Moments of several cells together."""
    n, t = sum(x[0] for x in parts), sum(x[1] for x in parts)
    if not n:
        return 0.0, 0.0, np.zeros(p), np.zeros(p)
    mean = sum(x[0] * x[2] for x in parts) / n
    return n, t, mean, sum(x[3] + x[0] * (x[2] - mean) ** 2 for x in parts)


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper triangle of the second derivatives."""
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    eta = z @ theta
    share = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    loss = np.logaddexp(0, eta) - y * eta
    second = (z * (w * share * (1 - share))[:, None]).T @ z
    return np.concatenate([[w @ loss], z.T @ (w * (share - y)), second[np.triu_indices(len(theta))]])


def _pass(df: DataFrame, columns: Sequence[str], states: dict) -> dict[int, np.ndarray]:
    """Sums over weighted rows of every fit ``number -> (cells, theta, mean, scale)``."""
    names = list(columns)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column("_cell").to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            w = batch.column("_w").to_numpy(zero_copy_only=False).astype(float)
            present = set(np.unique(cell).tolist())
            for k, (cells, theta, mean, scale) in states.items():
                own = cells & present
                if own:
                    mine = np.isin(cell, list(own))
                    s = _sums(x[mine], y[mine], w[mine], theta, mean, scale)
                    total[k] = total[k] + s if k in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                             names=["fit", "sums"])

    partial = df.select("_cell", "_y", "_w", *names).mapInArrow(run, "fit int, sums array<double>")
    added = partial.select("fit", F.posexplode("sums").alias("i", "s")).groupBy("fit", "i").agg(F.sum("s").alias("s"))
    whole = added.groupBy("fit").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))
    return {r["fit"]: np.array([x["s"] for x in r["sums"]]) for r in whole.collect()}


def fit_logistic(df: DataFrame, columns: Sequence[str], fits: Mapping, names: Sequence, penalties: Sequence[float]) -> list[Logistic]:
    """One model per name in ``names`` (keys of ``fits``, sets of cells).  ``df`` has
    ``_cell``, ``_y`` (0 or 1) and the feature columns (doubles without nulls),
    and ``_w`` where a row stands for several.  A constant feature gets the coefficient 0.  Training rows of one class, or
    none, are an error."""
    ship(df.sparkSession)
    p = len(columns)
    by_cell = moments(df, columns)
    rows = df if "_w" in df.columns else df.groupBy("_cell", "_y", *columns).agg(F.count(F.lit(1)).alias("_w")).checkpoint()
    state, models = {}, {}
    for k, name in enumerate(names):
        cells = frozenset(int(c) for c in fits[name])
        n, t, mean, m2 = pooled([by_cell[c] for c in cells if c in by_cell], p)
        if not 0 < t < n:
            raise ValueError(f"training rows of {name!r} have fewer than two classes")
        deviation = np.sqrt(m2 / n)
        constant = deviation <= 1e-12 * (1 + np.abs(mean))
        theta = np.zeros(p + 1)
        theta[0] = np.log(t / (n - t))
        state[k] = dict(cells=cells, mean=mean, scale=np.where(constant, 1.0, deviation), theta=theta, best=None, step=None, t=1.0)
    free = np.arange(p + 1) > 0
    for _ in range(MAX_PASSES):
        live = {k: s for k, s in state.items() if k not in models}
        if not live:
            break
        sums = _pass(rows, columns, {k: (s["cells"], s["theta"], s["mean"], s["scale"]) for k, s in live.items()})
        for k, s in live.items():
            v, theta = sums[k], s["theta"]
            value = v[0] + penalties[k] / 2 * float(theta[1:] @ theta[1:])
            if s["best"] is not None and not value <= s["best"] + 1e-12 * abs(s["best"]):
                s["t"] /= 2                       # back towards the best point
                s["theta"] = s["base"] - s["t"] * s["step"]
                continue
            second = np.zeros((p + 1, p + 1))
            second[np.triu_indices(p + 1)] = v[2 + p:]
            second = second + second.T - np.diag(np.diag(second)) + np.diag(penalties[k] * free)
            gradient = v[1:2 + p] + penalties[k] * free * theta
            step = np.linalg.solve(second, gradient)
            if np.abs(step).max() <= TOLERANCE * (1 + np.abs(theta).max()) or float(gradient @ step) <= 1e-14 * (1 + abs(value)):
                models[k] = Logistic(float(theta[0]), theta[1:].copy(), s["mean"], s["scale"])
                continue
            s.update(best=value, base=theta, step=step, t=1.0, theta=theta - step)
    unfinished = [names[k] for k in state if k not in models]
    if unfinished:
        raise RuntimeError(f"logistic fits did not converge in {MAX_PASSES} passes: {unfinished}")
    return [models[k] for k in range(len(names))]
