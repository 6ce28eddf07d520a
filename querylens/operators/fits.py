"""Many fits over one table: which rows a fit sees, and scoring.

Rows carry a ``_cell``, a small number (a fold, a database and side, a share);
a fit is a set of cells.  So one written table serves all folds, shares, sides
and databases, and every pass over it serves all fits.  Scoring is one Arrow
pass too: every model scores the rows of the cells it is asked for.  Models
travel with the pass; what exceeds ``MODEL_BYTES`` goes in further passes over
the rows.  A model sees each distinct row of an Arrow batch once, and where only
metrics are asked for, a batch gives counts instead of its rows
(:func:`score_counts`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship
from .newton import Logistic, fit_logistic, weight
from .trees import Ensemble, TreeSpec, _columns, distinct_rows, fit_trees

MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class LogisticSpec:
    """L2-penalised logistic regression on standardized features."""

    penalty: float = 1.0


@dataclass
class FitTable:
    df: DataFrame              # keep columns, _cell, _y, one double column per feature; _w in a count_table
    keep: list[str]
    columns: list[str]


def fit_table(table: DataFrame, features: Sequence[str], label: str, cell: Column, keep: Sequence[str] = ()) -> FitTable:
    """The rows that fits and scoring read, written once (nulls in features
    as 0)."""
    rows = _selected(table, features, label, cell, keep)
    return FitTable(rows.df.checkpoint(), rows.keep, rows.columns)


def count_table(table: DataFrame, features: Sequence[str], label: str, cell: Column) -> FitTable:
    """:func:`fit_table` for fits and counts of scores: equal rows are written
    as one with their number ``_w``, so that no later pass reads them again."""
    return counted(_selected(table, features, label, cell, ()))


def counted(rows: FitTable) -> FitTable:
    """The rows as in :func:`count_table`."""
    return FitTable(rows.df.groupBy("_cell", "_y", *rows.columns).agg(F.count(F.lit(1)).alias("_w")).checkpoint(), [], rows.columns)


def _selected(table: DataFrame, features: Sequence[str], label: str, cell: Column, keep: Sequence[str]) -> FitTable:
    ensure_checkpoint_dir(table.sparkSession)
    columns = [f"_f{i}" for i in range(len(features))]
    df = table.select(*[F.col(k) for k in keep], cell.cast("int").alias("_cell"), F.col(label).cast("double").alias("_y"),
                      *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(c) for f, c in zip(features, columns)])
    return FitTable(df, list(keep), columns)


def fit_all(rows: FitTable, fits: Mapping, jobs: Sequence[tuple]) -> list[Logistic | Ensemble]:
    """Models of the jobs ``(fit, LogisticSpec or TreeSpec)``: all logistic
    fits in one series of passes, all trees in another."""
    logistic = [i for i, (_, spec) in enumerate(jobs) if isinstance(spec, LogisticSpec)]
    out: list = [None] * len(jobs)
    if logistic:
        for i, m in zip(logistic, fit_logistic(rows.df, rows.columns, fits, [jobs[i][0] for i in logistic],
                                               [jobs[i][1].penalty for i in logistic])):
            out[i] = m
    trees = [i for i, (_, spec) in enumerate(jobs) if isinstance(spec, TreeSpec)]
    if trees:
        for i, m in zip(trees, fit_trees(rows.df, rows.columns, fits, [jobs[i] for i in trees])):
            out[i] = m
    return out


def model_bytes(model) -> int:
    return sum(a.nbytes for a in vars(model).values() if isinstance(a, np.ndarray)) + 1024


def score_all(rows: FitTable, wanted: Sequence[tuple], limit: int = MODEL_BYTES) -> DataFrame:
    """``keep…, _y, job, part, raw`` for every row and every wanted ``(job,
    model, {cell: part})`` that asks for its cell: ``raw`` is the probability
    of class 1 or the predicted value.  A model without rows adds none."""
    if "_w" in rows.df.columns:
        raise ValueError("the rows of a count_table are counted, not scored one by one")
    ship(rows.df.sparkSession)
    return _union([_score_pass(rows, some) for some in _passes(wanted, limit)])


def score_counts(rows: FitTable, wanted: Sequence[tuple], limit: int = MODEL_BYTES) -> DataFrame:
    """``_y, job, part, raw, n``: how many rows :func:`score_all` has of each of
    these values.  What metrics need, without a row per row and model."""
    ship(rows.df.sparkSession)
    counts = _union([_count_pass(rows, some) for some in _passes(wanted, limit)])
    return counts.groupBy("_y", "job", "part", "raw").agg(F.sum("n").alias("n"))


def _passes(wanted: Sequence[tuple], limit: int) -> list[list]:
    passes: list[list] = [[]]
    size = 0
    for w in wanted:
        size += model_bytes(w[1])
        if passes[-1] and size > limit:
            passes.append([])
            size = model_bytes(w[1])
        passes[-1].append(w)
    return passes


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scores(batch: pa.RecordBatch, columns: Sequence[str], models: Sequence[tuple]):
    """``(job, rows that ask for it, names of parts, part of each row, distinct
    scores, score of each row)`` of every model that a batch needs."""
    cell = batch.column("_cell").to_numpy(zero_copy_only=False)
    x = _columns(batch, columns)
    first, place = distinct_rows(x)
    for job, model, cells in models:
        mine = np.flatnonzero(np.isin(cell, list(cells)))
        if not len(mine):
            continue
        present, which = np.unique(cell[mine], return_inverse=True)
        names = sorted(set(cells.values()))
        part = np.array([names.index(cells[c]) for c in present.tolist()], np.int64)[which]
        used = np.zeros(len(first), bool)
        used[place[mine]] = True
        yield job, mine, names, part, model.predict(x[first[used]]), (np.cumsum(used) - 1)[place[mine]]


def _score_pass(rows: FitTable, wanted: Sequence[tuple]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.df.schema}
    schema = "".join(f"`{k}` {types[k]}, " for k in rows.keep) + "_y double, job int, part string, raw double"
    names, columns = list(rows.keep), rows.columns
    models = rows.df.sparkSession.sparkContext.broadcast([(j, m, dict(cells)) for j, m, cells in wanted])

    def run(batches):
        for batch in batches:
            for job, mine, parts, part, raw, at in _scores(batch, columns, models.value):
                rows_at = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows_at) for k in names), batch.column("_y").take(rows_at),
                     pa.array(np.full(len(mine), job, np.int32)), pa.array(parts, pa.string()).take(pa.array(part)), pa.array(raw[at])],
                    names=[*names, "_y", "job", "part", "raw"])

    return rows.df.mapInArrow(run, schema)


def _count_pass(rows: FitTable, wanted: Sequence[tuple]) -> DataFrame:
    columns = rows.columns
    models = rows.df.sparkSession.sparkContext.broadcast([(j, m, dict(cells)) for j, m, cells in wanted])

    def run(batches):
        for batch in batches:
            # a row without label is none to a metric, but a row
            labels = batch.column("_y").dictionary_encode()
            weights = batch.column("_w").to_numpy(zero_copy_only=False)
            label = labels.indices.fill_null(len(labels.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            width = len(labels.dictionary) + 1
            known = pa.array([*labels.dictionary.to_pylist(), None], pa.float64())
            out: list = []
            for job, mine, parts, part, raw, at in _scores(batch, columns, models.value):
                key, place = np.unique((part * len(raw) + at) * width + label[mine], return_inverse=True)
                n = np.bincount(place, weights[mine])
                group = key // width
                out.append(pa.RecordBatch.from_arrays(
                    [known.take(pa.array(key % width)), pa.array(np.full(len(key), job, np.int32)),
                     pa.array(parts, pa.string()).take(pa.array(group // len(raw))), pa.array(raw[group % len(raw)]), pa.array(n.astype(np.int64))],
                    names=["_y", "job", "part", "raw", "n"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return rows.df.select("_cell", "_y", weight(rows.df).alias("_w"), *columns).mapInArrow(run, "_y double, job int, part string, raw double, n long")


def predict_column(df: DataFrame, features: Sequence[str], keep: Sequence[str], model) -> DataFrame:
    """``keep…, raw``: one model over any rows (nulls in features as 0)."""
    rows = _feature_rows(df, features, keep, F.lit(0))
    return score_all(rows, [(0, model, {0: ""})]).select(*keep, "raw")


def predict_by_key(df: DataFrame, features: Sequence[str], keep: Sequence[str], key: str, models: Mapping) -> DataFrame:
    """``keep…, raw``: every row by the model of its ``key``, in one pass over the
    rows whose key has one (one model per key; see ``MODEL_BYTES``)."""
    names = sorted(models)
    number = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(names)], f"`{key}` string, _cell int")
    rows = _feature_rows(df.join(F.broadcast(number), key), features, keep, F.col("_cell"))      # one row per model
    return score_all(rows, [(i, models[k], {i: ""}) for i, k in enumerate(names)]).select(*keep, "raw")


def _feature_rows(df: DataFrame, features: Sequence[str], keep: Sequence[str], cell: Column) -> FitTable:
    columns = [f"_f{i}" for i in range(len(features))]
    return FitTable(df.select(*keep, cell.cast("int").alias("_cell"), F.lit(0.0).alias("_y"),
                              *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(c) for f, c in zip(features, columns)]),
                    list(keep), columns)
