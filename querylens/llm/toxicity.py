"""Toxicity: linear classifier over character n-grams, each feature scaled by
its naive Bayes log-count ratio (Wang & Manning 2012).

Features are the distinct character n-grams of a whole text (lower case,
white space as one blank character), hashed into ``BUCKETS`` buckets.  The
log-count ratio of a bucket compares the share of toxic and of clean
training texts that hold it; the ``features`` buckets whose shares differ by
most standard errors stay.  A logistic regression with an L2 penalty is then
fitted to presence times ratio.  Counts are gathered by Spark over the
training rows; the fit itself sees one short list of bucket numbers per
training row.

The classifier is fitted on a bounded sample of labelled rows:
``SAMPLE_ROWS``, those with the smallest hash of their id, so the choice
does not depend on partitioning.  Scores cover every row and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_runs
from .common import as_text, map_arrow, materialise

SAMPLE_ROWS = 20_000
FEATURES = 4_096
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
RUN_CHARS = 1 << 18
SAMPLE_TASKS = 16
NGRAMS = (2, 3, 4, 5)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def gram_buckets(texts: list[str]):
    """For each n: (text number, bucket) of every character n-gram."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes == 0x20) | (codes >= 9) & (codes <= 13), 0x20, codes).astype(np.uint64)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    h = codes
    with np.errstate(over="ignore"):
        for n in range(2, max(NGRAMS) + 1):
            if len(codes) < n:
                return
            h = h[:len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]
            if n in NGRAMS:
                mixed = (h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
                bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                inside = text[:len(bucket)] == text[n - 1:]
                yield text[:len(bucket)], bucket, inside


def present(texts: list[str], number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; ``number`` maps buckets to features,
    -1 to none."""
    keys = []
    for text, bucket, inside in gram_buckets(texts):
        feature = number[bucket]
        ok = inside & (feature >= 0)
        keys.append(text[ok].astype(np.int64) * size + feature[ok])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys // size, keys % size


@dataclass
class ToxicityModel:
    """Kept buckets, their weights (coefficient times log-count ratio) and
    the intercept; ``intercept`` alone scores a text without features."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    ratios: np.ndarray
    n_rows: int
    n_toxic: int

    def table(self) -> np.ndarray:
        number = np.full(BUCKETS, -1, np.int16)
        number[self.buckets] = np.arange(len(self.buckets), dtype=np.int16)
        return number

    def score_texts(self, texts: list[str], number: np.ndarray) -> np.ndarray:
        text, feature = present(texts, number, max(1, len(self.buckets)))
        z = np.full(len(texts), self.intercept)
        if len(text):
            z += np.bincount(text, self.weights[feature], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))


def logistic(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray,
             penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient descent on
    sparse presence features scaled by ``scale``, an example counting
    ``weight`` times: (coefficients, intercept)."""
    m, n, k = len(y), weight.sum(), len(scale)
    x = scale[col]
    # step from the largest eigenvalue of X'WX / n, by power iteration
    v, v0, top = np.ones(k) / np.sqrt(max(k, 1)), 1.0, 1.0
    for _ in range(20):
        u = weight * (np.bincount(row, x * v[col], m) + v0)
        w, w0 = np.bincount(col, x * u[row], k) / n, u.sum() / n
        top = max(np.sqrt((w ** 2).sum() + w0 ** 2), 1e-12)
        v, v0 = w / top, w0 / top
    step = 1.0 / (0.25 * top + penalty)
    rate = np.clip((weight * y).sum() / n, 1e-6, 1 - 1e-6)
    w, b = np.zeros(k), float(np.log(rate / (1 - rate)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(row, x * pw[col], m) + pb, -500, 500)))
        g = weight * (p - y)
        nw = pw - step * (np.bincount(col, x * g[row], k) / n + penalty * pw)
        nb = pb - step * g.sum() / n
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES,
          smoothing: float = 1.0) -> ToxicityModel:
    """Fit on the labelled rows outside fold 0: at most ``sample_rows`` ids,
    those with the smallest hash, and of their distinct rows (id and text) at
    most ``sample_rows``, again those with the smallest hash.

    Null ids, labels and texts: a null id or label is no labelled row, a null
    text is empty.  A document labelled more than once is toxic if any label
    says so; a row repeated with id and text is one example that counts as often.
    Without a toxic or without a clean row there is nothing to learn: the
    model then gives every text the same score, the smoothed share of toxic
    rows (0 without any labelled row).
    """
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0))
              .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("_toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # at most sample_rows short rows: safe to broadcast
    sample = materialise(docs.select("doc_id", as_text("text").alias("_text")).join(F.broadcast(marked), "doc_id")
                         .groupBy("doc_id", "_toxic", "_text").agg(F.count(F.lit(1)).alias("_rows"))
                         .select("_toxic", "_text", "_rows", F.xxhash64("doc_id", "_text").alias("_order")), "toxic-sample")
    if sample.count() > sample_rows:     # an id has many texts
        last = sample.select("_order").orderBy("_order").limit(sample_rows).agg(F.max("_order")).first()[0]
        sample = sample.where(F.col("_order") <= last)
    # read by a fixed number of tasks
    sample = sample.select("_toxic", "_text", "_rows").coalesce(SAMPLE_TASKS)

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        rows = np.zeros(2, np.int64)
        last = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            toxic, weights = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, texts in text_runs(batch.column(1), RUN_CHARS):
                y, times = toxic[first:first + len(texts)], weights[first:first + len(texts)]
                np.add.at(rows, y, times)
                grams = [(t[ok], b[ok]) for t, b, ok in gram_buckets(texts)]
                cuts = [np.searchsorted(t, np.arange(len(texts) + 1)) for t, _ in grams]
                for i, label in enumerate(y):
                    mine = [b[c[i]:c[i + 1]] for (_, b), c in zip(grams, cuts)]
                    mine = np.concatenate(mine) if mine else np.zeros(0, np.int32)
                    # one place of each bucket wins the last write
                    place = np.arange(len(mine), dtype=np.int32)
                    last[mine] = place
                    seen[label, mine[last[mine] == place]] += times[i]
        held = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(seen[0][held], rows[0])),
                                          pa.array(np.append(seen[1][held], rows[1]))], names=["bucket", "clean", "toxic"])

    counts = materialise(map_arrow(sample, count, "bucket long, clean long, toxic long")
                         .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-counts")
    total = counts.where("bucket = -1").first()
    n0, n1 = (int(total["clean"]), int(total["toxic"])) if total else (0, 0)
    if not n0 or not n1:
        rate = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.0
        none = np.zeros(0)
        return ToxicityModel(none.astype(np.int64), none, float(np.log(rate / (1 - rate))) if rate else -np.inf, none, n0 + n1, n1)
    p, q = (F.col("toxic") + smoothing) / (n1 + 2 * smoothing), (F.col("clean") + smoothing) / (n0 + 2 * smoothing)
    both = (F.col("toxic") + F.col("clean") + smoothing) / (n0 + n1 + 2 * smoothing)
    errors = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    best = (counts.where("bucket >= 0").select("bucket", F.log(p / q).alias("ratio"), errors.alias("errors"))
            .orderBy(F.desc("errors"), "bucket").limit(features).collect())   # at most `features` rows
    model = ToxicityModel(np.array([r.bucket for r in best], np.int64), np.zeros(len(best)), 0.0,
                          np.array([r.ratio for r in best], float), n0 + n1, n1)
    buckets = model.buckets

    def listed(batches):
        number = np.full(BUCKETS, -1, np.int16)
        number[buckets] = np.arange(len(buckets), dtype=np.int16)
        for batch in batches:
            for first, texts in text_runs(batch.column(1), RUN_CHARS):
                text, feature = present(texts, number, max(1, len(buckets)))
                ends = np.searchsorted(text, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int16)))],
                    names=["_toxic", "_rows", "features"])

    # bounded: sample_rows examples of at most `features` numbers
    rows = map_arrow(sample, listed, "_toxic int, _rows long, features array<short>").toArrow()
    lists = rows["features"].combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    col = lists.values.to_numpy().astype(np.int64)
    w, model.intercept = logistic(row, col, model.ratios, rows["_toxic"].to_numpy().astype(float), rows["_rows"].to_numpy().astype(float))
    model.weights = w * model.ratios
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
          out: str = "score") -> DataFrame:
    """Columns ``carry`` and ``out``: the probability of label 1 for every
    row and its whole text.  Null and empty texts have no n-grams and score
    by the intercept.  Columns outside ``carry`` are never read, and only the
    text is scored."""
    src = docs.select(*carry, as_text(text).alias("_text"))
    if text in carry:      # once is enough
        src = docs.select(*[c for c in carry if c != text], F.col(text).cast("string").alias(text))
    kept_fields = src.schema if text in carry else src.schema[:-1]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields] + [f"`{out}` double"]
    n_kept = len(fields) - 1

    def run(batches):
        number = model.table()
        for batch in batches:
            for first, texts in text_runs(batch.column(batch.num_columns - 1), RUN_CHARS):
                kept = [batch.column(i).slice(first, len(texts)) for i in range(n_kept)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score_texts(texts, number), pa.float64())],
                                                 names=[*batch.schema.names[:n_kept], out])

    return map_arrow(src, run, ", ".join(fields))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
