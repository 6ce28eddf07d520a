"""Mixing sources to target weights by soft membership, with DataFrame
functions only.

A naive Bayes classifier over the most informative words, fitted on a
labelled table, gives every document a posterior over the domains, whatever
its source says.  Nonnegative document rates are then fitted by projected-
gradient least squares, so that the expected tokens of every domain,
``sum of rate * tokens * posterior``, meet its target.

The residual has one number per domain.  With ``G = sum tokens * p p'`` the
objective is ``(S - T)' G^-1 (S - T) / 2``, its gradient for a document,
scaled by the document's tokens, is ``p . G^-1 (S - T)``, and the Hessian of
the scaled problem is a projection: unit steps are safe and end after a few
rounds.  A round is one aggregate over the posteriors; the driver sees only
the domain totals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, materialise

SAMPLE_ROWS = 20_000
VOCABULARY = 512
DOMAINS = 64
EVIDENCE = 20.0        # words: more matches do not make a posterior surer
SMOOTHING = 0.5
ROUNDS, FOLDED = 60, 8
TOLERANCE = 1e-6
SEPARATORS = r"[\x20\x09-\x0D]+"
_MARK = " "            # a separator, so never a word: stands for the document itself


def words(text: str | Column) -> Column:
    """Lower-case words of a text; null has none."""
    return F.filter(F.split(F.lower(as_text(text)), SEPARATORS), lambda w: w != "")


class DomainModel:
    """Domains, their log priors, and ``vocabulary``: ``word, l0, l1, ...``,
    the log probabilities of a word per domain."""

    def __init__(self, domains: list[str], priors: list[float], vocabulary: DataFrame | None):
        self.domains, self.priors, self.vocabulary = domains, priors, vocabulary


def train(labelled: DataFrame, text: str = "text", domain: str = "domain", vocabulary: int = VOCABULARY) -> DomainModel:
    """Fit on ``labelled`` (columns ``text`` and ``domain``); a null domain
    is no label, a null text has no words.  Ties between equally informative
    words go to the smaller word.  More than ``DOMAINS`` domains are an
    error; without labelled rows the model has no domains."""
    rows = labelled.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("d"), words(text).alias("ws"))
    rows = materialise(rows.select("d", F.explode(F.concat(F.array(F.lit(_MARK)), "ws")).alias("w"))
                       .groupBy("d", "w").agg(F.count(F.lit(1)).alias("n")), "domain-words")
    totals = (rows.groupBy("d").agg(F.sum(F.when(F.col("w") == _MARK, F.col("n"))).alias("docs"),
                                    F.sum(F.when(F.col("w") != _MARK, F.col("n")).otherwise(0)).alias("words"))
              .orderBy("d").limit(DOMAINS + 1).collect())
    if len(totals) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    if not totals:
        return DomainModel([], [], None)
    domains = [r.d for r in totals]
    docs = sum(r.docs for r in totals)
    priors = [float(np.log(r.docs / docs)) for r in totals]
    per_word = rows.where(F.col("w") != _MARK).groupBy(F.col("w").alias("word")).agg(
        F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("d") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(domains)])
    total = float(sum(r.words for r in totals)) or 1.0
    told = sum((F.col(f"n{i}") * F.log((F.col(f"n{i}") + 1e-9) / F.col("n") * (total / max(r.words, 1))) for i, r in enumerate(totals)), F.lit(0.0))
    best = per_word.withColumn("told", told).orderBy(F.desc("told"), "word").limit(vocabulary)
    logs = [F.log((F.col(f"n{i}") + SMOOTHING) / F.lit(r.words + SMOOTHING * vocabulary)).alias(f"l{i}") for i, r in enumerate(totals)]
    return DomainModel(domains, priors, materialise(best.select("word", *logs), "domain-vocabulary"))


def labelled_rows(docs: DataFrame, labels: DataFrame, domain: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents of the labelled table with their domain, at most
    ``sample_rows`` ids, those with the smallest hash."""
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids: safe to broadcast
    return docs.select("doc_id", "text", F.col(domain).alias("domain")).join(F.broadcast(ids), "doc_id").select("text", "domain")


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``doc_id, h, rows, n_tokens, posterior``: per distinct (doc_id, text)
    the number of its rows, its words and one probability per domain.  ``h``
    is a hash of the text.  A text without known words has the priors."""
    k = len(model.domains)
    src = docs.select("doc_id", F.xxhash64(as_text(text)).alias("h"), words(text).alias("ws"))
    if not k:
        return (src.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("ws")).cast("long").alias("n_tokens"))
                .withColumn("posterior", F.array().cast("array<double>")))
    mark = model.vocabulary.limit(0).union(
        docs.sparkSession.range(1).select(F.lit(_MARK), *[F.lit(0.0)] * k))
    known = F.broadcast(model.vocabulary.union(mark))      # VOCABULARY + 1 rows
    each = src.select("doc_id", "h", F.size("ws").alias("n"), F.explode(F.concat(F.array(F.lit(_MARK)), "ws")).alias("word"))
    sums = each.join(known, "word").groupBy("doc_id", "h").agg(
        F.sum((F.col("word") == _MARK).cast("long")).alias("rows"), F.max("n").cast("long").alias("n_tokens"),
        F.count(F.lit(1)).alias("m"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(k)])
    matches = (F.col("m") - F.col("rows")) / F.col("rows")
    weight = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(matches, F.lit(1.0))) / F.col("rows")
    z = sums.select("doc_id", "h", "rows", "n_tokens",
                    *[(F.lit(model.priors[i]) + weight * F.col(f"s{i}")).alias(f"z{i}") for i in range(k)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(k)]) if k > 1 else F.col("z0")
    e = z.select("doc_id", "h", "rows", "n_tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(k)])
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return e.select("doc_id", "h", "rows", "n_tokens", F.array(*[F.col(f"e{i}") / total for i in range(k)]).alias("posterior"))


def fit_rates(found: DataFrame, k: int, targets: list[float], least: float = 0.0) -> DataFrame:
    """``found`` with ``rate``: projected-gradient least squares from rate
    ``max(1, least)`` under ``rate >= least >= 0``, until every domain's expected
    tokens are within ``TOLERANCE`` of ``targets`` or a round changes them no
    more.  A target that no document serves stays unmet; without documents
    or domains rates stay as they start."""
    now = found.withColumn("rate", F.lit(max(1.0, least)))
    if not k:
        return now
    p = [F.col("posterior")[i] for i in range(k)]
    tokens = (F.col("n_tokens") * F.col("rows")).cast("double")
    g = found.agg(*[F.sum(tokens * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    if g[0] is None:
        return now
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = g[f"g{i}_{j}"]
    gram += np.eye(k) * max(np.trace(gram) * 1e-9, 1e-9)
    goal = np.array(targets, float)
    base, steps, before = now, [], None
    for done in range(ROUNDS):
        rate = F.col("rate")
        for c in steps:
            rate = F.greatest(F.lit(least), rate - sum((p[i] * F.lit(float(c[i])) for i in range(1, k)), p[0] * F.lit(float(c[0]))))
        now = base.withColumn("rate", rate)
        if len(steps) == FOLDED:       # keep the expression short
            base, steps = materialise(now, "mixing-rates"), []
            now = base
        total = np.array(now.agg(*[F.sum(tokens * F.col("rate") * p[i]) for i in range(k)]).first(), float)
        off = np.abs(total - goal).max() / max(goal.max(), 1.0)
        if off < TOLERANCE or before is not None and abs(before - off) < TOLERANCE * 1e-3:
            break
        before = off
        steps.append(np.linalg.solve(gram, total - goal))
    return now


def tempered(totals: list[float], temperature: float) -> list[float]:
    """Weights proportional to a power of the domains' tokens."""
    w = np.where(np.array(totals) > 0, np.maximum(totals, 1e-12), 0.0) ** temperature * (np.array(totals) > 0)
    return (w / w.sum()).tolist() if w.sum() else w.tolist()


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: str = "lang",
        temperature: float = 0.5, least: float = 0.0, grow: bool = False) -> tuple[DataFrame, list[str]]:
    """Rates for every document: (``doc_id, h, rows, n_tokens, posterior,
    rate``; domains in the order of ``posterior``).

    ``weights`` are target shares per domain; by default the square root of
    the domains' expected tokens, normalised.  Targets share out the tokens
    of the corpus or, with ``grow``, as many as it takes for no domain to
    shrink.  Null texts have no tokens and null ids are kept as they are;
    rows repeated with doc_id and text are one row here, counted in ``rows``.
    """
    model = train(labelled_rows(docs, labels, domain), vocabulary=VOCABULARY)
    found = materialise(posteriors(docs, model), "mixing-posteriors")
    k = len(model.domains)
    if not k:
        return fit_rates(found, 0, []), []
    tokens = F.col("n_tokens") * F.col("rows")
    have = [float(x or 0.0) for x in found.agg(*[F.sum(tokens * F.col("posterior")[i]) for i in range(k)]).first()]
    if weights is None:
        share = tempered(have, temperature)
    else:
        if unknown := set(weights) - set(model.domains):
            raise ValueError(f"no labelled document of {sorted(unknown)}")
        share = [max(0.0, weights.get(d, 0.0)) for d in model.domains]
        share = [s / (sum(share) or 1.0) for s in share]
    size = max((h / s for h, s in zip(have, share) if s > 0), default=0.0) if grow else sum(have)
    return fit_rates(found, k, [size * s for s in share], least), model.domains


def copies(rate: str = "rate") -> Column:
    """Whole copies of a document: the rate's integer part, and one more with
    the probability of the rest, by a hash of the id and text."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("int")


def mixed_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its source, tokens, likeliest domain, posteriors (in the
    order of the domain names), fitted rate and whole copies.  One row per
    distinct document row of ``doc_id`` and text; ``rows`` is how many there
    are."""
    found, domains = mix(docs, labels)
    best = F.array_position("posterior", F.array_max("posterior")) if domains else F.lit(0)
    names = F.array(*[F.lit(d) for d in domains]) if domains else F.array().cast("array<string>")
    return found.select("doc_id", "rows", "n_tokens", F.get(names, best.cast("int") - 1).alias("domain"),
                        F.transform("posterior", lambda p: F.round(p, 9)).alias("posterior"), "rate", copies().alias("copies"))
