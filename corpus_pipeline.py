"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the
last return the columns of ``documents``:

1. toxicity - documents that the classifier rejects go;
2. near_duplicates - one document of each group of near-duplicates stays;
3. secrets - secrets in the texts are masked;
4. mixing - documents are repeated so that the domains' tokens meet their
   target shares; every document stays at least once;
5. bpe - whole texts become token ids.

``ORACLE_SQL`` is None: SQL expresses none of the fitted models; the tests hold
the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm import bpe, jaccard, mixing, secrets, toxicity
from querylens.llm.common import as_text, materialise
from querylens.llm.queries import vocabulary
from querylens.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, from a classifier fitted on
    the labelled rows of these documents.  Null and empty texts score by the
    share of toxic rows."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, carry=tuple(COLUMNS), out="_score").where("_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every set of documents connected by a similarity of 0.8 or more the
    one with the smallest doc_id.  Rows repeated with doc_id and text stay
    once; rows without doc_id all stay."""
    kept = jaccard.jaccard_links(docs).where("kept and doc_id is not null").select(
        "doc_id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64(as_text("text")).alias("_h1"), F.xxhash64(F.lit(1), as_text("text")).alias("_h2"))
    named = keyed.join(kept, ["doc_id", "_h1", "_h2"]).dropDuplicates(["doc_id", "_h1", "_h2"])
    return named.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes ``[secret]``, and ``n_chars`` follows."""
    clean = secrets.masked(secrets.scan(docs, secrets.model(docs), carry=tuple(COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says, at least once: the
    rate's integer part, and once more with the probability of the rest."""
    rates, _ = mixing.mix(docs, read_table(spark, sf_dir, "labels", "doc_id"), least=1.0, grow=True)
    times = rates.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), mixing.copies().alias("_times"))
    keyed = docs.select(*COLUMNS, F.xxhash64(as_text("text")).alias("_own"))
    joined = keyed.join(times, keyed["doc_id"].eqNullSafe(times["_id"]) & (keyed["_own"] == times["_h"]), "left")
    n = F.greatest(F.coalesce("_times", F.lit(1)), F.lit(1))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).select(*COLUMNS)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of the whole texts."""
    ids = bpe.encode(docs, vocabulary(), carry=("doc_id", "lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_domains),
    ("bpe", encode_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
