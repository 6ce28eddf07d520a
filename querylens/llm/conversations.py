"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after every turn.  Each turn's content
is hashed with its position; the running exclusive-or of those hashes, two
64-bit lanes, identifies a conversation's prefix of every length.  A
conversation whose whole is a prefix of a longer one, or equal to one with a
smaller conv_id, is removed by an anti-join; the maximal ones are rendered.

Positions and running hashes are computed in pieces (range partitions, then
runs of ``CHUNK`` turns), and rendered text comes in segments of ``SEGMENT``
turns, so no conversation, however long, has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from .common import as_text, materialise

CHUNK = 1024
SEGMENT = 256
ROLE = "unknown"


def _content(lane: int) -> Column:
    """Hash of a turn's role and text."""
    return F.xxhash64(F.lit(lane), F.col("role"), F.length("role"), F.col("text"))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, key``: turns that belong to a conversation,
    null role as :data:`ROLE`, null text as empty.  ``key`` tells rows of a
    conversation apart."""
    t = (conversations.where("conv_id is not null")
         .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                 F.coalesce(F.col("role").cast("string"), F.lit(ROLE)).alias("role"), as_text("text").alias("text")))
    return t.withColumn("key", F.xxhash64(F.col("turn").isNull(), F.col("turn"), _content(3)))


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, key, at, n, p1, p2``: position (from 0) and hashes of the
    prefix that ends there, for every distinct turn."""
    slim = rows.select("conv_id", "turn", "key", _content(1).alias("c1"), _content(2).alias("c2")).distinct()
    ranked = rank_within(slim, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("c1").asc(), F.col("c2").asc()])
    placed = materialise(ranked.select(
        "conv_id", "key", F.col("_rn").alias("at"), F.col("_n").alias("n"), F.expr(f"_rn div {CHUNK}").alias("chunk"),
        F.xxhash64("c1", "_rn").alias("c1"), F.xxhash64("_rn", "c2").alias("c2")), "turn-places")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # one row per CHUNK turns
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = (placed.groupBy("conv_id", "chunk").agg(F.bit_xor("c1").alias("x1"), F.bit_xor("c2").alias("x2"))
             .select("conv_id", "chunk", F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("x1"),
                     F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("x2")))
    return (placed.select("conv_id", "key", "at", "n", "chunk", F.bit_xor("c1").over(inside).alias("p1"), F.bit_xor("c2").over(inside).alias("p2"))
            .join(heads, ["conv_id", "chunk"])
            .select("conv_id", "key", "at", "n", F.col("p1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("p2")))


def maximal(found: DataFrame) -> DataFrame:
    """``conv_id, n`` of the conversations that are no prefix of a longer one
    and the first of their copies."""
    size = F.col("at") + 1
    held = found.groupBy(size.alias("m"), "p1", "p2").agg(
        F.max("n").alias("longest"), F.min(F.when(size == F.col("n"), F.col("conv_id"))).alias("least"))
    whole = found.where(size == F.col("n")).select("conv_id", "n", "p1", "p2")
    covers = [whole["n"] == held["m"], whole["p1"] == held["p1"], whole["p2"] == held["p2"],
              (held["longest"] > whole["n"]) | (held["least"] < whole["conv_id"])]
    return whole.join(held, covers, "left_anti").select("conv_id", "n")


def chat_format(conversations: DataFrame) -> DataFrame:
    """``conv_id, segment, n_turns, text``: every maximal conversation as chat
    text, ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn, in segments of
    ``SEGMENT`` turns to be joined in order; ``n_turns`` counts the whole
    conversation.

    Turns are ordered by number, null first, and turns with one number by a
    hash of their content; a row repeated within its conversation counts
    once.  Turn numbers themselves do not matter for prefixes.  Rows
    without conv_id belong to no conversation.  A null role is ``unknown``,
    a null text empty.  Other columns are not read; an empty table gives no
    rows.
    """
    rows = turns(conversations)
    found = materialise(prefixes(rows), "turn-prefixes")
    kept = found.join(maximal(found), ["conv_id", "n"])
    turn = F.struct(F.col("at").alias("at"), F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("t"))
    return (rows.join(kept, ["conv_id", "key"])
            .groupBy("conv_id", F.expr(f"cast(at div {SEGMENT} as int)").alias("segment"), F.col("n").alias("n_turns"))
            .agg(F.array_sort(F.collect_set(turn)).alias("turns"))
            .select("conv_id", "segment", "n_turns", F.array_join(F.col("turns.t"), "").alias("text")))
