"""Cumulative-snapshot collapse of logged conversations, and their rendering for training.

A chat log often holds a conversation after each of its turns. Every turn gets a hash of the whole conversation up
to it: the running xor of hashes of (position, role, text), two of 64 bits. A conversation whose last hash
appears inside a longer one is a prefix of it and goes by an anti-join; of equal ones the smallest conv_id stays
(one without an id only if no other has one).

Positions and running hashes are found within buckets of turn numbers and then across buckets, so that a
conversation of very many turns is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKET_TURNS = 1024


def _placed(turns: DataFrame, bucket_turns: int) -> DataFrame:
    """``turns`` with bucket and pos, from 1; it has conv_id, turn and the leaf hashes l1, l2."""
    rows = turns.withColumn("bucket", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / bucket_turns))
    inside = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "l1", "l2")
    rows = rows.withColumn("at", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(sizes, (F.col("conv_id") == F.col("c")) & (F.col("bucket") == F.col("b"))).withColumn("pos", F.col("before") + F.col("at")).drop("c", "b", "before", "at")


def _leaves(turns: DataFrame, *more: str) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return turns.select("conv_id", "turn", *more, F.xxhash64(F.lit(1), role, text).alias("l1"), F.xxhash64(F.lit(2), role, text).alias("l2"))


def prefix_hashes(turns: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """conv_id, pos, h1, h2: the hashes of each conversation up to each of its turns."""
    rows = _placed(_leaves(turns), bucket_turns)
    rows = rows.select("conv_id", "bucket", "pos", F.xxhash64(F.lit(3), "pos", "l1").alias("z1"), F.xxhash64(F.lit(4), "pos", "l2").alias("z2"))
    rows = written(rows, "turns")
    sums = rows.groupBy("conv_id", "bucket").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"), before("s1").alias("p1"), before("s2").alias("p2"))
    running = Window.partitionBy("conv_id", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "bucket", "pos", F.bit_xor("z1").over(running).alias("x1"), F.bit_xor("z2").over(running).alias("x2"))
    rows = rows.join(sums, (F.col("conv_id") == F.col("c")) & (F.col("bucket") == F.col("b")))
    return rows.select("conv_id", "pos", F.col("x1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("p2")).alias("h2"))


def maximal(turns: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """conv_id, turns, copies, h1, h2 of the conversations that are no prefix of a longer one; copies counts equal ones.

    Turns are ordered by turn (null first; equal turns by content), null role or text counts as empty. A row without
    conv_id is a conversation of its own, of one turn. Repeated rows are turns of their own. No rows give no
    conversation. h1 and h2 are the hash of the whole conversation.
    """
    rows = written(prefix_hashes(turns.where("conv_id is not null"), bucket_turns), "prefixes")
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    lone = _lone(turns).groupBy(F.struct("pos", "h1", "h2").alias("last")).agg(F.count("*").alias("copies"))
    classes = whole.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    classes = classes.unionByName(lone.select("last", F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "copies"))
    classes = classes.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"))
    inner = rows.join(whole.select("conv_id", F.col("last.pos").alias("turns")), "conv_id").where("pos < turns").select("pos", "h1", "h2").distinct()
    kept = classes.select("conv_id", "last.*", "copies").join(inner, ["pos", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("pos").alias("turns"), "copies", "h1", "h2")


def _lone(turns: DataFrame) -> DataFrame:
    """role, text, pos, h1, h2 of the rows without conv_id."""
    rows = _leaves(turns.where("conv_id is null"), "role", "text").withColumn("pos", F.lit(1).cast("long"))
    return rows.select("role", "text", "pos", F.xxhash64(F.lit(3), "pos", "l1").alias("h1"), F.xxhash64(F.lit(4), "pos", "l2").alias("h2"))


def rendered(turns: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """conv_id, part, turns, copies, text: the maximal conversations as chat text.

    Each turn is ``<|im_start|>role``, its text and ``<|im_end|>``; such marks within a text are broken up so that
    no text can end a turn. A part holds ``bucket_turns`` turns at most, so no row grows without bound.
    """
    kept = written(maximal(turns, bucket_turns), "maximal")
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    said = F.concat(F.lit("<|im_start|>"), plain("role"), F.lit("\n"), plain("text"), F.lit("<|im_end|>\n"))
    rows = _leaves(turns, "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi")
    rows = _placed(rows, bucket_turns).withColumn("part", F.floor((F.col("pos") - 1) / bucket_turns))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"]), "")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), text.alias("text"))
    parts = parts.join(kept.select("conv_id", "copies"), "conv_id").select("conv_id", "part", "turns", "copies", "text")
    alone = _lone(turns).groupBy("pos", "h1", "h2").agg(F.first(said).alias("text")).join(kept.where("conv_id is null").drop("turns"), ["h1", "h2"])
    return parts.unionByName(alone.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("turns"), "copies", "text"))
