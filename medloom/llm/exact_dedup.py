"""Exact dedup by deterministic block naming (Karp, Miller, Rosenberg 1972), DataFrame operations only.

Normalised texts are cut into blocks of a fixed number of bytes. The distinct blocks are shuffled by content, sorted
and numbered: a block's number is its name. Then adjacent names are paired, the distinct pairs sorted
and numbered, and so on, until each document has one name. Two documents of as many blocks are equal exactly
if their last names are: no hash decides, so nothing can collide.

Documents that no other equals in length, first and last bytes are already told apart and skip the naming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, named, written

BLOCK_BYTES = 4096
EDGE_CHARS = 64


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, body binary) -> (uid, blocks, name): equal bodies have the same (blocks, name), others don't."""
    pieces = f"transform(sequence(0, blocks - 1), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))"
    cut = texts.select("uid", "body", F.expr(f"greatest(cast(ceil(octet_length(body) / {block_bytes}D) as int), 1)").alias("blocks"))
    cut = written(cut.select("uid", "blocks", F.posexplode(F.expr(pieces)).alias("pos", "block")), "blocks")
    names = written(named(cut, ["block"], "name"), "block-names")  # written, so that the join below can split a very common block
    level = cut.join(names, "block").select("uid", "blocks", F.col("blocks").alias("open"), "pos", "name")
    most = cut.agg(F.max("blocks")).first()[0] or 1
    done: list[DataFrame] = []
    while True:
        level = written(level, "names")
        done.append(level.where("open = 1").select("uid", "blocks", "name"))
        if most <= 1:
            break
        pairs = (
            level.where("open > 1")
            .groupBy("uid", "blocks", F.expr("cast(ceil(open / 2D) as int)").alias("open"), F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = written(pairs, "pairs")
        names = written(named(pairs, ["a", "b"], "name"), "pair-names")
        level = pairs.join(names, ["a", "b"]).select("uid", "blocks", "open", "pos", "name")
        most = -(-most // 2)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``carry`` of every row (all, if None), with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of white space has become one space; null counts as empty.
    Of equal texts the row of the smallest doc_id stays (a null doc_id comes last; of repeated rows one stays).
    An empty table gives an empty result. Input columns named like a result column give way to it.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in new]
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("doc_id").alias("id"), norm.alias("norm"))
    edge = F.xxhash64(F.octet_length("norm"), F.left("norm", F.lit(EDGE_CHARS)), F.right("norm", F.lit(EDGE_CHARS)))
    rows = rows.withColumn("edge", edge)
    alike = written(rows.groupBy("edge").count().where("count > 1").select("edge", F.lit(True).alias("alike")), "edges")  # as above
    base = written(
        rows.join(alike, "edge", "left").select("row", "id", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("alike"), F.encode("norm", "UTF-8")).alias("body"), F.monotonically_increasing_id().alias("uid")),
        "texts",
    )
    names = written(block_names(base.where("body is not null").select("uid", "body"), block_bytes).join(base.where("body is not null").select("uid", "id"), "uid"), "identities")
    groups = written(names.groupBy("blocks", "name").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "uid")).alias("first")), "groups")
    of = names.select("uid", "blocks", "name").join(groups, ["blocks", "name"]).select("uid", "group_size", "first")
    alone = base.where("body is null").select(*[F.col("row")[c].alias(c) for c in keep], F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    grouped = base.where("body is not null").drop("body").join(of, "uid").select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("first.id").alias("keep_id"), "group_size", (F.col("first.uid") == F.col("uid")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the input's columns."""
    return exact_groups(docs).where("kept").select(docs.columns) if not {"keep_id", "group_size", "kept", "text_sha256"} & {*docs.columns} else _dedup_clashing(docs)


def _dedup_clashing(docs: DataFrame) -> DataFrame:
    packed = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    return exact_groups(packed).where("kept").select("whole.*")
