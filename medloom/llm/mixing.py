"""Mixing sources to target weights by pivotal dependent rounding (Deville and Tille 1998), in a reduction tree.

Each document of a source wants the same number of copies, target / source size: a whole part that it gets and a
fraction that is rounded. Two fractions meet and words move from one to the other, at random but fair, until one
of the two is whole. Moving words, not probabilities, keeps the source's words exactly as they were. In a group
of a source's documents the partner of a document is the pool of the smaller ones, so that large documents are
settled first; a group leaves one document undecided. These residuals meet pair by pair in the groups of
the next level, and so on to one group a source, whose last residual is drawn.

Groups hold a bounded number of documents, however many a source has, so a hot source is dealt over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3
GROUP_ROWS = 4096
FAN_IN = 256
SEED = 20
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, size) rows -> source, units, source_size, target: shares by weight, none above ``cap`` times its size.

    Sources are ranked by code point, null last, without bringing them into one task: they are sorted in ranges,
    and only the ranges' counts meet. What capped sources can't take is shared again until none is above its cap.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("units"), F.sum("words").alias("source_size"))
    order = [F.col("source").isNull().asc(), F.col("source").asc_nulls_last()]
    cut = written(totals.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "sources")
    parts = cut.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    offsets = parts.select("part", "first", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    rank = F.col("row") - F.col("first") + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cut = written(cut.join(F.broadcast(offsets), "part").select("source", "units", "source_size", weight.alias("weight"), (F.col("source_size") * cap).cast("double").alias("most")), "weights")
    total, free = cut.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    level, capped = (total / free if free else 0.0), 0
    while free:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        n, taken, free = cut.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - taken) / free
    return cut.select("source", "units", "source_size", F.least("most", F.lit(float(level)) * F.col("weight")).alias("target"))


def _pivot(frac: np.ndarray, words: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Rounds ``frac`` to 0 or 1, keeping sum(frac * words); one stays open at most, unless ``last``."""
    out = frac.copy()
    draws = rng.random(len(frac) + 1)
    held = -1
    for j in range(len(out)):
        if words[j] == 0:
            out[j] = float(draws[j] < out[j])
            continue
        if out[j] <= TINY or out[j] >= 1 - TINY:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        a, b, s, t = out[held], out[j], words[held], words[j]
        down, up = min(a * s, (1 - b) * t), min(b * t, (1 - a) * s)
        moved = -down if draws[j] * (down + up) < up else up
        a, b = a + moved / s, b - moved / t
        out[held], out[j] = a, b
        open_a, open_b = TINY < a < 1 - TINY, TINY < b < 1 - TINY
        if not open_a:
            out[held] = round(a)
        if not open_b:
            out[j] = round(b)
        held = held if open_a else j if open_b else -1
    if held >= 0 and last:
        out[held] = float(draws[-1] < out[held])
    return out


def _pool(frac: float, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds documents that all have the fraction ``frac``, in the order given, largest first.

    A document's partner is the pool of all after it, which share one fraction: words move between the two, up or
    down at random in the ratio that keeps both means, until one side is whole. Large documents are settled while
    the pool can still take their words, and what stays open is as a rule the smallest document.
    """
    out = np.full(len(words), frac)
    draws = rng.random(len(words))
    rest = np.concatenate([np.cumsum(words[::-1])[::-1][1:], [0.0]])
    f = frac
    for i in range(len(words)):
        if words[i] == 0:
            out[i] = float(draws[i] < frac)
        elif f <= TINY or f >= 1 - TINY:
            out[i] = round(f)
        elif rest[i] == 0:
            out[i] = f
        else:
            pull = rest[i] / words[i]
            up, down = min(1 - f, f * pull), min(f, (1 - f) * pull)
            moved = up if draws[i] * (up + down) < down else -down
            out[i] = f + moved
            f = min(1.0, max(0.0, f - moved / pull))
    return out


def _rounded(level: int, seed: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "key"], ascending=[False, True], kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["group"].iloc[0]), int(pdf["source_key"].iloc[0]) & (2**63 - 1)])
        frac, words = pdf["frac"].to_numpy(float), pdf["words"].to_numpy(float)
        single = np.flatnonzero(pdf["rows"].to_numpy() == 1) if level == 0 else []
        if len(single):
            frac = frac.copy()
            frac[single] = _pool(float(frac[single[0]]), words[single], rng)
        pdf["frac"] = _pivot(frac, words, rng, bool(pdf["groups"].iloc[0] <= 1))
        return pdf

    return one


def copy_counts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, same, rows, source_size, target, whole, extra: the copies that the mix takes.

    ``same`` is a hash of all columns; rows alike in it, doc_id, source and size are one unit of ``rows`` rows. Each row gets
    ``whole`` copies, and ``extra`` of the unit's rows one more: the whole part of what the fraction makes of them together,
    and maybe one, rounded against the other units. A null text has size 0. Draws depend on the rows and ``seed`` alone,
    so reruns agree. An empty table gives an empty result.
    """
    same = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    units = docs.select("doc_id", "source", n_words("text").alias("size"), same.alias("same")).groupBy("doc_id", "source", "size", "same").agg(F.count("*").alias("rows"))
    units = written(units.withColumn("words", F.col("size") * F.col("rows")), "sizes")
    targets = source_targets(units, weights, cap)
    most = targets.agg(F.max("units")).first()[0] or 0
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    together = F.greatest(copies - F.col("whole"), F.lit(0.0)) * F.col("rows")
    rows = (
        units.withColumnRenamed("source", "own")
        .join(targets, F.col("own").eqNullSafe(F.col("source")))
        .drop("own")
        .withColumn("words", F.col("size"))
        .withColumn("whole", F.floor(copies + TINY))
        .withColumn("extra", F.when(F.col("rows") > 1, F.floor(together + TINY)).otherwise(F.lit(0).cast("long")))
        .withColumn("frac", F.greatest(together - F.col("extra"), F.lit(0.0)))
        .withColumn("key", F.xxhash64("doc_id", "same"))
        .withColumn("source_key", F.xxhash64("source"))
        .withColumn("groups", F.ceil(F.col("units") / GROUP_ROWS))
        .withColumn("group", F.pmod("key", "groups"))
        .drop("units")
    )
    done, n, level = None, max(1, math.ceil(most / GROUP_ROWS)), 0
    while True:
        rows = written(rows.groupBy("source_key", "group").applyInPandas(_rounded(level, seed), rows.schema), "rounded")
        open_ = (F.col("frac") > TINY) & (F.col("frac") < 1 - TINY)
        ready = rows.where(~open_)
        done = ready if done is None else done.unionByName(ready)
        if n <= 1:
            break
        n, level = math.ceil(n / FAN_IN), level + 1
        rows = rows.where(open_).withColumn("group", F.expr(f"group div {FAN_IN}")).withColumn("groups", F.ceil(F.col("groups") / FAN_IN))
    return done.select("doc_id", "source", "size", "same", "rows", "source_size", "target", "whole", (F.col("extra") + F.round("frac").cast("long")).alias("extra"))


def row_counts(counts: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row, from copy_counts."""
    each = counts.select("*", F.explode(F.expr("sequence(1L, rows)")).alias("ordinal"))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("ordinal") <= F.col("extra")).cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The input's columns, each row as often as the mix takes it (never more than three times, maybe not at all)."""
    counts = copy_counts(docs).select(F.struct("doc_id", "source", "size", "same").alias("_unit"), "rows", (F.col("whole") * F.col("rows") + F.col("extra")).alias("copies")).where("copies > 0")
    same = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    sized = docs.select(F.struct("*").alias("_row"), F.struct(F.col("doc_id"), F.col("source"), n_words("text").alias("size"), same.alias("same")).alias("_unit"))

    def taken(part: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(part.withColumnRenamed("_unit", "_of"), F.col("_unit").eqNullSafe(F.col("_of")))

    out = taken(counts.where("rows = 1"), sized).select("_row", F.explode(F.expr("sequence(1L, copies)")))
    many = counts.where("rows > 1")
    if not many.isEmpty():  # one of each, as often as all together are taken
        one = taken(many, sized).groupBy("_unit").agg(F.first("_row").alias("_row"), F.first("copies").alias("copies"))
        out = out.unionByName(one.select("_row", F.explode(F.expr("sequence(1L, copies)"))))
    return out.select("_row.*")
