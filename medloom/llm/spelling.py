"""Spelling variants: words one edit apart, found by rolling-hash deletions.

Keys. For each word the prefix and suffix sums of a polynomial hash give, in numpy and for all words of a batch at
once, the 64-bit key of the word without each one of its code points, and of the whole word. A word of L code points has L + 1 keys;
no string is built.

Meeting. Keys are dealt by their first bits (a radix: keys are uniform, so parts are alike in size) and sorted within
their part. Two words that differ by one replaced code point share the key without that place; a word with one more code point
shares a deletion's key with the shorter word's own. Such a set of words is given as links with one of
them (so many rows as words, not pairs): with one place replaced it has as many words as there are letters at most.

Verification. Each link is checked on the words themselves. Words that met by a collision are grouped anew by the
rest of the word itself, so that results are those of strings.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import discard, written

#: Fixed value: the letters that make a run.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
PART_KEYS = 1 << 18
KEY_BITS = 64


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, run: each maximal run of letters of ``least`` or more of the whole text, A-Z in lower case; null has none."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), 1)).alias("run"))
    ascii_ = F.octet_length("run") == F.length("run")  # lower() would also change letters beyond A-Z
    return each.where(F.length("run") >= least).select("doc_id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))


def without(word: Column, place: Column) -> Column:
    """The word without the code point at ``place`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), place), F.substr(word, place + 2))


def vocabulary(seen: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """id, word, n of the words (column ``word``, one row an occurrence) that are long and frequent enough.

    Ids rise from the most frequent word on, ties in code-point order, so that of several words the one with the smallest id comes first.
    """
    counted = seen.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return written(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, 0 to ``n``."""
    inverse = np.uint64(pow(int(words.BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (words.BASE, inverse))


def deletion_keys(texts: list[str], bits: int = KEY_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key, new) of each word's own key (place -1) and of each of its deletions.

    ``new`` is false for a deletion that gives the same word as the one before it: the same letter twice.
    """
    length = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    power, inverse = _powers(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(codes + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)])
    end = np.cumsum(length)
    start = end - length
    own = np.repeat(np.arange(len(texts)), length)
    at = np.arange(len(codes))
    prefix = sums[at] - sums[start[own]]
    suffix = (sums[end[own]] - sums[at + 1]) * inverse[1]
    shorter = (prefix + suffix) * inverse[start[own]]
    whole = (sums[end] - sums[start]) * inverse[start]
    key = words.mix(np.concatenate([whole, shorter]) + np.concatenate([length, length[own] - 1]).astype(np.uint64))
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])
    none = np.full(len(texts), -1, np.int64)
    if bits < 64:
        key = key >> np.uint64(64 - bits)
    return np.concatenate([np.arange(len(texts)), own]), np.concatenate([none, at - start[own]]), key.view(np.int64), np.concatenate([none == -1, new])


def _keys(vocab: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size >= words.CHUNK or i == len(texts) - 1:
                    word, place, key, new = deletion_keys(texts[first : i + 1], bits)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[first : i + 1][word]), pa.array(place), pa.array(new)], ["key", "id", "place", "new"])
                    first, size = i + 1, 0

    return vocab.select("id", "word").mapInArrow(run, "key long, id long, place long, new boolean")


def _met(keys: pa.Table) -> pa.Table:
    """(longer, place, a, b): words of one key. One place replaced: each word (b) with the first of them (a). One more code point: b is the longer word."""
    key, id_, place, new = (keys[c].to_numpy() for c in ("key", "id", "place", "new"))
    order = np.lexsort((id_, place, key))
    key, id_, place, new = key[order], id_[order], place[order], new[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    leader = id_[first][np.cumsum(fresh) - 1] if len(key) else id_
    same = np.flatnonzero(~fresh & (place >= 0))
    whole = np.flatnonzero(place < 0)
    low, high = np.searchsorted(key, key[whole], "left"), np.searchsorted(key, key[whole], "right")
    times = high - low
    short = np.repeat(whole, times)
    long = np.repeat(low, times) + np.arange(len(short)) - np.repeat(np.cumsum(times) - times, times)
    some = (place[long] >= 0) & new[long]
    short, long = short[some], long[some]
    return pa.table(
        {
            "longer": np.concatenate([np.zeros(len(same), bool), np.ones(len(short), bool)]),
            "place": np.concatenate([place[same], place[long]]).astype(np.int32),
            "a": np.concatenate([leader[same], id_[short]]),
            "b": np.concatenate([id_[same], id_[long]]),
        }
    )


def links(vocab: DataFrame, part_keys: int = PART_KEYS, bits: int = KEY_BITS) -> DataFrame:
    """longer, place, a, b: links of words one edit apart, verified on the words.

    ``longer``: b is a with one more code point, at ``place``. Otherwise a and b differ at ``place``, and a is the first of all that differ there.
    """
    n = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    radix = max(0, math.ceil(math.log2(max(1, n / part_keys))))
    keys = _keys(vocab, bits).withColumn("part", F.shiftrightunsigned("key", bits - radix) if radix else F.lit(0).cast("long"))
    met = keys.groupBy("part").applyInArrow(_met, "longer boolean, place int, a long, b long")
    named = lambda side: vocab.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"))
    met = met.join(named("b"), "b").join(named("a"), "a").withColumn("rest", without(F.col("word_b"), F.col("place")))
    expected = F.when(F.col("longer"), F.col("word_a")).otherwise(without(F.col("word_a"), F.col("place")))
    met = written(met.select("longer", "place", "a", "b", "rest", (F.col("rest") == expected).alias("right")), "met")
    right = met.where("right").select("longer", "place", "a", "b")
    # words that met their key's first one by a collision: those of one rest are words that differ at that place
    again = met.where("not right and not longer").groupBy("place", "rest").agg(F.array_sort(F.collect_set("b")).alias("ids")).where(F.size("ids") > 1)
    again = again.select(F.lit(False).alias("longer"), "place", F.col("ids")[0].alias("a"), F.explode(F.slice("ids", F.lit(2), F.size("ids") - 1)).alias("b"))
    return right.unionByName(again)


def variants(vocab: DataFrame, ratio: int = RATIO, part_keys: int = PART_KEYS, bits: int = KEY_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``vocabulary``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. ``form`` is the most frequent near word (ties:
    smallest in code-point order) where its n is ``ratio`` times the word's at least, else null; ``root`` is where forms end. As n grows by ``ratio`` with
    each form, their number is bounded by a logarithm, and as many doublings find all roots. An empty vocabulary gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1: forms would not end")
    near = written(links(vocab, part_keys, bits), "near")
    replaced, longer = near.where("not longer"), near.where("longer")
    others = replaced.select("a", "b", F.count("*").over(Window.partitionBy("a", "place")).alias("times"))
    seen = (
        others.select(F.col("b").alias("id"), "times", F.col("a").alias("best"))
        .unionByName(replaced.groupBy("a", "place").agg(F.count("*").alias("times"), F.min("b").alias("best")).select(F.col("a").alias("id"), "times", "best"))
        .unionByName(longer.select(F.col("a").alias("id"), F.lit(1).cast("long").alias("times"), F.col("b").alias("best")))
        .unionByName(longer.select(F.col("b").alias("id"), F.lit(1).cast("long").alias("times"), F.col("a").alias("best")))
    )
    seen = seen.groupBy("id").agg(F.sum("times").alias("n_near"), F.min("best").alias("best"))
    best = vocab.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    each = vocab.join(seen, "id", "left").join(best, "best", "left").withColumn("is", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    each = each.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("is"), F.col(c)).alias(c) for c in ("form", "form_n", "best")))
    each = written(each, "forms")
    discard(near)
    most, least = vocab.agg(F.max("n"), F.min("n")).first()
    roots = each.where("best is not null").select("id", F.col("best").alias("root"))
    steps = math.ceil(math.log2(max(1, math.log(most / least, ratio) + 1))) if most else 0
    for _ in range(steps):
        roots = written(roots.join(roots.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
    ends = roots.join(vocab.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return each.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
