"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches.

The log-probability matrix has a fixed number of rows and one column a language; it is broadcast in blocks of
BLOCK_LANGS columns, whose size is fixed. The classifier is fitted on a bounded sample of labelled rows (``per_lang`` documents a language,
picked by a hash of doc_id), with priors counted over all labelled rows; prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
ORDERS = (1, 2, 3)
PER_LANG = 3000
BLOCK_LANGS = 200
SMOOTHING = 0.1
BATCH_CHARS = 500_000
#: Multipliers of the n-gram hash, one for each place (fixed values).
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass
class Model:
    langs: list[str]
    logp: list[np.ndarray]  # of each block of BLOCK_LANGS languages: (2 ** BITS, languages)
    prior: np.ndarray


def has_letter(text) -> bool:
    """Whether a text has a character of Unicode category L (digits, superscripts and fractions are none)."""
    return isinstance(text, str) and any(map(str.isalpha, text))


def _buckets(chars: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place (the last order - 1 places have none)."""
    n = len(chars) - order + 1
    h = np.full(max(n, 0), order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ chars[i : i + n]) * np.uint32(MULTIPLIERS[i])
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def _batches(texts: list[str]):
    """Joined code points of lower-cased texts, with the start and end of each; two blanks end a text."""
    part, size = [], 0
    for t in texts:
        part.append(t.lower())
        size += len(t)
        if size >= BATCH_CHARS:
            yield _joined(part)
            part, size = [], 0
    if part:
        yield _joined(part)


def _joined(part: list[str]):
    lengths = np.array([len(t) for t in part])
    chars = np.frombuffer(("  ".join(part) + "  ").encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    return chars, starts, starts + lengths


def scores(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Sum over each text's n-grams of the log-probabilities: one row a text."""
    out = []
    for chars, starts, ends in _batches(texts):
        n = len(chars) - 2
        idx = [_buckets(chars, k)[:n] for k in ORDERS]
        edges = np.stack([starts, ends], 1).ravel()
        rows = np.empty((len(starts), logp.shape[1]))
        for lang in range(logp.shape[1]):
            col = np.ascontiguousarray(logp[:, lang])
            at = col[idx[0]]
            for i in idx[1:]:
                at += col[i]
            rows[:, lang] = np.add.reduceat(np.append(at, np.float32(0)), edges, dtype=np.float64)[::2]
        rows[starts == ends] = 0
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, logp.shape[1]))


def fit(docs: DataFrame, eligible=None, per_lang: int = PER_LANG) -> Model:
    """Learn from text and non-null lang of the ``eligible`` rows (all, if None).

    At most about ``per_lang`` documents of each language are read for the n-gram counts. Any number of languages is
    learned, in blocks. Without any labelled row the model knows no language and predicts ``und``.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if eligible is None else rows.where(eligible)
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return Model([], [], np.zeros(0))
    prior = np.log(np.array([n[k] for k in langs]) / sum(n.values()))
    return Model(langs, [_fitted(rows, langs[i : i + BLOCK_LANGS], n, per_lang) for i in range(0, len(langs), BLOCK_LANGS)], prior)


def _fitted(rows: DataFrame, langs: list[str], n: dict[str, int], per_lang: int) -> np.ndarray:
    """Log-probabilities of the n-gram buckets in each of ``langs``."""
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / n[k]))])
    rows = rows.where(F.col("lang").isin(*langs))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30)).select("lang", "text")
    place = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                for chars, starts, ends in _batches(own["text"].tolist()):
                    inside = np.zeros(len(chars) + 1, np.int32)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    inside = np.cumsum(inside)[:-1] > 0
                    for k in ORDERS:
                        b = _buckets(chars, k)
                        total[place[lang]] += np.bincount(b[inside[: len(b)]], minlength=1 << BITS)
        at = np.nonzero(total)
        yield pd.DataFrame({"lang": at[0].astype(np.int32), "bucket": at[1].astype(np.int32), "n": total[at]})

    seen = picked.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << BITS, len(langs)))
    table[seen["bucket"].to_numpy(), seen["lang"].to_numpy()] = seen["n"].to_numpy()
    table += SMOOTHING
    return np.log(table / table.sum(0)).astype(np.float32)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of lang_pred, 0 to 1).

    ``und`` with score 0 if the text is null, empty or has no letters, or the model knows no language. Input
    columns of these names are replaced. Only the text is an input; of equal scores the first language wins.
    """
    langs, prior, blocks = model.langs, model.prior, [docs.sparkSession.sparkContext.broadcast(b) for b in model.logp]

    @F.pandas_udf("lang_pred string, score double")
    def scored(text: pd.Series) -> pd.DataFrame:
        lang = np.full(len(text), "und", object)
        score = np.zeros(len(text))
        use = np.array([bool(langs) and has_letter(t) for t in text], bool)
        if use.any():
            known = [t for t, u in zip(text, use) if u]
            s = np.concatenate([scores(known, b.value) for b in blocks], 1) + prior
            best = s.argmax(1)
            lang[use] = np.array(langs, object)[best]
            score[use] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*rest, scored("text").alias("_lang")).select(*rest, "_lang.lang_pred", "_lang.score")


def held_out(doc_id: str = "doc_id"):
    """True for documents whose crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame) -> Model:
    """The model of the documents that are not held out (a null doc_id is not learned from)."""
    return fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def language_filter(docs: DataFrame) -> DataFrame:
    """The documents that have a language: those predicted ``und`` go. The input's columns."""
    packed = docs.select("text", F.struct("*").alias("_row"))
    return predict(packed, trained(docs)).where("lang_pred <> 'und'").select("_row.*")
