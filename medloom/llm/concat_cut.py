"""Concatenate and cut: all documents' tokens end to end, cut every ``capacity`` tokens.

Pass one tokenizes each document once and writes its ids with the number of tokens before it in its partition. The
prefix sums of the partitions' totals, one number a task of that pass, are the partitions' places in the whole stream.
Pass two adds the two: each document knows its place, so the windows it meets, and gives one record for each. No row
moves between partitions, and a document of any length is cut where the windows' boundaries fall.

A byte-level tokenizer whose pre-tokenizer splits by a known pattern (``split``) is asked once for each different piece, and the
ids of a text are those of its pieces joined. That is done for texts of characters whose Unicode class is settled
(``PLAIN``), with the pattern's classes spelled out for them; others are given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 2048
END_ID = 1
#: Pieces that a task remembers, and the longest of them in characters.
PIECES, PIECE_CHARS = 1 << 20, 64
#: Characters of output ids that make a batch.
BATCH_BYTES = 4 << 20
#: Fixed value: characters of which every Unicode version says the same as to letters, digits and white space.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")

TOKENS = "part int, doc_id long, before long, n_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plain_pattern(split: str) -> re.Pattern:
    """The pattern for texts of PLAIN characters: its classes of letters and digits spelled out."""
    known = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)]
    of = {f"\\p{{{kind}}}": "".join(c for c in known if unicodedata.category(c)[0] == kind) for kind in "LN"}
    in_class = lambda text: re.sub(r"\\p\{[LN]\}", lambda m: of[m[0]], text)
    spelled = re.sub(r"\[[^\]]*\]", lambda m: in_class(m[0]), split)
    return re.compile(re.sub(r"\\p\{[LN]\}", lambda m: f"[{of[m[0]]}]", spelled))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: its own if that can be seen, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)} | {b: chr(b) for b in seen}


class _Encoder(dict):
    """Ids of texts as little-endian bytes; a dict of pieces met before."""

    def __init__(self, path: str, split: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks beside each other
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = id_bytes(self.tokenizer.get_vocab_size())
        self.type = next(t for t in "HIL" if array(t).itemsize == self.width)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        if split and not (isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None):
            raise ValueError("a pattern of pieces is for byte-level tokenizers without a normalizer")
        self.split = plain_pattern(split).findall if split else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.type, [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.split is None or not PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(text)))


def id_bytes(vocabulary: int) -> int:
    """Bytes that an id takes on disk."""
    return 2 if vocabulary < 1 << 16 else 4


_encoders: dict[tuple, _Encoder] = {}


def _encoder(path: str, split: str | None) -> _Encoder:
    if (path, split) not in _encoders:
        _encoders[path, split] = _Encoder(path, split)
    return _encoders[path, split]


def tokenized(docs: DataFrame, path: str, split: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, doc_id, before (tokens of the partition before this document), n_tokens, ids of every row of ``docs``."""

    def run(batches):
        encode, part, total = _encoder(path, split), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{encode.width}").tobytes()

        def batch_of(doc_ids, ids, before):
            n = np.array([len(x) for x in ids], np.int64) // encode.width
            return pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), doc_ids, pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], ["part", "doc_id", "before", "n_tokens", "ids"]), int(n.sum())

        for batch in batches:
            ids, first, size = [], 0, 0
            texts = batch.column("text")
            for i in range(batch.num_rows):
                ids.append(encode(texts[i].as_py() or "") + end)
                size += len(ids[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    out, n = batch_of(batch.column("doc_id").slice(first, len(ids)), ids, total)
                    total += n
                    yield out
                    ids, first, size = [], i + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def pieces(tokens: DataFrame, width: int, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """The pieces of ``tokenized`` rows, which are read twice and so should be a written table.

    ``ids``: with the piece's ids, little-endian and of four bytes each. What goes to the tasks is one number for each partition of ``tokens``.
    """
    totals = dict(tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens"))).collect())
    ends = np.cumsum([totals.get(p, 0) for p in range(max(totals, default=-1) + 1)], dtype=np.int64)
    base = np.concatenate([[0], ends])

    def run(batches):
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            at = base[batch.column("part").to_numpy()] + batch.column("before").to_numpy()
            first = at // capacity
            times = (at + n - 1) // capacity - first + 1
            row = np.repeat(np.arange(len(n)), times)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            start = np.maximum(window * capacity, at[row]) - at[row]
            stop = np.minimum((window + 1) * capacity, at[row] + n[row]) - at[row]
            stored, cut, last = batch.column("ids"), [], -1
            for r, a, z in zip(row.tolist(), start.tolist(), stop.tolist()):
                if r != last:
                    whole, last = np.frombuffer(stored[r].as_buffer(), f"<u{width}"), r
                cut.append(whole[a:z].astype("<u4").tobytes())
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, stop - start, np.array([zlib.crc32(c) for c in cut], np.int64), n[row], window, at[row] + start - window * capacity))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                columns, names = [*columns, pa.array(cut, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return tokens.mapInArrow(run, PLACED + (", ids binary" if ids else ""))


def pack(docs: DataFrame, path: str, split: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids where asked for.

    Each row of ``docs`` is a document, also where doc_ids repeat or are null; its tokens are those of the whole text (null: empty)
    and ``end_id``. Documents follow each other in the order in which the table is read, and sequences are gapless; only the last is not full. An
    empty table gives no pieces. Other columns of ``docs`` are not read.
    """
    from tokenizers import Tokenizer

    tokens = written(tokenized(docs, path, split, end_id), "tokens")
    return pieces(tokens, id_bytes(Tokenizer.from_file(path).get_vocab_size()), capacity, ids)


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens, padded, ids: the pieces with ids put together, one row a sequence of ``capacity`` tokens at most.

    ``padded`` is the length with ``pad_id`` at the end: the capacity, or ``n_tokens`` itself where it is a power of two.
    """
    each = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    whole = F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(capacity).cast("long"))

    def run(batches):
        for batch in batches:
            out = []
            for size, parts in zip(batch.column("padded").to_pylist(), batch.column("p").to_pylist()):
                ids = np.full(size, pad_id, np.int64)
                joined = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                ids[: len(joined)] = joined
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "n_tokens", "padded", "ids"])

    return each.select("sequence_id", "n_tokens", whole.alias("padded"), "p").mapInArrow(run, "sequence_id long, n_tokens long, padded long, ids array<long>")
