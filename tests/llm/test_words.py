"""Spelling variants, concatenate and cut, and ranked search: against brute-force versions, and their cases at the edge."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medloom.llm import concat_cut, lexical, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(3000))
ODD = [
    (1, "a b c", "en", "x", 1), (2, None, "en", None, 1), (3, "", None, "x", 1), (4, "   ", "de", "y", 1), (5, LONG, "en", "y", 1), (6, LONG + " end", "de", None, 1), (9, "one", "de", "x", 1), (9, "one", "de", "x", 1),
    (9, "other words", "de", "x", 1), (None, "a b c", "en", "x", 1), (None, None, None, None, None), (12, "日本語 テキスト 🙂 <|endoftext|> naïve x ², don't  stop\r\n\n", "fr", "z", 1), (13, "x" * 70_000, "fr", "z", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 11


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        others = sorted((-n[v], v) for v in n if near(v, w))
        form = others[0][1] if others and -others[0][0] >= 5 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), *rest) for w, (f, *rest) in out.items()}


def vocab_of(spark, n):
    return spelling.vocabulary(spark.createDataFrame([(w, k) for w, k in n.items()], "word string, k int").select(F.explode(F.array_repeat("word", F.col("k"))).alias("word")))


def got_variants(vocab, **how):
    rows = spelling.variants(vocab, **how).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("how", [{}, {"part_keys": 40}, {"bits": 8, "part_keys": 100}])
def test_variants_match_brute_force(spark, how):
    """Also where keys of 8 bits make nearly all words meet by collision."""
    rng = random.Random(5)
    stems = ["aaaaaa", "banana", "überall", "éééééé", "mississippi", "abcdef", "letter"]
    n = collections.Counter()
    for _ in range(400):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["a", "b", "é", "ss", ""])
        n["".join(w)] += rng.choice([1, 2, 5, 30, 200])
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    assert len(n) > 100
    assert got_variants(vocab_of(spark, n), **how) == brute_variants(n)


def test_forms_lead_to_roots_and_ties_go_by_code_point(spark):
    n = {"abcdefghij": 78_125, "abcdefghi": 15_625, "abcdefgh": 3125, "abcdefg": 625, "abcdef": 125, "abcdeff": 25, "abcdefff": 5, "zzzzzz": 50, "zzzzza": 50, "zzzzzb": 10, "öööööö": 6, "lonely": 7}
    got = got_variants(vocab_of(spark, n))
    assert got == brute_variants(n)
    assert got["abcdefff"][1] == "abcdefghij" and got["zzzzzb"][:2] == ("zzzzza", "zzzzza") and got["lonely"] == (None, "lonely", 7, 0, None)


def test_a_place_with_very_many_letters_gives_rows_not_pairs(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)]]
    n = {f"abc{c}def": 5 + i for i, c in enumerate(letters)}
    vocab = vocab_of(spark, n)
    assert spelling.links(vocab).count() == len(letters) - 1
    assert got_variants(vocab) == brute_variants(n)


def test_keys_are_those_of_the_shorter_word():
    texts = ["abcdef", "aab", "é", ""]
    word, place, key, new = spelling.deletion_keys(texts)
    own = dict(zip(word[place < 0].tolist(), key[place < 0].tolist()))
    for w, i, k, fresh in zip(word[place >= 0].tolist(), place[place >= 0].tolist(), key[place >= 0].tolist(), new[place >= 0].tolist()):
        rest = texts[w][:i] + texts[w][i + 1 :]
        assert k == spelling.deletion_keys([rest])[2][0], "a deletion's key is its rest's own key"
        assert fresh == (i == 0 or texts[w][i] != texts[w][i - 1])
    assert own[3] == key[(word == 2) & (place == 0)][0]


def brute_words(docs, delete=199):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % delete == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_spelling_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, SF).collect()}
    assert got == brute_variants(brute_words(docs)) and any(v[0] for v in got.values())


def test_spelling_edges(spark, odd, none):
    assert spelling.variants(spelling.vocabulary(spelling.runs(none).withColumnRenamed("run", "word"))).count() == 0
    docs = odd.withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("run", F.lit("clash"))
    seen = spelling.runs(docs).withColumnRenamed("run", "word")
    assert {r.word for r in spelling.vocabulary(seen, least_count=1).collect()} == {"endoftext", "x" * 70_000}
    text = "ÀBCDEFG àbcdefg " * 5 + "×÷×÷×÷ " * 5
    seen = spelling.runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumnRenamed("run", "word")
    assert {r.word: r.n for r in spelling.vocabulary(seen).collect()} == {"Àbcdefg": 5, "àbcdefg": 5, "×÷×÷×÷": 5}
    with pytest.raises(ValueError):
        spelling.variants(vocab_of(spark, {"abcdef": 5}), ratio=1)
    long = "ab" * 40_000
    n = {long: 30, long[:-1]: 5, long[:500] + "z" + long[501:]: 5}
    assert got_variants(vocab_of(spark, n))[long[:-1]] == (long, long, 5, 1, 30)


# 12

BPE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path(BPE))
    t.encode_special_tokens = True
    return t


def check_pieces(rows, texts, tokenizer, capacity):
    """Pieces hold each id of each document once, in order; sequences are gapless and all but the last are full."""
    at = collections.defaultdict(list)
    docs = collections.defaultdict(collections.Counter)
    for r in rows:
        assert 0 < r.length <= capacity and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        at[r.sequence_id].append(r)
    assert sorted(at) == list(range(len(at)))
    open_, whole = None, b""
    for s in sorted(at):
        end = 0
        for r in sorted(at[s], key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
            if r.start:
                assert open_ == (r.doc_id, r.start), "a cut document goes on at the next sequence's start"
            whole = whole + r.ids if r.start else r.ids
            open_ = (r.doc_id, r.start + r.length)
            if r.start + r.length == r.doc_tokens:
                docs[r.doc_id][whole] += 1
        assert end == capacity or s == max(at)
    want = collections.defaultdict(collections.Counter)
    for doc_id, text in texts:
        want[doc_id][np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    assert docs == want


@pytest.mark.parametrize("split", [None, public_tokenizers.PATTERN])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pieces_match_the_tokenizer(spark, odd, tokenizer, split, parts):
    texts = [(r[0], r[1]) for r in ODD]
    docs = odd.repartition(parts).withColumn("part", F.lit("clash")).withColumn("ids", F.lit(None).cast("int"))
    for capacity in (2048, 7):
        check_pieces(concat_cut.pack(docs, public_tokenizers.path(BPE), split, capacity).collect(), texts, tokenizer, capacity)


def test_pieces_of_the_supplied_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = concat_cut.pack(docs, public_tokenizers.path(BPE), public_tokenizers.PATTERN).collect()
    check_pieces(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], tokenizer, 2048)
    plain = queries.op12_concat_cut(spark, SF)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {tuple(r) for r in plain.collect()} == {tuple(r)[:7] for r in rows}


def test_sequences_are_padded_except_at_a_power_of_two(spark, none):
    path = public_tokenizers.path(BPE)
    for n, last in ((5, 8), (4, 4), (8, 8), (3, 8), (1, 1)):
        docs = spark.createDataFrame([(1, " a" * (8 + n - 1))], "doc_id long, text string")
        rows = concat_cut.sequences(concat_cut.pack(docs, path, None, 8), 8, pad_id=7).orderBy("sequence_id").collect()
        assert [(r.n_tokens, r.padded, len(r.ids)) for r in rows] == [(8, 8, 8), (n, last, last)]
        assert rows[1].ids[n - 1 :] == [1] + [7] * (last - n)
    assert concat_cut.pack(none, path).count() == 0 and concat_cut.sequences(concat_cut.pack(none, path)).count() == 0


def test_remembered_pieces_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(concat_cut, "PIECES", 5)
    encode = concat_cut._Encoder(public_tokenizers.path(BPE), public_tokenizers.PATTERN)
    text = LONG + " " + "y" * 500
    assert np.frombuffer(encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids and len(encode) <= 5


# 13


def brute_search(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    found = [(d, collections.Counter(terms(t))) for d, t in docs]
    n, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = {}
    for i, ts in asked.items():
        scored = []
        for row, (d, c) in enumerate(found):
            m = 50 + 50 * sum(c.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, row, d))
        if scored:
            out[i] = [(d, -s) for s, _, _, _, d in sorted(scored)[:k]]
    return out


def got_search(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        out[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return dict(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_matches_brute_force(spark, k):
    rng = random.Random(k)
    vocabulary = [f"t{i}" for i in range(60)] + ["Ünï", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randrange(300), " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for _ in range(400)] + [(7, "t3, T3; t4"), (7, "t3, T3; t4"), (None, "t3 t4"), (8, None)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(40)] + [(3, "t50"), (None, "t1"), (90, None), (91, "absent"), (92, "t0 t0 T0")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = got_search(lexical.ranked(df.withColumn("term", F.lit("clash")).withColumn("row", F.lit(1)), asked.withColumn("term", F.lit("clash")), k))
    assert got == brute_search(docs, items, k)
    terms = lexical.item_terms(asked)
    assert got_search(lexical.search(*lexical.index(df), terms, k)) == got, "an index of all terms gives the same"


def test_thresholds_leave_most_documents_out(spark, monkeypatch):
    """A list in all documents: of what its entries leave open, only few documents are looked up, and none is missed."""
    rng = random.Random(1)
    docs = [(i, "common " * rng.randint(1, 3) + " ".join(f"r{rng.randrange(300)}" for _ in range(rng.randint(1, 9)))) for i in range(4000)]
    items = [(1, "common r1 r2"), (2, "r3 r4 r5 common r6")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    counts, real = {}, lexical.written

    def written(d, tag):
        out = real(d, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(lexical, "written", written)
    for heads, alpha in ((8, 4), (1, 1), (1, 50)):
        monkeypatch.setattr(lexical, "HEADS", heads)
        monkeypatch.setattr(lexical, "ALPHA", alpha)
        assert got_search(lexical.ranked(df, asked, 5)) == brute_search(docs, items, 5)
        assert counts["candidates"] < 400 and counts["heads"] <= 7 * 5 * heads


def test_search_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "A, b!"), (2, "w5 end w5"), (3, "日本語"), (4, "one")], "item_id long, text string")
    docs = [(r[0], r[1]) for r in ODD]
    got = got_search(lexical.ranked(odd, items))
    assert got == brute_search(docs, [(1, "A, b!"), (2, "w5 end w5"), (3, "日本語"), (4, "one")], 50)
    assert [d for d, _ in got[1]] == [None, 1] and [d for d, _ in got[4]] == [9, 9]
    assert lexical.ranked(none, items).count() == 0 and lexical.ranked(odd, items.where("false")).count() == 0


def test_fetched_entries_move_once(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 9))) for i in range(120)]
    items, plans, real = [(1, "w1 w2 w3"), (2, "w3 w4 w5")], {}, lexical.written
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def written(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag)

    monkeypatch.setattr(lexical, "written", written)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as where a small table lies in very many files
    try:
        got = got_search(lexical.ranked(df, asked, 5))
        assert got == brute_search(docs, items, 5)
        moved = plans["fetched"]
        assert "SortMergeJoin" not in moved and sum("Exchange hashpartitioning(row" in line for line in moved.split("\n")) == 1 and "hashpartitioning(item_id" not in moved
        monkeypatch.setattr(lexical, "SENT_PAIRS", 1)
        assert got_search(lexical.ranked(df, asked, 5)) == got and "SortMergeJoin" in plans["fetched"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
