"""Each operator against a brute-force version on small tables, and its cases at the edge."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import anchors, ann, chat, components, debruijn_dedup, exact_dedup, language_id, mixing, near_dedup, packing, queries, suffix_dedup, warc, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(3000))
RUN = " ".join(f"p{i}" for i in range(60))
#: Null and empty texts, null ids and sources, repeated rows, ties, copies up to white space, a long text.
ODD = [
    (1, "a b c d e f", "en", "x", 1), (2, "a  b\tc d\ne f", "en", "x", 1), (3, None, "en", None, 1), (4, "", None, "x", 1), (5, "   ", "de", "y", 1), (6, LONG, "en", "y", 1), (7, LONG, "en", "x", 1),
    (8, LONG + " end", "de", None, 1), (9, "one", "de", "x", 1), (9, "one", "de", "x", 1), (9, "other words in here are six", "de", "x", 1), (None, "a b c d e f", "en", "x", 1), (None, None, None, None, None),
    (12, "x " + RUN + " y", "en", "x", 1), (13, "z " + RUN, "en", "z", 1), (14, "q " * 80, "en", "z", 1), (15, "é" * 60 + "x", "fr", "z", 1), (16, "é" * 60 + "y", "fr", "z", 1), (17, "12 34 5", "fr", "z", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def spaced(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# 1


def brute_nearest(rows, queries_, k):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    out = {}
    for q, v in queries_:
        v = np.array(v, float) / np.linalg.norm(v)
        scored = sorted(((-round(float(v @ unit[i]), 12), i) for i in unit if i != q and len(unit[i]) == len(v)))
        out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("where", [SF, "/root/testdata/sf0.1"])
def test_ann_recall(spark, where):
    rows = [(r.vec_id, list(r.embedding)) for r in ann.usable(spark.read.parquet(f"{where}/embeddings.parquet")).collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = collections.defaultdict(list)
    for r in queries.op1_ann(spark, where).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(len(got[q]) == 5 for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [3e200, 1e200]), (10, []), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in out] == [(1, 1.0), (11, 1.0), (9, round(3 / 10**0.5, 12)), (2, 0.0)]
    assert ann.nearest(df.where("false"), df.where("vec_id = 0")).count() == 0
    assert ann.nearest(df, df.where("false")).count() == 0


def test_ann_splits_large_buckets(spark):
    df = spark.range(9000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    out = ann.nearest(df, df.where("vec_id = 8000")).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 1, 2, 3, 4]


def test_probes_come_by_cost():
    f = np.array([0.1, 0.45, 0.8])
    cost = [sum(f[i] ** 2 if s < 0 else (1 - f[i]) ** 2 for i, s in enumerate(p) if s) for p in ann.probes(f, 12)]
    assert cost == sorted(cost) and cost[0] == 0 and len({tuple(p) for p in ann.probes(f, 12)}) == 12


# 2


def near_classes(docs_):
    kept = [(i, (t or "").split()) for i, t in docs_ if i is not None]
    kept = [(i, w) for i, w in kept if w]
    sets = {(i, tuple(w)): {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in kept}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets, key=lambda k: k[0])
    for a in keys:
        for b in keys:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y, key=lambda k: k[0])] = min(x, y, key=lambda k: k[0])
    return {k: find(k)[0] for k in sets}


def test_near_dedup_matches_brute_force(docs):
    want = {k[0]: v for k, v in near_classes([(r.doc_id, r.text) for r in docs.collect()]).items()}
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    assert {k: got[k] for k in want} == want


def weighted_classes(rows, idf):
    """Classes by exact weighted Jaccard similarity, over all pairs: rows are (doc_id, text)."""
    known = {}
    for i, t in rows:
        if i is not None and (t or "").split():
            known.setdefault(tuple((t or "").split()), []).append((i, t))
    texts = [v[0][1] for v in known.values()]
    weights = [near_dedup._weights(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, pairs_ = collections.defaultdict(list), set()  # pairs without a common shingle have similarity 0
    for a, (k, _, _) in enumerate(weights):
        for x in k.tolist():
            pairs_.update((b, a) for b in holders[x])
            holders[x].append(a)
    for a, b in pairs_:
        (k, v, x), (m, w, y) = weights[a], weights[b]
        if min(x, y) >= 0.8 * max(x, y):
            _, i, j = np.intersect1d(k, m, assume_unique=True, return_indices=True)
            least = np.minimum(v[i], w[j]).sum()
            if least >= near_dedup.SIMILARITY * (x + y - least):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for n, v in enumerate(known.values()):
        groups[find(n)] += [i for i, _ in v]
    return sorted((i, min(g)) for g in groups.values() for i in g)


def test_near_dedup_matches_weighted_brute_force_with_shared_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), "text")
    rows = [tuple(r) for r in docs.collect()]
    idf = near_dedup.idf_table(*near_dedup.document_frequencies(docs))
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_groups(docs).where("doc_id is not null and class_id is not null").collect())
    want = weighted_classes(rows, idf)
    empty = sorted((i, i) for i, t in rows if i is not None and not (t or "").split())
    assert got == sorted(want + empty)


def test_rows_that_share_a_doc_id_keep_their_own_links(spark):
    long = [f"x{i}" for i in range(200)]
    rows = [(9, "a short text"), (9, " ".join(long)), (20, " ".join([*long[:100], "other", *long[101:]])), (30, "a short text")]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(9, 9, 2), (9, 9, 2), (20, 9, 2), (30, 9, 2)]


def test_screens_lose_few_pairs_at_the_limit():
    """Of pairs of weighted similarity 0.8, the share without a common band, or under one of the two screens."""
    rng = np.random.default_rng(5)
    n, lost, fewer = 250, 0, 0
    for _ in range(120):
        key = rng.integers(1, 2**63, n).astype(np.uint64)
        both, a, b = key[:200], key[:225], np.concatenate([key[:200], key[225:]])
        own = np.repeat([0, 1], 225)
        weight = np.zeros(450, np.float32)
        assert len(both) / n == near_dedup.SIMILARITY
        s = near_dedup.samples(own, np.concatenate([a, b]), weight, 2)
        f = near_dedup.samples(own, np.concatenate([a, b]), weight, 2, near_dedup.FINE, near_dedup.SEED + 1)
        shared = (s[0] == s[1]).reshape(-1, near_dedup.BAND).all(1).any()
        lost += not shared or (s[0] == s[1]).sum() < near_dedup.MIN_AGREE
        fewer += (f[0] == f[1]).sum() < near_dedup.FINE_AGREE
    assert lost == 0 and fewer == 0


def test_near_dedup_finds_planted_copies(spark):
    rng = np.random.default_rng(3)
    rows, plain = [], [f"v{i}" for i in range(3000)]
    for family in range(20):
        base = [plain[i] for i in rng.integers(0, 3000, 300)]
        for copy in range(4):
            w = list(base)
            for at in rng.choice(300, copy * 2, replace=False):
                w[at] = f"edit{family}-{copy}-{at}"
            rows.append((family * 10 + copy, " ".join(w), "en", "s", 1))
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {r[0]: r[0] // 10 * 10 for r in rows}


def test_one_row_of_a_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text), (9, text + " more"), (20, text + " other"), (1, "alone here with five words"), (1, "alone here with five words"), (2, None), (2, None), (None, text), (None, text)]
    df = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, k1 string").repartition(4)
    found = near_dedup.near_groups(df).collect()
    assert len(found) == len(rows)
    by = collections.Counter((r.class_id, r.class_size, r.kept) for r in found)
    assert by == {(9, 3, True): 1, (9, 3, False): 2, (1, 2, True): 1, (1, 2, False): 1, (2, 1, True): 2, (None, 1, True): 2}
    kept = near_dedup.near_dedup(df).collect()
    assert collections.Counter(r.doc_id for r in kept) == {9: 1, 1: 1, 2: 2, None: 2} and df.columns == ["doc_id", "text", "k1"]


def test_strays_of_a_bucket_are_dealt_in_parts(spark, monkeypatch):
    """Loose copies in one bucket: parts of its rows against parts of its strays, with the classes of whole blocks."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(160):
        t = list(base)
        for j in rng.choice(80, 3 + i % 4, replace=False):
            t[j] = f"x{i}_{j}"
        texts.append((i, " ".join(t)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {tuple(r) for r in near_dedup.near_groups(df).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    assert {tuple(r) for r in near_dedup.near_groups(df).collect()} == want


def test_near_dedup_edges(odd, none):
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dedup.near_groups(odd).collect()), key=str)
    assert len(got) == len(ODD)
    assert [g for g in got if g[0] == 2] == [(2, 1, 2, False)]
    assert [g[1:] for g in got if g[0] in (6, 7, 8)] == [(6, 3, True), (6, 3, False), (6, 3, False)]
    assert [g[1:] for g in got if g[0] in (3, 4, 5, None)] == [(3, 1, True), (4, 1, True), (5, 1, True), (None, 1, True), (None, 1, True)]
    clash = odd.withColumn("kept", F.lit("x")).withColumn("class_id", F.lit("y"))
    stay = near_dedup.near_dedup(clash)
    want = [r[0] for r in ODD if r[0] not in (2, 7, 8, 13)]
    want.remove(9)  # (9, "one") occurs twice: one class, of which one row stays
    assert stay.columns == clash.columns and sorted((r.doc_id for r in stay.collect()), key=str) == sorted(want, key=str)
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.near_dedup(none).count() == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    key = rng.integers(1, 2**63, 400).astype(np.uint64)
    w = rng.uniform(0.5, 3, (2, 400))
    own = np.repeat([0, 1], 400)
    s = near_dedup.samples(own, np.tile(key, 2), np.log(w).ravel().astype(np.float32), 2, 2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.04


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


# 3 and 4


def brute_bytes(rows):
    first: dict[bytes, int] = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[p : p + 35]) for _, w in split for p in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", ["docs", "odd", "none"])
def test_suffix_dedup(request, part):
    df = request.getfixturevalue(part)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df.withColumn("spans", F.lit("clash"))).collect()), key=str)
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("part", ["docs", "odd", "none"])
def test_debruijn_dedup(request, part):
    df = request.getfixturevalue(part)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = debruijn_dedup.dedup(df.withColumn("spans", F.lit("clash"))).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_words(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_row_without_id_beside_repeats_of_other_partitions(spark):
    run = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    rows = [(1, run[0] + " one"), (None, "x " + run[1]), (2, run[2] + " two"), (3, "y " + run[0]), (4, run[1] + " z"), (5, run[2])]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    out = debruijn_dedup.dedup(df, texts=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_words(rows)


def test_rows_of_one_doc_id_beside_an_earlier_document_of_another_partition(spark):
    run = " ".join(f"{i}shared{i * i}" for i in range(20))
    rows = [(5, "first " + run), (5, run + " second"), (1, "zero " + run), (7, "other")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    out = suffix_dedup.dedup(df, texts=False).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_bytes(rows)


def test_rows_alike_that_hold_a_repeat_stay_as_many(spark):
    run = " ".join(f"{i}shared{i * i}" for i in range(20))
    rows = [(1, "zero " + run), *[(5, "first " + run)] * 3, (7, "other")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    out = suffix_dedup.dedup(df, texts=False).collect()
    assert len(out) == 5
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_bytes(rows)


def test_hot_anchors_are_judged_alike(monkeypatch, docs, odd):
    monkeypatch.setattr(debruijn_dedup, "OPEN_PATHS", 1)
    monkeypatch.setattr(anchors, "HOT_ROWS", 3)
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = debruijn_dedup.dedup(df, texts=False).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_words(rows)
        out = suffix_dedup.dedup(df, texts=False).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_bytes(rows)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_repeats_of_many_lengths_with_null_ids_and_repeated_rows(spark, partitions):
    rng = np.random.default_rng(4)
    word = lambda: f"{'abcdefgh'[rng.integers(8)]}{rng.integers(10**6)}"
    runs = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 60, 64, 100, 200)]
    rows = [(None if i % 5 == 0 else i // 2, " ".join([word(), runs[i % 7], word(), runs[(i * 3) % 7] if i % 3 else "", word()])) for i in range(40)]
    rows += rows[:6] * 2
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, text string")
    out = debruijn_dedup.dedup(df, texts=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_words(rows)
    out = suffix_dedup.dedup(df, texts=False).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_bytes(rows)


def test_paths_compact_and_rings_stay(spark):
    ring = " ".join(f"r{i}" for i in range(60))
    rows = [(1, " ".join([ring] * 5)), (2, " ".join([ring] * 9)), (None, "x " + " ".join([ring] * 3)), (4, "q " + RUN + " " + LONG[:900]), (5, RUN + " " + LONG[:900] + " z")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = debruijn_dedup.dedup(df, texts=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_words(rows)
    repeats = debruijn_dedup.repeated_edges(anchors.rows_of(spark.createDataFrame(rows[3:5], "doc_id long, text string")))
    heads, members = debruijn_dedup.compacted(repeats)
    shared = len(RUN.split()) + len(LONG[:900].split()) - 1  # the last word differs
    assert max(r.edges for r in heads.collect()) <= shared - 34 + 1 and members.count() > 0


def test_suffixes_of_long_texts_come_in_chunks_and_runs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 200)
    texts = [LONG[:2000], "zz" + LONG[300:1800] + "yy", "abc " * 60, "é" * 300, ""]
    found = set()
    for first, _, blocks, base in suffix_dedup.batches(texts):
        a, text, start, size, place, _ = suffix_dedup.sampled(blocks)
        begin = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        assert (place >= start + size - 1).all() and (place - start < suffix_dedup.LONGEST).all()
        found |= {(first + t, base + s + k - begin[t]) for t, s, n in zip(text.tolist(), start.tolist(), size.tolist()) for k in range(n)}
    assert found == {(i, p) for i, t in enumerate(texts) for p in range(len(t.encode()) - 49)}


def test_induced_order_equals_brute_force():
    rng = np.random.default_rng(7)
    for round_ in range(20):
        alphabet = 2 if round_ % 2 else 4
        mid = [bytes(rng.integers(97, 97 + alphabet, 24).astype(np.uint8)) for _ in range(3)]
        whole, at, doc = [], [], []
        for _ in range(120):
            n_left, n_right = int(rng.integers(0, 27)), int(rng.integers(24, 51))
            n_right = max(n_right, 50 - n_left)
            fill = lambda n: bytes([97]) * n if rng.random() < 0.5 else bytes(rng.integers(97, 99, n).astype(np.uint8))
            whole.append(fill(n_left) + mid[rng.integers(3)] + fill(n_right - 24))
            at.append(n_left)
            doc.append(int(rng.integers(0, 9)))
        order = sorted(range(120), key=lambda i: whole[i][at[i] :])
        rows = [(whole[i], at[i], doc[i]) for i in order]
        import pyarrow as pa

        right, n_right = suffix_dedup._matrix(pa.array([w[p:] for w, p, _ in rows], pa.binary()), 50, False)
        left, n_left = suffix_dedup._matrix(pa.array([w[:p] for w, p, _ in rows], pa.binary()), 27, True)
        got = suffix_dedup.induced(right, n_right, left, n_left, np.array([d for _, _, d in rows]))
        first: dict = {}
        for w, p, d in rows:
            for i in range(p + 1):
                if len(w) - i >= 50:
                    key = (p - i, w[i : i + 50])
                    first[key] = min(d, first.get(key, d))
        want = [sum(1 << i for i in range(p + 1) if len(w) - i >= 50 and first[p - i, w[i : i + 50]] < d) for w, p, d in rows]
        assert got.tolist() == want


def test_blocks_of_a_long_text_do_not_depend_on_texts_before_it(monkeypatch):
    monkeypatch.setattr(debruijn_dedup, "BLOCK", 50)
    text = " ".join(f"u{i}" for i in range(200))
    def blocks(before):
        return [b for _, _, s in debruijn_dedup.stretches([*before, text]) if (b := list(zip(s.start[s.text == len(before)].tolist(), s.pick(np.flatnonzero(s.text == len(before))).spelled())))]

    assert blocks(["a b c", "d e"]) == blocks([]) and [b[0][0] for b in blocks([])] == [0, 50, 100, 150]
    assert all(words_.split()[0] == f"u{start}".encode() for b in blocks([]) for start, words_ in b)


# 5


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict(docs, language_id.trained(docs)).where(language_id.held_out())
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_scores_do_not_depend_on_the_place_in_a_batch():
    logp = np.random.default_rng(1).normal(size=(1 << language_id.BITS, 2)).astype(np.float32)
    assert np.allclose(language_id.scores(["ab"], logp)[0], language_id.scores(["ab", "next"], logp)[0])


def test_language_matches_brute_force(docs):
    """Naive Bayes with dictionaries over the same n-grams and buckets, one text at a time."""
    import zlib

    docs = docs.where("doc_id < 60")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]

    known = [(t, lang) for i, t, lang in rows if lang is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({lang for _, lang in known})

    def grams(t):
        t = t.lower()
        for k in language_id.ORDERS:
            for at in range(len(t)):
                yield int(language_id._buckets(np.frombuffer((t + "  ")[at : at + k].encode("utf-32-le"), np.uint32), k)[0])

    counts = {lang: collections.Counter() for lang in langs}
    for t, lang in known:
        counts[lang].update(grams(t))
    total = {lang: sum(c.values()) + language_id.SMOOTHING * (1 << language_id.BITS) for lang, c in counts.items()}
    prior = collections.Counter(lang for _, lang in known)
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.trained(docs)).collect()}
    for i, t, _ in rows:
        if not language_id.has_letter(t):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        g = collections.Counter(grams(t))
        score = {lang: np.log(prior[lang] / len(known)) + sum(n * np.log((counts[lang][b] + language_id.SMOOTHING) / total[lang]) for b, n in g.items()) for lang in langs}
        best = max(score, key=score.get)
        assert got[i].lang_pred == best
        assert abs(got[i].score - 1 / sum(np.exp(v - score[best]) for v in score.values())) < 1e-2


def test_any_number_of_languages(monkeypatch, spark):
    monkeypatch.setattr(language_id, "BLOCK_LANGS", 3)
    df = spark.createDataFrame([(i, " ".join(chr(0x4E00 + i * 7 + k) for k in range(7)) * 4, f"l{i:02d}", "s", 1) for i in range(10)], DOCS)
    model = language_id.fit(df)
    assert len(model.logp) == 4 and {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()} == {i: f"l{i:02d}" for i in range(10)}
    marks = spark.createDataFrame([(1, "\u00b2 \u00bd \u00b3 _ 7", "l01", "s", 1)], DOCS)
    assert [r.lang_pred for r in language_id.predict(marks, model).collect()] == ["und"]


def test_language_edges(odd, none):
    out = language_id.predict(odd.withColumn("score", F.lit("clash")), language_id.trained(odd)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (3, 4, 5, 17)} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id in (1, 6)} <= {"en", "de", "fr"}
    empty = language_id.trained(none)
    assert empty.langs == [] and {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(none, empty).count() == 0
    assert language_id.language_filter(odd).columns == odd.columns


# 6


def test_exact_dedup(odd, none, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        by = collections.defaultdict(list)
        for i, t in rows:
            by[spaced(t)].append(i)
        least = lambda ids: min((i for i in ids if i is not None), default=None)
        want = sorted(((i, least(by[spaced(t)]), len(by[spaced(t)]), hashlib.sha256(spaced(t).encode()).hexdigest()) for i, t in rows), key=str)
        out = exact_dedup.exact_groups(df, block_bytes=64).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
        assert sum(r.kept for r in out) == len(by) and all(r.doc_id == r.keep_id for r in out if r.kept)
    assert exact_dedup.exact_groups(none).count() == 0
    clash = odd.withColumn("kept", F.lit("mine")).withColumn("row", F.lit(1))
    stay = exact_dedup.exact_dedup(clash)
    assert stay.columns == clash.columns and {r.kept for r in stay.collect()} == {"mine"}


# 7


def test_packing(odd, none, docs):
    for df in (odd, docs):
        for shards in (8192, 20):
            out = packing.pack(df, capacity=500, per_source=2, shard_docs=shards).collect()
            bins = collections.defaultdict(list)
            for r in out:
                bins[r.shard, r.bin].append(r)
            text = {(r.doc_id): spaced(r.text) for r in df.collect()}
            for rows in bins.values():
                rows.sort(key=lambda r: r.slot)
                assert sum(r.n_tokens for r in rows) <= 500
                assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
                assert max(collections.Counter(r.source for r in rows).values()) <= 2
                if df is docs:
                    assert len({text[r.doc_id] for r in rows}) == len(rows)
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
            assert sum(r.n_tokens for r in out) == total
            assert len({(r.doc_id) for r in out}) == df.select("doc_id").distinct().count()
    assert packing.pack(none).count() == 0


def test_packing_matches_brute_force_best_fit():
    """Each document, longest first, goes to the tightest compatible bin of all; of equal rooms to the one that was first left so."""
    import pandas as pd

    rng = np.random.default_rng(9)
    for per_source in (1, 2, 5):
        rows = pd.DataFrame({"doc_id": np.arange(300), "source": rng.choice(list("abc"), 300), "n_tokens": rng.integers(0, 150, 300), "cluster": rng.integers(0, 90, 300), "key": rng.permutation(300), "copy": 1, "shard": 0})
        got = packing.pack_shard(rows, 100, per_source)
        bins, clock, want = [], 0, []
        pieces = []
        for r in rows.sort_values(["n_tokens", "key"], ascending=[False, True]).itertuples():
            n, piece = r.n_tokens, 0
            while n > 100:
                want.append((r.doc_id, piece, 100, len(bins)))
                bins.append({"room": 0, "clusters": set(), "sources": collections.Counter(), "since": 0})
                n, piece = n - 100, piece + 1
            pieces.append((n, r, piece))
        for n, r, piece in sorted(pieces, key=lambda x: -x[0]):
            fit = [i for i, b in enumerate(bins) if b["room"] >= n and b["room"] > 0 and r.cluster not in b["clusters"] and b["sources"][r.source] < per_source]
            at = min(fit, key=lambda i: (bins[i]["room"], bins[i]["since"]), default=None)
            if at is None:
                at = len(bins)
                bins.append({"room": 100, "clusters": set(), "sources": collections.Counter(), "since": 0})
            b, clock = bins[at], clock + 1
            b["room"], b["since"] = b["room"] - n, clock
            b["clusters"].add(r.cluster)
            b["sources"][r.source] += 1
            want.append((r.doc_id, piece, n, at))
        assert [tuple(x) for x in got[["doc_id", "piece", "n_tokens", "bin"]].itertuples(index=False)] == want


def test_best_fit_takes_the_tightest_compatible_bin():
    b = packing.Bins(10, 1)
    b.put(b.find(6, 1, 1), 6, 1, 1)  # room 4
    b.put(b.open(), 7, 2, 2)  # room 3
    assert b.find(3, 4, 4) == 1 and b.rooms == [4]
    b.put(1, 3, 4, 4)
    assert b.find(4, 1, 8) == 2  # the bin of room 4 has cluster 1
    assert b.find(4, 8, 1) == 3  # and source 1


# 8


def test_warc_roundtrip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>\r\n\r\nx</p>"), (2, None, None), (3, "u", "WARC/1.0\r\n\r\n"), (5000, "v", "")], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = sorted((r.segment, r.uri, bytes(r.body).decode()) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect())
    assert got == [(0, "", ""), (0, "http://a/é", "<p>\r\n\r\nx</p>"), (0, "u", "WARC/1.0\r\n\r\n"), (1, "v", "")]
    offsets = {(r.segment, r.offset) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert offsets == {(r.segment, r.offset) for r in warc.addressed(spark, f"file://{tmp_path}/w").collect()}


def test_reading_goes_on_behind_a_broken_member(spark, tmp_path):
    """Files of others: one gzip member a record; a flipped byte costs that record only."""
    import gzip

    record = lambda i: f"WARC/1.0\r\nX-Page-ID: {i}\r\nContent-Length: 600\r\n\r\n".encode() + bytes(np.random.default_rng(i).integers(97, 123, 600, np.uint8)) + b"\r\n\r\n"
    members = [bytearray(gzip.compress(record(i))) for i in range(6)]
    (tmp_path / "crawl-0.warc.gz").write_bytes(b"".join(members))
    for i, at in ((1, 100), (4, -3)):  # within the data, and in its check sum
        members[i][at] ^= 255
    (tmp_path / "crawl-1.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "plain.warc").write_bytes(record(9))
    (tmp_path / "readme.txt").write_bytes(b"no file of records")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    good = collections.defaultdict(set)
    for r in rows:
        if r.error is None:
            good[r.file.rsplit("/", 1)[1]].add(r.page_id)
    assert good == {"crawl-0.warc.gz": set(range(6)), "crawl-1.warc.gz": good["crawl-1.warc.gz"], "plain.warc": {9}}
    assert good["crawl-1.warc.gz"] >= {0, 2, 3, 5} and 1 not in good["crawl-1.warc.gz"]
    assert {r.error for r in rows if r.file.endswith("crawl-1.warc.gz")} >= {None, "broken compression"} and all(r.segment < -warc.NULL_SEGMENTS for r in rows)


def test_fixity_audit(spark, tmp_path):
    pages = spark.range(900).selectExpr("id * 17 AS page_id", "concat('u', id) AS url", "repeat('x', cast(id % 400 as int)) AS html")
    ours = warc.addressed(spark, stored(spark, tmp_path, "pages", pages)).cache()
    bad = (F.col("page_id") % 101 == 3, F.col("page_id") % 89 == 0)
    theirs = ours.where(~bad[1]).withColumn("digest", F.when(bad[0], F.lit("?")).otherwise(F.col("digest")))
    extra = spark.createDataFrame([(7, 123, "d")], "segment long, offset long, digest string")
    theirs = theirs.select("segment", "offset", "digest").unionByName(extra)
    want = {(r.segment, r.offset, "missing" if r.page_id % 89 == 0 else "changed") for r in ours.where(bad[0] | bad[1]).collect()} | {(7, 123, "extra")}
    got = {tuple(r) for r in warc.audit(ours, theirs, range_bytes=1000, fan_out=4).collect()}
    assert got == want
    assert warc.audit(ours, ours).count() == 0
    none = ours.where("false")
    assert warc.audit(none, none).count() == 0 and warc.audit(ours, none).count() == 900


def stored(spark, tmp_path, name, pages, **options):
    path = f"file://{tmp_path}/{name}"
    warc.write_warc(pages, path, **options)
    return path


def test_audit_of_a_replica_whose_records_moved(spark, tmp_path):
    pages = spark.range(900).selectExpr("id * 17 AS page_id", "concat('u', id) AS url", "repeat('x', cast(id % 400 as int)) AS html")
    lost, changed = F.col("page_id") % 101 == 3, F.col("page_id") % 89 == 0
    html = F.when(changed, F.concat("html", F.lit("more"))).otherwise(F.col("html"))
    new = spark.createDataFrame([(5, "new", "y" * 70)], "page_id long, url string, html string")
    ours = warc.addressed(spark, stored(spark, tmp_path, "ours", pages)).cache()
    theirs = warc.addressed(spark, stored(spark, tmp_path, "theirs", pages.where(~lost).withColumn("html", html).unionByName(new))).cache()
    want = {(r.segment, r.offset, r.page_id, "missing" if r.page_id % 101 == 3 else "changed") for r in ours.where(lost | changed).collect()}
    want |= {(r.segment, r.offset, 5, "extra") for r in theirs.where("page_id = 5").collect()}
    got = [tuple(r) for r in warc.audit(ours, theirs, 1000, 4, key="page_id", carry=["page_id"]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_flipped_byte_in_a_stored_file_is_located(spark, tmp_path):
    pages = spark.range(700).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('<p>', repeat('x', 50 + cast(id % 90 as int)), '</p>') AS html")
    a, b = (stored(spark, tmp_path, n, pages, segment_pages=256, compression="none") for n in ("a", "b"))
    ours = warc.addressed(spark, a).cache()
    hurt = ours.where("page_id = 300").first()
    file = sorted((tmp_path / "b" / f"segment={hurt.segment}").glob("part-*"))[0]
    data = bytearray(file.read_bytes())
    data[hurt.offset + hurt.length - 10] ^= 1
    file.write_bytes(bytes(data))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    got = [tuple(r) for r in warc.audit(ours, warc.addressed(spark, b), 2000, 4, key="page_id", carry=["page_id"]).collect()]
    assert got == [(hurt.segment, hurt.offset, 300, "changed")]


def test_reader_reports_what_is_broken(spark, tmp_path):
    good = lambda i: (f"WARC/1.0\r\nX-Page-ID: {i}\r\nWARC-Target-URI: u\r\nContent-Length: 3\r\n\r\nab{i}").encode()
    end = b"\r\n\r\n"
    parts = [good(1), b"HTTP/1.1 200", good(2), b"WARC/1.0\r\nContent-Length: x\r\n\r\nq", good(3), b"WARC/1.0\r\nContent-Length: 99\r\n\r\nz", b"WARC/1.0\r\nX-Page-ID: \xff\r\nContent-Length: 2\r\n\r\n\xff\xfe", b"WARC/1.0\r\nContent-Length: 50\r\n\r\ncut"]
    found = list(warc.parsed(end.join(parts)))
    assert [(h.get(b"x-page-id"), body, error) for _, _, h, body, error in found] == [
        (b"1", b"ab1", None), (None, parts[1], "no record"), (b"2", b"ab2", None), (None, parts[3], "no length"), (b"3", b"ab3", None), (None, parts[5], "wrong length" if len(end.join(parts[5:])) > 140 else "cut off"),
        (b"\xff", b"\xff\xfe", None), (None, parts[7], "cut off"),
    ]
    assert list(warc.parsed(b"")) == [] and [e for *_, e in warc.parsed(b"no end")] == ["no record"]
    (tmp_path / "x" / "segment=0").mkdir(parents=True)
    import gzip

    whole = gzip.compress(end.join([good(1), good(2)]) + end)
    (tmp_path / "x" / "segment=0" / "part-0-c000.txt.gz").write_bytes(whole)
    (tmp_path / "x" / "segment=0" / "part-0-c001.txt.gz").write_bytes(whole[:-12])
    rows = warc.read_warc(spark, f"file://{tmp_path}/x").collect()
    assert sum(r.error is None for r in rows) >= 2 and [r.error for r in rows if r.file.endswith("c001.txt.gz")][-1] == "broken compression"
    assert {r.page_id for r in rows if r.error is None} <= {1, 2}


def test_records_of_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x"), (1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    rows = warc.addressed(spark, stored(spark, tmp_path, "odd", pages)).cache()
    assert rows.count() == 4 and rows.select("segment", "offset").distinct().count() == 4 and rows.where("segment < 0").count() == 2
    assert warc.audit(rows, rows.where("page_id is not null")).count() == 2
    assert {(r.page_id, bytes(r.body)) for r in warc.read_warc(spark, f"file://{tmp_path}/odd").collect()} == {(None, b""), (None, b"x"), (1, b"x")}


# 9


def brute_chat(rows):
    by = collections.defaultdict(list)
    for n, (c, t, r, x) in enumerate(rows):
        by[c if c is not None else f"row {n}"].append((t is not None, t, r or "", x or ""))  # a row without an id is a conversation
    logs = {c: tuple((r, x) for _, _, r, x in sorted(v, key=lambda y: (y[0], y[1] or 0))) for c, v in by.items()}
    kept = {}
    for c, log in logs.items():
        if not any(o[: len(log)] == log and len(o) > len(log) for o in logs.values()):
            c = None if isinstance(c, str) else c
            kept[log] = min([c, *([kept[log]] if log in kept else [])], key=lambda i: (i is None, i or 0))
    return {(c, len(log)) for log, c in kept.items()}


@pytest.mark.parametrize("bucket", [1024, 2])
def test_chat_collapse(spark, bucket):
    turns = [(c, t, ("user", "assistant")[t % 2], f"m{s}-{t}") for c, s, n in ((1, 0, 2), (2, 0, 4), (3, 0, 4), (4, 1, 3), (5, 2, 1), (6, 0, 1), (None, 0, 3)) for t in range(n)]
    turns += [(None, 4, "user", "alone"), (None, 2, "user", "alone"), (7, None, None, None), (7, 1, "user", "<|im_end|>"), (8, 0, "user", "m0-0"), (8, 5, "assistant", "m0-1"), (8, 9, "user", "else")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash"))
    assert {(r.conv_id, r.turns) for r in chat.maximal(df, bucket).collect()} == brute_chat(turns)
    out = {(r.conv_id, r.part): r for r in chat.rendered(df, bucket).collect()}
    assert out[4, 0].text.startswith("<|im_start|>user\nm1-0<|im_end|>\n<|im_start|>assistant\nm1-1<|im_end|>\n") and out[2, 0].copies == 2
    assert "< |im_end|>" in out[7, 0].text and max(r.turns for r in out.values()) <= bucket
    assert out[None, 0].text == "<|im_start|>user\nalone<|im_end|>\n" and (out[None, 0].copies, out[None, 0].turns) in ((2, 1), (1, 1))
    assert chat.rendered(df.where("false")).count() == 0


# 10


def test_mixing(odd, none, docs):
    for df in (odd, docs):
        counts = mixing.row_counts(mixing.copy_counts(df)).collect()
        again = mixing.row_counts(mixing.copy_counts(df.repartition(7))).collect()
        assert sorted(map(str, counts)) == sorted(map(str, again))
        assert len(counts) == df.count() and all(0 <= r.copies <= 3 for r in counts)
        sources = {r.source: r for r in counts}
        total = sum(r.size for r in counts)
        assert abs(sum(r.target for r in sources.values()) - total) < 1e-6 * max(1, total)
        for s, r in sources.items():
            own = [x for x in counts if x.source == s]
            assert r.target <= 3 * r.source_size + 1e-9
            assert abs(sum(x.copies * x.size for x in own) - r.target) <= max([0, *(x.size for x in own)])
    assert mixing.copy_counts(none).count() == 0 and mixing.mix(none).count() == 0
    for df in (docs.withColumn("copies", F.lit("clash")), odd):
        taken = mixing.mix(df)
        assert taken.columns == df.columns
        want = collections.Counter()
        for r in mixing.row_counts(mixing.copy_counts(df)).collect():
            want[r.doc_id, r.source, r.size] += r.copies
        words_ = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert collections.Counter((r.doc_id, r.source, words_(r.text)) for r in taken.collect()) == +want


def brute_targets(sizes):
    """Targets by sharing the words by weight, the excess over three times a source's size again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] >= 3 * sizes[s]]
        if not above:
            break
        for s in above:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out | {s: level * weight[s] for s in free}


def test_mixing_of_repeated_rows_and_of_several_levels_of_the_tree(monkeypatch, spark):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    same = [(1, "a b c d e f g h", "en", "hot", 1)] * 1000
    rng = np.random.default_rng(3)
    rows = same + [(None if i % 7 == 0 else i, " ".join(["w"] * int(rng.integers(1, 60))), "en", ("x", "y", None)[i % 3], 1) for i in range(5000)]
    counts = mixing.row_counts(mixing.copy_counts(spark.createDataFrame(rows, DOCS))).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for s, target in want.items():
        own = [r for r in counts if r.source == s]
        assert own[0].target == pytest.approx(target) and abs(sum(r.copies * r.size for r in own) - target) <= 60
    assert len({r.copies for r in counts if r.doc_id == 1 and r.source == "hot"}) <= 2


def test_targets_share_what_capped_sources_cannot_take(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 799)], "source string, words long")
    got = {r.source: round(r.target, 6) for r in mixing.source_targets(df).collect()}
    assert got[None] == pytest.approx(1000 - 3 - 300 - 300) and got["a"] == 3 and got["b"] == 300 and got["c"] == 300


def test_pivoting_is_fair_and_keeps_the_sum():
    words_ = np.array([50, 40, 30, 20, 10, 5, 5, 1.0])
    mean = np.zeros(8)
    for seed in range(3000):
        rng = np.random.default_rng(seed)
        out = mixing._pivot(mixing._pool(0.3, words_, rng), words_, rng, False)
        assert abs(out @ words_ - 0.3 * words_.sum()) < 1e-6
        mean += out / 3000
    assert np.abs(mean - 0.3).max() < 0.05


# registered queries


#: Queries with one row for each row of a table.
WHOLE = {"op2_near_dedup": "documents", "op3_suffix_dedup": "documents", "op4_debruijn_dedup": "documents", "op5_language_id": "documents", "op6_exact_dedup": "documents", "op10_mixing": "documents"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    """Queries with SQL against it; of the others those that give each row of a table, by its ids."""
    out = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        c = con.execute(queries.SQL[name])
        columns = [d[0] for d in c.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted(map(repr, map(tuple, out.select(*columns).collect()))) == sorted(map(repr, c.fetchall()))
    elif name in WHOLE:
        ids = [r.doc_id for r in spark.read.parquet(f"{SF}/{WHOLE[name]}.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(ids)
    else:
        assert out.count() > 0


def test_stages_of_the_pipeline_take_odd_and_empty_tables(odd, none, spark):
    import corpus_pipeline

    for start in (odd.withColumn("kept", F.lit("clash")).withColumn("k1", F.lit(1)).withColumn("row", F.lit(1)), none):
        out = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, out = out, stage(spark, out, SF).cache()
            assert out.columns == start.columns, name
            known = {(r.doc_id, r.text) for r in before.collect()}
            assert {(r.doc_id, r.text) for r in out.collect()} <= known, name
            if name == "near_dedup":
                texts = [r.text for r in out.collect()]
                assert len(texts) == len(set(texts)), "one document of each group"
        packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in out.collect()}


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SF).cache()
        out.count()
        assert out.columns == docs.columns, name
        if name == "near_dedup":
            want = near_classes([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect())


def test_texts_meet_their_anchors_once(spark, monkeypatch):
    common = "a passage that is longer than fifty bytes and stands in each of these texts, again and again. "
    plans, real = [], suffix_dedup.written

    def written(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, tag)

    monkeypatch.setattr(suffix_dedup, "written", written)
    out = suffix_dedup.dedup(spark.createDataFrame([(i, f"{i} " * 40 + common) for i in range(5)], "doc_id long, text string"), texts=False).collect()
    assert sorted((r.doc_id, r.n_removed >= len(common)) for r in out) == [(0, False), *((i, True) for i in range(1, 5))]
    rounds = [plan for tag, plan in plans if tag == "hits"]
    assert len(rounds) == suffix_dedup.ROUNDS and not any("Join" in plan for plan in rounds) and sum("Join" in plan for tag, plan in plans if tag == "cuts") == 1
