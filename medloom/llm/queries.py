"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, concat_cut, debruijn_dedup, exact_dedup, language_id, lexical, mixing, near_dedup, packing, spelling, suffix_dedup, warc
from .common import folder, removed, table, written


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs, carry=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), texts=False)


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.dedup(table(spark, sf_dir, "documents"), texts=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.trained(docs)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC files twice, the second time each 89th page changed (and longer) and each 211th lost; reads and hashes both, and audits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lost, changed = F.col("page_id") % 211 == 5, F.col("page_id") % 89 == 3
    replica = pages.where(~F.coalesce(lost, F.lit(False))).withColumn("html", F.when(changed, F.concat(F.coalesce("html", F.lit("")), F.lit("damaged"))).otherwise(F.col("html")))

    def stored(rows: DataFrame, name: str) -> DataFrame:
        path = folder(spark, name)
        warc.write_warc(rows, path)
        out = written(warc.addressed(spark, path), name)
        removed(spark, path)
        return out

    ours, theirs = stored(pages, "ours"), stored(replica, "replica")
    return warc.audit(ours, theirs, key="page_id", carry=["page_id", "length"]).select("page_id", "segment", "offset", "length", "status")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = mixing.row_counts(mixing.copy_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run whose crc32 with the doc_id is divisible by 199 one letter is left out: the misspelt words to be found."""
    seen = spelling.runs(table(spark, sf_dir, "documents"))
    h, length = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")), F.length("run")
    seen = seen.select(F.when(h % 199 == 0, spelling.without(F.col("run"), (h % length).cast("int"))).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(seen))


def op12_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return concat_cut.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False)


def op13_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_near_dedup": op2_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_debruijn_dedup": op4_debruijn_dedup,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_warc_audit": op8_warc_audit,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_concat_cut": op12_concat_cut,
    "op13_tput": op13_tput,
}

SQL: dict[str, str] = {
    "op3_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
             w AS (SELECT r, doc_id, p, array_slice(b, p + 1, p + 50) AS s FROM (SELECT r, doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM d WHERE octet_length(b) >= 50)),
             m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
             h AS (SELECT r, p FROM w JOIN m ON w.s = m.s WHERE low < doc_id),
             g AS (SELECT r, p, sum(CASE WHEN p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM h)),
             n AS (SELECT r, min(p) AS start, max(p) + 50 AS stop FROM g GROUP BY r, k),
             k AS (SELECT r, start, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS a, start AS z FROM n UNION ALL SELECT d.r, octet_length(b), coalesce(max(stop), 0), octet_length(b) FROM d LEFT JOIN n ON d.r = n.r GROUP BY d.r, b),
             x AS (SELECT k.r, string_agg(CASE WHEN z > a THEN hex(array_slice(b, a + 1, z)) ELSE '' END, '' ORDER BY start) AS kept FROM k JOIN d ON k.r = d.r GROUP BY k.r)
        SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(q.removed, 0)::BIGINT AS n_removed, coalesce(q.spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN x ON d.r = x.r LEFT JOIN (SELECT r, sum(stop - start) AS removed, count(*) AS spans FROM n GROUP BY r) q ON d.r = q.r""",
    "op4_debruijn_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
             w AS (SELECT r, p, array_to_string(list_slice(t, p + 1, p + 35), ' ') AS s FROM (SELECT r, t, unnest(range(len(t) - 34)) AS p FROM d WHERE len(t) >= 35)),
             m AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
             h AS (SELECT r, p FROM w JOIN m ON w.s = m.s),
             g AS (SELECT r, p, sum(CASE WHEN p > before + 35 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM h)),
             n AS (SELECT r, min(p) AS start, max(p) + 35 AS stop FROM g GROUP BY r, k),
             k AS (SELECT r, start, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS a, start AS z FROM n UNION ALL SELECT d.r, len(t), coalesce(max(stop), 0), len(t) FROM d LEFT JOIN n ON d.r = n.r GROUP BY d.r, t),
             x AS (SELECT k.r, coalesce(string_agg(array_to_string(list_slice(t, a + 1, z), ' '), ' ' ORDER BY start) FILTER (z > a), '') AS kept FROM k JOIN d ON k.r = d.r GROUP BY k.r)
        SELECT d.doc_id, len(t)::BIGINT AS n_words, coalesce(q.removed, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256
        FROM d JOIN x ON d.r = x.r LEFT JOIN (SELECT r, sum(stop - start) AS removed FROM n GROUP BY r) q ON d.r = q.r""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op8_warc_audit": r"""
        WITH r AS (SELECT page_id, page_id // 4096 AS segment, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
             l AS (SELECT page_id, segment,
                          strlen('WARC/1.0WARC-Type: resourceWARC-Record-ID: <urn:md5:>WARC-Date: 2024-01-01T00:00:00ZWARC-Target-URI: X-Page-ID: Content-Type: text/htmlContent-Length: ')
                          + 18 + 32 + strlen(CAST(page_id AS VARCHAR)) + strlen(u) + strlen(cast(strlen(h) AS VARCHAR)) + strlen(h) AS length FROM r),
             a AS (SELECT *, coalesce(sum(length + 4) OVER (PARTITION BY segment ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM l)
        SELECT page_id, segment, cast("offset" AS BIGINT) AS "offset", length, CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS status
        FROM a WHERE page_id % 211 = 5 OR page_id % 89 = 3""",
    "op9_chat": r"""
        WITH r AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                          string_agg(coalesce(role, '') || chr(31) || coalesce(text, '') || chr(30), '') OVER w AS s
                   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
             k AS (SELECT s, min(conv_id) AS conv_id, count(*) AS copies FROM r WHERE pos = n GROUP BY s),
             m AS (SELECT * FROM k WHERE s NOT IN (SELECT s FROM r WHERE pos < n))
        SELECT m.conv_id, CAST((pos - 1) // 1024 AS BIGINT) AS part, count(*) AS turns, any_value(m.copies) AS copies,
               string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
        FROM m JOIN r ON r.conv_id = m.conv_id GROUP BY 1, 2""",
    "op11_spelling": r"""
        WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
             r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                   FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
             b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                                                         lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM r),
             h AS (SELECT run, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, c),
             w AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
             v AS (SELECT word, n FROM w WHERE length(word) >= 6 AND n >= 5),
             d AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
             p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                   UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
             s AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS best, max(m) AS m FROM p GROUP BY word),
             f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN s ON v.word = s.word),
             q AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT q.word, f.word, f.form FROM q JOIN f ON q.next = f.word)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN q ON f.word = q.word WHERE next IS NULL""",
    "op13_tput": r"""
        WITH p AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
             d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), re) AS t FROM documents, p),
             c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
             x AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
             w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM x, c GROUP BY term, docs),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, u, l), re)) AS term FROM benchmark, p),
             s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score FROM q JOIN x USING (term) JOIN w USING (term), c GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
