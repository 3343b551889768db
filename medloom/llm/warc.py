"""WARC records, their files, and a Merkle fixity audit of replicas.

Each record is hashed; the hashes of the records of an ordered offset range are hashed together, ranges are joined
into wider ranges up to the whole segment, and segments into ranges of segments up to one root. Two replicas
are compared at the root; only the children of nodes that differ are looked at, level by level, down to records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SEGMENT_PAGES = 4096
FILE_RECORDS = 1024
RANGE_BYTES = 64 * 1024
FAN_OUT = 16
CRAWL_DATE = "2024-01-01T00:00:00Z"
NULL_SEGMENTS = 1024
#: Fixed value: the first bytes of a gzip member.
GZIP = b"\x1f\x8b\x08"
STEP = 1 << 16
READ = "segment long, file string, offset long, length long, digest string, page_id long, uri string, body binary, error string"


def record(page_id: str | Column, url: str | Column, body: str | Column, date: str = CRAWL_DATE) -> Column:
    """The text of a WARC/1.0 resource record, without the two line ends that follow it; null counts as empty."""
    url, body = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (url, body))
    page_id = F.coalesce((F.col(page_id) if isinstance(page_id, str) else page_id).cast("string"), F.lit(""))
    id_ = F.md5(F.concat(url, F.lit("\n"), body))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), id_, F.lit(">\r\nWARC-Date: " + date + "\r\nWARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", ""),
        F.lit("\r\nX-Page-ID: "), page_id, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write_warc(pages: DataFrame, path: str, segment_pages: int = SEGMENT_PAGES, compression: str = "gzip") -> None:
    """WARC files of FILE_RECORDS records at most for each segment under ``path``, by Spark's text writer, which ends records.

    A segment holds the pages of a range of ids, in order; pages without an id go to NULL_SEGMENTS segments below 0 by content,
    in the order of their text. Repeated rows are records of their own.
    """
    rows = pages.select("page_id", record("page_id", "url", "html").alias("value"))
    segment = F.coalesce(F.floor(F.col("page_id") / segment_pages), -1 - F.pmod(F.xxhash64("value"), F.lit(NULL_SEGMENTS)))
    rows = rows.select(segment.alias("segment"), "page_id", "value").repartition("segment").sortWithinPartitions("segment", "page_id", "value")
    writer = rows.select("segment", "value").write.partitionBy("segment").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("compression", compression).text(path)


def _inflated(content: bytes) -> tuple[bytes, str | None]:
    """A file's bytes; of a file whose compression is broken what can be read, and what is wrong.

    Of a broken member (WARC files have one a record) what comes before the break is given; reading goes on at the next member.
    """
    if content[:2] != GZIP[:2]:
        return content, None
    try:
        return gzip.decompress(content), None
    except (EOFError, OSError, zlib.error):
        pass
    out, at = bytearray(), 0
    while 0 <= at < len(content):
        stream, fed, good = zlib.decompressobj(31), at, True
        while good and not stream.eof and fed < len(content):
            before = stream.copy()
            try:
                out += stream.decompress(content[fed : fed + STEP])
                fed += STEP
            except zlib.error:
                good, stream = False, before
        for i in range(fed, 0 if good else min(fed + STEP, len(content))):  # up to the break
            try:
                out += stream.decompress(content[i : i + 1])
            except zlib.error:
                break
        if good and stream.eof:
            at = min(fed, len(content)) - len(stream.unused_data)
            at = at if content[at : at + 3] == GZIP else content.find(GZIP, at)
        else:
            if out and not out.endswith(b"\r\n\r\n"):
                out += b"\r\n\r\n"  # what was cut off ends here
            at = content.find(GZIP, at + 1)
    return bytes(out), "broken compression"


def parsed(data: bytes):
    """(offset, length, headers, body, error) of each record of a file; what is no record up to the next one is one with an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].split(b"\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = head.get(b"content-length", b"")
        if not lines[0].startswith(b"WARC/") or not size.isdigit():
            error = "no record" if not lines[0].startswith(b"WARC/") else "no length"
        elif end + 4 + int(size) > len(data):
            error = "cut off"
        elif data[end + 4 + int(size) : end + 8 + int(size)] not in (b"\r\n\r\n", b""):
            error = "wrong length"
        else:
            stop = end + 4 + int(size)
            yield at, stop - at, head, data[end + 4 : stop], None
            at = stop + 4
            continue
        after = data.find(b"\r\n\r\nWARC/", at + 1)
        stop = after if after >= 0 else len(data)
        yield at, stop - at, {}, data[at:stop], error
        at = stop + 4 if after >= 0 else len(data)


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """READ: every record of the files under ``path``, with its place in the file, the hash of its bytes and, if ``bodies``, its body.

    What can't be read as a record is a row with ``error`` (no record, no length, cut off, wrong length, broken compression),
    and reading goes on at the next record; nothing raises. A missing or foreign page id is null. A path without files
    gives no rows. Each file is read as a whole. Files of ``write_warc`` and any ``*.warc`` and ``*.warc.gz`` are read; those not under
    a segment's folder come to segments below -NULL_SEGMENTS by their names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path)
    named = F.regexp_extract("path", r"segment=(-?\d+)", 1).try_cast("long")
    other = -1 - NULL_SEGMENTS - F.pmod(F.xxhash64(F.substring_index("path", "/", -1)), F.lit(NULL_SEGMENTS))
    files = files.select(F.coalesce(named, other).alias("segment"), "path", "content")

    def run(batches):
        for batch in batches:
            for segment, file, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, broken = _inflated(content)
                rows = [(segment, file, at, n, hashlib.sha256(data[at : at + n]).hexdigest(), head.get(b"x-page-id", b""), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), body if bodies else None, error) for at, n, head, body, error in parsed(data)]
                if broken:
                    rows.append((segment, file, len(data), 0, hashlib.sha256(b"").hexdigest(), b"", "", None, broken))
                columns = list(zip(*rows)) or [()] * 9
                columns[5] = [int(x) if x.lstrip(b"-").isdigit() else None for x in columns[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()))], [f.split()[0] for f in READ.split(", ")])

    return files.mapInArrow(run, READ)


def addressed(spark: SparkSession, path: str) -> DataFrame:
    """page_id, segment, offset, length, digest, error of the records that are stored under ``path``, read and hashed.

    An offset counts from the first byte of a segment's first file.
    """
    rows = written(read_warc(spark, path, bodies=False).drop("body", "uri"), "records")
    files = rows.groupBy("segment", "file").agg(F.max(F.col("offset") + F.col("length") + 4).alias("size"))
    before = Window.partitionBy("segment").orderBy(F.regexp_extract("file", r"c(\d+)\.", 1), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("segment", "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return rows.join(files, ["segment", "file"]).select("page_id", "segment", (F.col("offset") + F.col("before")).alias("offset"), "length", "digest", "error")


def depth(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> tuple[int, int]:
    """Levels of ranges within a segment, and levels of segments, that ``leaves`` needs.

    Segments below 0 come to node -1 and the others to node 0; the last level joins the two.
    """
    end, low, high = leaves.agg(F.max("offset"), F.min("segment"), F.max("segment")).first()
    ranges, inner = (end or 0) // range_bytes, 1
    while ranges:
        ranges, inner = ranges // fan_out, inner + 1
    low, high, outer = low or 0, high or 0, 0
    while low != high and (low, high) != (-1, 0):
        low, high, outer = low // fan_out, high // fan_out, outer + 1
    return inner, outer + (low != high)


def tree(leaves: DataFrame, levels: tuple[int, int], range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Level by level from the records up to the root: segment, node, digest, and the parent's up_segment and up_node.

    Records at one place (repeated leaves) are hashed together.
    """
    inner, outer = levels
    floor = lambda c, n: F.floor(F.col(c) / n)
    at = leaves.groupBy("segment", F.col("offset").alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ","), 256).alias("digest"))
    out = []
    for level in range(inner + outer + 1):
        if level < inner:
            up = [F.col("segment"), floor("node", range_bytes if level == 0 else fan_out)]
        else:
            up = [floor("segment", fan_out) if level < inner + outer - 1 else F.lit(0).cast("long"), F.lit(0).cast("long")]
        at = written(at.select("segment", "node", "digest", up[0].alias("up_segment"), up[1].alias("up_node")), f"level{level}")
        out.append(at)
        children = F.sort_array(F.collect_list(F.struct("segment", "node", "digest")))
        spelled = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["segment"].cast("string"), x["node"].cast("string"), x["digest"])), ",")
        at = at.groupBy(F.col("up_segment").alias("segment"), F.col("up_node").alias("node")).agg(F.sha2(spelled, 256).alias("digest"))
    return out


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT, key: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """segment, offset, the columns ``carry`` and status of each record that ``theirs`` lost (missing), changed or added (extra).

    Both have segment, offset, digest, and ``carry``; an extra record's place and columns are those in ``theirs``.
    Two empty replicas agree. Equal subtrees are never opened. A lost or longer record moves those behind it: where
    places differ, records of a segment are the same if their digests are, wherever they lie; of the others, those of
    one ``key`` (a column that names a record whatever its content; without, the offset) are one changed record.
    """
    carry = carry or []
    levels = tuple(map(max, depth(ours, range_bytes, fan_out), depth(theirs, range_bytes, fan_out)))
    a, b = tree(ours, levels, range_bytes, fan_out), tree(theirs, levels, range_bytes, fan_out)
    wrong = None
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level], b[level]
        if wrong is not None:
            parents = wrong.select(F.col("segment").alias("up_segment"), F.col("node").alias("up_node")).distinct()
            x, y = x.join(parents, ["up_segment", "up_node"], "left_semi"), y.join(parents, ["up_segment", "up_node"], "left_semi")
        both = x.select("segment", "node", F.col("digest").alias("d")).join(y.select("segment", "node", F.col("digest").alias("e")), ["segment", "node"], "full_outer")
        wrong = written(both.where(~F.col("d").eqNullSafe(F.col("e"))), f"wrong{level}")
    places = wrong.select("segment", F.col("node").alias("offset"))

    def side(rows: DataFrame, own: bool) -> DataFrame:
        fields = F.struct("offset", *carry).alias("record")
        return rows.join(places, ["segment", "offset"], "left_semi").select("segment", "offset", "digest", F.col(key or "offset").alias("key"), fields, F.lit(own).alias("own"))

    # the i-th copy of a digest in ours is the i-th in theirs; so for keys among what is left
    for by in ("digest", "key"):
        rows = side(ours, True).unionByName(side(theirs, False)) if by == "digest" else alone
        numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy("segment", by, "own").orderBy("offset", "digest")))
        met = numbered.withColumn("sides", F.count("*").over(Window.partitionBy("segment", by, "copy")))
        alone = met.where("sides = 1").drop("copy", "sides") if by == "digest" else met
    paired = (F.col("sides") == 2) & F.col("key").isNotNull()
    status = F.when(paired, "changed").when(F.col("own"), "missing").otherwise("extra")
    return alone.where(F.col("own") | ~paired).select("segment", "record.offset", *[F.col("record")[c].alias(c) for c in carry], status.alias("status"))
