"""WARC archives written by Spark tasks and read back, segmented records reassembled.

Writing: one ``application/http`` block per page, its body in chunked transfer framing. A block over ``segment_bytes``
is written as several records: the first with ``WARC-Segment-Number: 1``, the others as ``continuation`` records that
name it in ``WARC-Segment-Origin-ID``, the last with ``WARC-Segment-Total-Length``. Of pages with equal payloads of at
least ``MIN_REVISIT`` bytes only that with the smallest page_id carries its payload; the others are ``revisit`` records.
Only digests are grouped for that, never payloads. Every task writes gzip files through Spark's text sink, so they land
wherever Spark can write, and a lost executor writes its files anew.

Reading: every file is inflated as a stream and cut into records by their lengths. Whole records are decoded where they
are read; segments alone are shuffled, grouped by origin, ordered by number and held against the total length.

A null html is an empty payload, a null url an empty one; control characters of a url are percent-encoded. Rows with the
smallest page_id of a payload are all responses if that id repeats. A null page_id is never the smallest unless all are
null, and then all are responses. An empty table gives archives without records. Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm.common import slices, table
from periodica.session import materialize, shared_folder

MIN_REVISIT = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 20_000
#: Payloads with more copies than this are dealt over several tasks when rows meet their first copy.
HOT_COPIES = 10_000
VERSION = "WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
RECORD_SCHEMA = "origin string, segment int, total long, kind string, refers string, block binary"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunks of whole UTF-8 characters, so that the framed block is text again."""
    return b"".join([*(b"%x\r\n%s\r\n" % (len(p), p) for p in cut_text(body, size) if p), b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are skipped. A broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(framed[at : at + size])
        at += size + 2


def cut_text(block: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that do not split a UTF-8 character."""
    out, at = [], 0
    while at < len(block):
        end = min(at + size, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return out or [b""]


def _record(kind: str, rid: str, block: bytes, extra: Iterable[tuple[str, object]]) -> str:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *extra, ("Content-Length", len(block))]
    return f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block.decode()


def page_records(rid: str, url: str, html: bytes, digest: str, n: int, kind: str, refers: str | None, segment_bytes: int) -> Iterator[str]:
    """The records of one page, without the blank lines that end a record."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    extra = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record(kind, rid, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % n, [*extra, ("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", profile)])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    parts = cut_text(block, segment_bytes)
    if len(parts) == 1:
        yield _record(kind, rid, block, extra)
        return
    for i, part in enumerate(parts, 1):
        own = [*extra, ("WARC-Segment-Number", 1)] if i == 1 else [("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", i)]
        if i == len(parts):
            own.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(kind if i == 1 else "continuation", rid if i == 1 else f"{rid}/{i}", part, own)


def with_kinds(pages: DataFrame, hot_copies: int = HOT_COPIES) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits) of ``pages`` (page_id, url, html): responses keep html, revisits have ``refers`` instead.

    Both have url, sha (hex digest) and n (payload bytes).
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("sha"), F.octet_length(payload).cast("long").alias("n"))
    heads = materialize(rows.select("page_id", "url", "sha", "n"))
    copies = heads.filter(F.col("n") >= MIN_REVISIT).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    copies = materialize(copies.filter((F.col("copies") > 1) & F.col("first").isNotNull()))
    salts = F.ceil(F.col("copies") / hot_copies).cast("int")
    most = copies.agg(F.max(salts)).first()[0] or 1
    # rows of a hot digest go to ``salts`` places, and so does its first copy; others to one
    hot = copies.filter(F.col("copies") > hot_copies).select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("salt"))
    own = heads.filter(F.col("n") >= MIN_REVISIT).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(most)).cast("int"))
    cold = own.join(copies.filter(F.col("copies") <= hot_copies).select("sha", "first"), "sha")
    found = cold.unionByName(own.join(hot, ["sha", "salt"])) if most > 1 else cold
    revisits = materialize(found.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "url", "sha", "n", F.col("first").alias("refers")))
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("sha").alias("gone_sha")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha"))
    return rows.join(gone, same, "left_anti"), revisits


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``."""
    responses, revisits = with_kinds(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))

    def encode(batches):
        unit, row = uuid.UUID(int=TaskContext.get().partitionId()).hex[-8:], 0
        for batch in slices(batches, "html", 4_000_000):
            out = []
            for r in batch.to_pylist():
                rid, refers = f"urn:page:{r['key']}#{r['refers'] is not None and 'v' or 'r'}{unit}-{row}", r["refers"] and f"urn:page:{r['refers']}"
                row += 1
                out += page_records(rid, r["url"] or "", (r["html"] or "").encode(), r["sha"], r["n"], "revisit" if refers else "response", refers, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    for rows, mode in ((responses.withColumn("refers", F.lit(None).cast("string")), "errorifexists"), (revisits.withColumn("html", F.lit(None).cast("string")), "append")):
        shaped = rows.select(key.alias("key"), "url", "html", "sha", "n", F.col("refers").cast("string").alias("refers"))
        sink = shaped.mapInArrow(encode, "value string").write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", "gzip")
        sink.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Inflated:
    """A gzip file's bytes as a stream, inflated a little at a time; several members may follow each other."""

    def __init__(self, data: bytes):
        self.source, self.at = data, 0
        self.inflate, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            rest = self.inflate.unused_data
            self.at -= len(rest)
            self.inflate = zlib.decompressobj(31)
        if self.at >= len(self.source):
            return False
        part = self.source[self.at : self.at + 65536]
        self.at += len(part)
        self.held += self.inflate.decompress(part)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_file(data: bytes) -> Iterator[tuple]:
    """Records of one gzip file as rows of ``RECORD_SCHEMA``; the total is set where no segment may be missing."""
    stream = _Inflated(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"not a record: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        block = stream.take(n)
        if len(block) != n or stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        segment = int(fields.get("WARC-Segment-Number", 0))
        total = fields.get("WARC-Segment-Total-Length", None if segment else n)
        yield origin.strip("<>"), segment, None if total is None else int(total), fields["WARC-Type"], fields.get("WARC-Refers-To", "").strip("<>"), block


def _decoded(kind: str, block: bytes) -> tuple[int | None, bytes | None]:
    """Payload length and, but for revisits, the payload."""
    head, body = block.split(b"\r\n\r\n", 1)
    fields = dict(line.lower().split(b": ", 1) for line in head.split(b"\r\n")[1:])
    if kind == "revisit":
        return int(fields[b"content-length"]), None
    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    return len(payload), payload


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``, segments still apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for row in parse_file(data.as_py()):
                    rows.append(row)
                    held += len(row[-1])
                    if held > 4_000_000:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    def _rows(rows):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["origin", "segment", "total", "kind", "refers", "block"])

    return files.mapInArrow(parse, RECORD_SCHEMA)


def reassembled(records: DataFrame) -> DataFrame:
    """(origin, kind, refers, block, complete): continuation records joined to what they continue.

    ``complete`` is false where a number is missing or repeated or the length is not the announced total.
    """
    whole = records.filter("segment = 0").select("origin", "kind", "refers", "block", F.lit(True).alias("complete"))
    parts = records.filter("segment > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"), F.max(F.when(F.col("segment") == 1, F.col("refers"))).alias("refers"),
    )
    block = F.aggregate("parts.block", F.lit(b""), lambda a, b: F.concat(a, b))
    numbered = F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))
    joined = parts.withColumn("block", block)
    complete = F.coalesce(numbered & (F.octet_length("block") == F.col("total")), F.lit(False))
    return whole.unionByName(joined.select("origin", F.coalesce("kind", F.lit("continuation")).alias("kind"), F.coalesce("refers", F.lit("")).alias("refers"), "block", complete.alias("complete")))


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, complete[, payload]) of the archives in ``path``.

    A revisit has its length from its own header; its digest is that of the response it refers to. An incomplete
    record has no payload, length or digest.
    """

    def decode(batches):
        for batch in slices(batches, "block", 4_000_000):
            out = []
            for r in batch.to_pylist():
                n, body = _decoded(r["kind"], r["block"]) if r["complete"] and r["kind"] != "continuation" else (None, None)
                digest = None if body is None else hashlib.sha256(body).hexdigest()
                out.append((r["origin"].split("#")[0].rsplit(":", 1)[1], r["kind"], r["refers"].rsplit(":", 1)[-1] or None, n, digest, r["complete"], body if payload else None))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["page", "kind", "refers", "n", "digest", "complete", "payload"])

    rows = reassembled(read_records(spark, path)).mapInArrow(decode, "page string, kind string, refers string, n long, digest string, complete boolean, payload binary")
    out = rows.select(
        F.expr("try_cast(page AS long)").alias("page_id"), F.col("kind").alias("record_type"), F.expr("try_cast(refers AS long)").alias("refers_to"),
        F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "complete", "payload",
    )
    return out if payload else out.drop("payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: what its record, written and read again, holds. A revisit's digest is looked up at its response."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return with_digests(materialize(read_warc(spark, path)))


def with_digests(found: DataFrame, hot: int = 16) -> DataFrame:
    """``found`` with the digest of a revisit's response. Every response that is referred to meets its revisits in ``hot`` places."""
    revisits = found.filter("record_type = 'revisit'").drop("payload_digest").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(hot)).cast("int"))
    named = found.filter("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    named = named.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(hot - 1))))
    joined = revisits.join(named, ["refers_to", "payload_bytes", "salt"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return found.filter("record_type != 'revisit'").select(columns).unionByName(joined.select(columns))


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to, true AS complete
FROM f
"""
