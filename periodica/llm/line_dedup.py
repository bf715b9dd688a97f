"""Lines that many documents share are dropped from every document.

Every line becomes a key: white space ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased. A key is
stored as its 128-bit XXH3 hash, so the table of keys has a fixed width however long a line is. Spark counts in
how many documents each hash occurs; hashes are counted once per document and added up per Arrow batch before
the shuffle, so a line that a third of all documents hold costs one row per batch. Text is not shuffled while the
shared keys can be sent to every executor; with more of them, rows are put together again by a join on their number.

Each row of the input is a document, also one that repeats another row. A null text has one empty line and stays
null; an empty text has one empty line. The empty key is below ``min_chars`` and is never dropped. A document
that loses all its lines becomes the empty text. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm.common import fresh, plus_longs, slices, table, utf8, without
from periodica.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1
#: Most shared keys that are sent to every executor (16 bytes each); beyond it, lines are joined with the keys.
BROADCAST_KEYS = 2_000_000


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: exactly the six white-space characters, and A-Z


def _key_hashes(lines: list[bytes], min_chars: int) -> list[bytes]:
    """The 16-byte hash of each line's key; ``b""`` where the key is too short to count."""
    digest = xxhash.xxh3_128_digest
    keys = [line.strip().lower() for line in lines]
    if min_chars <= 1:
        return [digest(k) if len(k) >= min_chars else b"" for k in keys]
    return [digest(k) if len(k.decode()) >= min_chars else b"" for k in keys]


def _pairs(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_document_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n): how many documents hold each line key."""

    def count(batches):
        for batch in slices(batches, "text"):
            seen: Counter[bytes] = Counter()
            for t in utf8(batch.column("text")):
                seen.update(set(_key_hashes(t.split(b"\n"), min_chars)))
            seen.pop(b"", None)
            h1, h2 = _pairs(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "h1 long, h2 long, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


class _Keys:
    """Sorted 128-bit hashes; membership of many at once."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        self.twins = int(np.unique(self.h1, return_counts=True)[1].max(initial=0))

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        at = np.searchsorted(self.h1, h1)
        for k in range(self.twins):
            i = np.minimum(at + k, len(self.h1) - 1)
            found |= (self.h1[i] == h1) & (self.h2[i] == h2)
        return found


def _drop(lines: list[bytes], gone: np.ndarray) -> bytes:
    return b"\n".join([line for line, x in zip(lines, gone, strict=True) if not x])


def _set(batch: pa.RecordBatch, text: str, kept: list[bytes | None], n_lines: list[int], n_dropped: list[int], helper: str = "") -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names if n != helper}
    columns[text] = pa.array(kept, pa.binary()).cast(batch.schema.field(text).type)
    columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def dedup_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """``docs`` with ``text`` rid of shared lines, plus ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    counts = line_document_counts(docs, text, min_chars)
    shared = materialize(counts.filter(F.col("n") >= min_docs).select("h1", "h2"))
    schema = plus_longs(docs, "n_lines", "n_dropped")
    if shared.count() > broadcast_keys:
        return _drop_joined(docs, shared, text, min_chars, schema)
    found = shared.toArrow()
    keys = spark.sparkContext.broadcast(_Keys(found.column("h1").to_numpy(), found.column("h2").to_numpy()))

    def drop(batches):
        for batch in slices(batches, text):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            split = [(t or b"").split(b"\n") for t in texts]
            hashes = [h for lines in split for h in _key_hashes(lines, min_chars)]
            counted = np.array([len(h) > 0 for h in hashes], bool)
            gone = np.zeros(len(hashes), bool)
            gone[counted] = keys.value.holds(*_pairs(hashes))
            kept, dropped, at = [], [], 0
            for t, lines in zip(texts, split, strict=True):
                own = gone[at : at + len(lines)]
                at += len(lines)
                n = int(own.sum())
                dropped.append(n)
                kept.append(_drop(lines, own) if n else t)
            yield _set(batch, text, kept, [len(x) for x in split], dropped)

    return docs.mapInArrow(drop, schema)


def _drop_joined(docs: DataFrame, shared: DataFrame, text: str, min_chars: int, schema) -> DataFrame:
    """The same when the shared keys are too many to send: lines meet them in a join, rows are put together by id."""
    row, helper = fresh(docs, "line_row"), fresh(docs, "lines_gone")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))

    def explode(batches):
        for batch in slices(batches, "text"):
            ids, at, hashes = [], [], []
            for number, t in zip(batch.column("line_row").to_pylist(), utf8(batch.column("text")), strict=True):
                for i, h in enumerate(_key_hashes(t.split(b"\n"), min_chars)):
                    if h:
                        ids.append(number)
                        at.append(i)
                        hashes.append(h)
            h1, h2 = _pairs(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(h1), pa.array(h2)], ["line_row", "at", "h1", "h2"])

    lines = rows.select(F.col(row).alias("line_row"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(explode, "line_row long, at long, h1 long, h2 long")
    gone = lines.join(shared, ["h1", "h2"], "left_semi").groupBy(F.col("line_row").alias(row)).agg(F.collect_list("at").alias(helper))

    def drop(batches):
        for batch in slices(batches, text):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            kept, sizes, dropped = [], [], []
            for t, at in zip(texts, batch.column(helper).to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                own = np.zeros(len(lines), bool)
                own[at or []] = True
                kept.append(_drop(lines, own) if at else t)
                sizes.append(len(lines))
                dropped.append(len(at or []))
            yield _set(batch, text, kept, sizes, dropped, helper)

    return rows.join(gone, row, "left").drop(row).mapInArrow(drop, schema)


def without_shared_lines(docs: DataFrame, n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with all its columns as they came but the text rid of shared lines, and the text's length in ``n_chars`` if there."""
    kept = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    out = dedup_lines(docs.withColumnsRenamed(kept), **options).drop("n_lines", "n_dropped")
    out = out.withColumnsRenamed({new: c for c, new in kept.items()})
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(options.get("text", "text")).cast(docs.schema[n_chars].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines dropped and the SHA-256 of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


LINE_DEDUP_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs
),
keyed AS (
  SELECT r, i, line, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
shared AS (SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}),
marked AS (SELECT r, i, line, k IN (SELECT k FROM shared) AS gone FROM keyed)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM docs d JOIN marked m USING (r) GROUP BY r, d.doc_id
"""
