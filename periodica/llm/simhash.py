"""Near-duplicates by SimHash, found with pivot distance tables.

Fingerprint: A-Z of the whole text lower-cased, words ``[^\\x20\\x09-\\x0D]+``, word shingles joined by a space, each
hashed with XXH64; a bit is 1 if it is set in over half of the hashes. A text without words has fingerprint zero.

Search: fingerprints are first made distinct, so copies are one row however many there are. Each has a row in the pivot
table: its Hamming distances to a fixed set of reference fingerprints. Distance is a metric, so two fingerprints within
``max_bits`` differ by no more than that in any coordinate; pairs that differ by more in one coordinate are discarded,
and what survives is verified on the fingerprints themselves. Coordinates of 64-bit fingerprints all lie near 32, so
they prune pairs well but cannot deal rows out to tasks: over half of all pairs pass a single coordinate. Rows are
therefore dealt out by pigeonhole: of six bit blocks at least ``6 - max_bits`` are equal in a linked pair, so every
linked pair shares the key of some choice of that many blocks. Inside a key, rows are sorted by their first coordinate
and compared only while it differs by at most ``max_bits``. A key emits at most one edge per row (each row to the
smallest fingerprint it is connected with inside the key), never all pairs of a group. A key with more rows than
``group_rows`` is split into chunks that meet two at a time in separate tasks.

Documents that share a component are near-duplicates; component_id is the smallest doc_id in it. A null text counts as
empty. A null doc_id takes part but is never the smallest, unless all of the component are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.llm.common import fresh, plus_longs, slices, table, utf8
from periodica.llm.components import connected_components
from periodica.session import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
N_BLOCKS = 6
N_PIVOTS = 12
#: Rows of one key that one task compares at a time.
GROUP_ROWS = 4096


def _bits_over_half(hashes: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts`` (64) how many of the hashes have each bit set, lowest bit first."""
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one UTF-8 text. bytes.lower and bytes.split know exactly A-Z and the six white-space characters."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle_words + 1)
    hash64, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    for at in range(0, n, 100_000):
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(first[at : at + 100_000], last[at : at + 100_000], strict=True)]
        _bits_over_half(np.array(hashes, np.uint64), counts)
        total += len(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a long that holds its 64 bits. ``carry`` names columns to keep."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.col(text).cast("string").alias("text"))
    kept = ["doc_id", *carry]

    def compute(batches):
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle_words) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(fps)], [*kept, "fp"])

    return rows.mapInArrow(compute, plus_longs(rows.drop("text"), "fp"))


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: XXH64 of their numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], np.uint64)


def _block_keys(fp: Column, max_bits: int, n_blocks: int) -> Column:
    """One key for each choice of ``n_blocks - max_bits`` blocks: the bits of those blocks and the choice."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n_blocks)]
    keys = []
    for number, chosen in enumerate(combinations(masks, n_blocks - max_bits)):
        mask = sum(chosen)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(number)))
    return F.array(*keys)


def _forest(key: np.ndarray, fp: np.ndarray, coordinates: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row's fingerprint, smallest one it is linked with) inside equal keys; rows sorted by key, coordinate 0."""
    n = len(fp)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = coordinates[:, 0].astype(np.int16)
    live, step = np.arange(n), 1
    while len(live):
        live = live[live + step < n]
        other = live + step
        near = (key[live] == key[other]) & (order[other] - order[live] <= max_bits)
        live = live[near]
        other = live + step
        a, b = live, other
        for k in range(1, coordinates.shape[1]):
            if not len(a):
                break
            ok = np.abs(coordinates[a, k].astype(np.int16) - coordinates[b, k]) <= max_bits
            a, b = a[ok], b[ok]
        if len(a):
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            a, b = a[ok], b[ok]
        if len(a):
            apart = parent[a] != parent[b]
            for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    lo, hi = (x, y) if fp[x] < fp[y] else (y, x)
                    parent[hi] = lo
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up
        step += 1
    child = np.flatnonzero(parent != np.arange(n))
    return fp[child], fp[parent[child]]


def linked(distinct: DataFrame, max_bits: int = MAX_BITS, n_blocks: int = N_BLOCKS, n_pivots: int = N_PIVOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints reachable through links of at most ``max_bits``.

    ``distinct`` is a written table of distinct fingerprints ``fp``.
    """
    n_blocks = max(n_blocks, max_bits + 1)
    rows = distinct.select("fp", F.explode(_block_keys(F.col("fp"), max_bits, n_blocks)).alias("key"))
    # a key that many rows share is split into chunks; every two chunks meet under a key of their own
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = rows.join(counts, "key")
    k = F.ceil(F.col("n") / group_rows).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), k.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), k - 1))
    small = rows.filter(F.col("n") <= group_rows).select("key", "fp")
    large = rows.filter(F.col("n") > group_rows).select("key", "fp", chunk.alias("c"), other.alias("o"))
    large = large.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "fp")
    references = pivots(n_pivots)

    def compare(batches):
        held: list[np.ndarray] = []  # of the key that the last batch ended in
        def edges(key, fp):
            u = fp.view(np.uint64)
            coordinates = np.bitwise_count(u[:, None] ^ references)
            order = np.lexsort((coordinates[:, 0], key))
            a, b = _forest(key[order], u[order], coordinates[order], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            whole = np.searchsorted(key, key[-1]) if len(key) else 0  # rows of the last key may go on
            if whole:
                yield edges(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield edges(key, fp)

    dealt = small.unionByName(large).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "a long, b long")


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
    group_rows: int = GROUP_ROWS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; root numbers the component and is never null."""
    rows = materialize(fingerprints(docs, doc_id, text, shingle_words, carry))
    return components_of(rows, max_bits, group_rows)


def components_of(rows: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` (doc_id, fp, any more; a written table) with ``root`` and ``component_id``."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(linked(distinct, max_bits, group_rows=group_rows)).withColumnRenamed("v", "fp")
    classed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(classed.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that with the smallest doc_id.

    A row without a doc_id stays only if its component has no other; rows that repeat doc_id and text count as one.
    All columns are returned as they came.
    """
    key = fresh(docs, "row_key")
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit(""))]
    keyed = docs.withColumn(key, F.md5(F.concat(*parts)))
    named = keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(key).alias("row_key"))
    classed = simhash_components(named, carry=("row_key",), **options)
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    kept = materialize(first.select(F.col("first.row_key").alias(key)))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
