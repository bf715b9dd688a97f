"""Ranked lexical search with hashed max-sketches.

A term is a maximal run of letters, digits and characters beyond ASCII, A-Z lower-cased; it travels as a 128-bit hash. The
impact of a term on a document grows with its frequency there and falls with the document's length. Every document folds
the impacts of all its terms into a sketch: each term owns two hashed cells, and a cell keeps the largest impact that fell
on it, rounded up. The smaller of a query term's two cells is never below its impact, so weighted cells add up to an upper
bound of the query's score. A task looks up the cells of all query terms at once for a block of documents and gets
the bounds of all queries by one matrix product.

Documents are then rescored exactly, for each query in descending order of bounds, until the bound falls below the score
of the k-th best document so far. A task thus returns k documents a query at most, and Spark keeps the best k of those.

Collection statistics (documents with a term, their terms, and in how many documents each query term occurs) come from a pass
over all documents before. Queries are a stated set, taken in blocks of at most ``QUERY_ITEMS`` texts and about
``QUERY_BYTES`` bytes, so that what is sent to every task stays bounded; each block is searched in all documents.

Edge cases. Null and empty texts have no term: as documents they are never found, as queries they find nothing. Repeated
documents are ranked each for itself; equal scores go to the smaller identifier, null identifiers last. Every query row is
ranked for itself, also one that repeats another. Empty tables give no rows. Very long texts are hashed piecewise.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from periodica.llm.common import slices, table

BEST = 10
QUERY_ITEMS = 512
QUERY_BYTES = 200_000
#: Cells of a sketch for each distinct term, at least; and the fewest cells of a sketch, as a power of two.
CELLS = 8
LEAST_BITS = 6
#: A cell counts impacts in steps of this size, rounded up, so that it fits 16 bits (impacts stay below 1,000,000).
STEP = 16
#: Bytes of text hashed at once, and cells looked up at once.
SPAN = 1 << 20
LOOKUPS = 2_000_000
#: Numbers of the weighting (fixed values): share of the length, slope of the frequency.
LENGTH_SHARE, SCALE, SATURATION = 75, 1_000_000_000, 8

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32
_NEAR = 64
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    x = (x ^ (x >> np.uint64(32))) * _M3
    return x ^ (x >> np.uint64(30))


_TABLES = [_mixed(np.arange(_NEAR * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(k)) for k in (0, 1)]


def _hash_piece(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two hashes of every term; ``fresh`` marks bytes before which a term must end."""
    inside = _TERM[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | fresh[1:]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    place = at - starts[np.cumsum(begin[at]) - 1]
    code = (np.minimum(place, _NEAR - 1).astype(np.uint64) << np.uint64(8)) | _FOLD[data[at]]
    far = np.flatnonzero(place >= _NEAR)
    first = np.searchsorted(at, starts)
    out = []
    for k, known in enumerate(_TABLES):
        x = known[code]
        if len(far):
            own = (place[far].astype(np.uint64) << np.uint64(8)) | _FOLD[data[at[far]]]
            x[far] = _mixed(own * np.uint64(2) + np.uint64(k))
        out.append(np.add.reduceat(x, first))
    return starts, out[0], out[1]


def hashed_terms(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, second hash) of every term of ``texts``, in order."""
    texts = list(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts, lo = [], 0
    while lo < len(data):
        hi = min(lo + SPAN, len(data))
        if hi < len(data):  # cut after a byte that belongs to no term
            gaps = np.flatnonzero(~_TERM[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                while hi < len(data) and _TERM[data[hi]]:
                    step = np.flatnonzero(~_TERM[data[hi : hi + SPAN]])
                    hi = hi + int(step[0]) if len(step) else min(hi + SPAN, len(data))
        fresh = np.zeros(hi - lo, bool)
        edges = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo
        fresh[edges] = True
        starts, h1, h2 = _hash_piece(data[lo:hi], fresh)
        parts.append((np.searchsorted(bounds, starts + lo, side="right") - 1, h1, h2))
        lo = hi
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


@dataclass
class Queries:
    """One block of queries: its terms in ascending order of their hashes, and for each item its terms with their numbers."""

    ids: list[int | None]
    h1: np.ndarray
    h2: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray | None = None
    documents: int = 0
    terms: int = 0


def query_block(ids: list[int | None], texts: list[bytes]) -> Queries:
    number, h1, h2 = hashed_terms(texts)
    order = np.lexsort((h2, h1))
    h1, h2, number = h1[order], h2[order], number[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    term = np.cumsum(new) - 1
    items = [np.unique(term[number == i], return_counts=True) for i in range(len(texts))]
    return Queries(ids, h1[new], h2[new], items)


def _found(q: Queries, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are query terms (positions), and which terms those are."""
    if not len(q.h1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(q.h1, h1), len(q.h1) - 1)
    hit = np.flatnonzero((q.h1[at] == h1) & (q.h2[at] == h2))
    return hit, at[hit]


def statistics(docs: DataFrame, q: Queries) -> Queries:
    """``q`` with the weights of its terms: from all rows of ``docs`` (text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(q)

    def count(batches):
        q = shipped.value
        held = np.zeros(len(q.h1) + 2, np.int64)  # texts per term, then texts and terms in all
        for batch in slices(batches, "text", SPAN):
            number, h1, h2 = hashed_terms(t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist())
            hit, term = _found(q, h1, h2)
            pairs = np.unique(number[hit] * len(q.h1) + term)
            held[:-2] += np.bincount(pairs % max(1, len(q.h1)), minlength=len(q.h1)) if len(pairs) else 0
            held[-2] += len(np.unique(number))
            held[-1] += len(number)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    sums = np.zeros(len(q.h1) + 2, np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        sums[r["term"]] = r["n"]
    q.documents, q.terms = int(sums[-2]), int(sums[-1])
    q.weights = np.array([math.floor(1000 * math.log((2 * q.documents + 2) / (2 * int(df) + 1))) for df in sums[:-2]], np.int64)
    shipped.unpersist()
    return q


def length_factors(lengths: np.ndarray, q: Queries) -> np.ndarray:
    if LENGTH_SHARE * int(lengths.max(initial=0)) * q.documents < 2**63:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * q.documents // max(1, q.terms)
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * q.documents // q.terms for n in lengths], np.int64)


class Sketches:
    """The max-sketches of a batch of documents, and what is needed to rescore one of them exactly."""

    def __init__(self, texts: list[bytes], q: Queries):
        number, h1, h2 = hashed_terms(texts)
        order = np.lexsort((h1, number))
        number, h1, h2 = number[order], h1[order], h2[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(h1)))
        self.doc, self.h1, self.h2 = number[first], h1[first], h2[first]
        m = length_factors(np.bincount(number, minlength=len(texts)), q)[self.doc]
        self.impact = SCALE * tf // (1000 * tf + SATURATION * m)
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        distinct = np.diff(self.bounds)
        self.bits = np.maximum(LEAST_BITS, np.ceil(np.log2(np.maximum(1, CELLS * distinct))).astype(np.int64))
        size = np.where(distinct > 0, np.int64(1) << self.bits, 0)
        self.base = np.concatenate([[0], np.cumsum(size)])
        shift = (64 - self.bits[self.doc]).astype(np.uint64)
        cell = np.concatenate([self.base[self.doc] + (g >> shift).astype(np.int64) for g in _cells(self.h1, self.h2)])
        value = np.tile(-(-self.impact // STEP), 2).astype(np.uint16)
        rising = np.argsort(value, kind="stable")
        self.cells = np.zeros(int(self.base[-1]), np.uint16)
        self.cells[cell[rising]] = value[rising]  # of several values for a cell the last, largest one stays

    def upper_bounds(self, docs: np.ndarray, places: dict[int, tuple[np.ndarray, np.ndarray]], matrix: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of ``docs`` (rows) for all items (columns)."""
        seen = np.zeros((len(docs), len(matrix)), np.float32)
        for bits in np.unique(self.bits[docs]):
            rows = np.flatnonzero(self.bits[docs] == bits)
            base = self.base[docs[rows]][:, None]
            one, two = places[int(bits)]
            seen[rows] = np.minimum(self.cells[base + one], self.cells[base + two])
        return seen @ matrix

    def contributions(self, doc: int, q: Queries) -> np.ndarray:
        """Weight times impact of every query term on one document."""
        mine = slice(self.bounds[doc], self.bounds[doc + 1])
        hit, term = _found(q, self.h1[mine], self.h2[mine])
        out = np.zeros(len(q.h1), np.int64)
        out[term] = q.weights[term] * self.impact[mine][hit]
        return out


def _cells(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h1 * _M2, h2 * _M3


def _search_task(batches: Iterator[pa.RecordBatch], q: Queries, k: int) -> Iterator[pa.RecordBatch]:
    matrix = np.zeros((len(q.h1), len(q.items)), np.float32)
    for i, (terms, n) in enumerate(q.items):
        matrix[terms, i] = STEP * q.weights[terms] * n
    # rounding of the product, terms added up in any order, is within this factor
    slack = np.float32(1 + 4 * (len(q.h1) + 8) * 2.0**-24)
    places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    best: list[list[tuple]] = [[] for _ in q.items]
    least = np.ones(len(q.items))  # a document must reach this to be of use
    for batch in slices(batches, "text", SPAN):
        ids = batch.column("id").to_pylist()
        sketches = Sketches([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], q)
        for bits in np.unique(sketches.bits):
            if int(bits) not in places:
                places[int(bits)] = tuple((g >> np.uint64(64 - bits)).astype(np.int64) for g in _cells(q.h1, q.h2))
        some = np.flatnonzero(np.diff(sketches.bounds))
        block = max(1, LOOKUPS // max(1, len(q.h1)))
        for lo in range(0, len(some), block):
            docs = some[lo : lo + block]
            bounds = sketches.upper_bounds(docs, places, matrix) * slack
            exact: dict[int, np.ndarray] = {}
            open_items = np.flatnonzero((bounds >= least).any(axis=0))
            for i in open_items.tolist():
                terms, n = q.items[i]
                mine = np.flatnonzero(bounds[:, i] >= least[i])
                for row in mine[np.argsort(-bounds[mine, i], kind="stable")].tolist():
                    if bounds[row, i] < least[i]:
                        break
                    doc = int(docs[row])
                    if doc not in exact:
                        exact[doc] = sketches.contributions(doc, q)
                    score = int((exact[doc][terms] * n).sum())
                    if score > 0:
                        insort(best[i], (-score, ids[doc] is None, ids[doc] or 0))
                        del best[i][k:]
                        if len(best[i]) == k:
                            least[i] = -best[i][-1][0]
    rows = [(i, q.ids[i], None if null else doc, -score) for i, found in enumerate(best) for score, null, doc in found]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) if rows else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "item_id", "doc_id", "score"])


def search_block(docs: DataFrame, q: Queries, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (id, text) for every query of a block."""
    shipped = docs.sparkSession.sparkContext.broadcast(statistics(docs, q))
    found = docs.select("id", "text").mapInArrow(lambda b: _search_task(b, shipped.value, k), "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query_blocks(queries: DataFrame, item: str, text: str) -> Iterator[Queries]:
    """The queries in blocks of bounded size; only one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in queries.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        raw = (r["t"] or "").encode()
        if ids and (len(ids) >= QUERY_ITEMS or size + len(raw) > QUERY_BYTES):
            yield query_block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(raw)
        size += len(raw)
    if ids:
        yield query_block(ids, texts)


def search(docs: DataFrame, queries: DataFrame, k: int = BEST, doc: str = "doc_id", text: str = "text", item: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents for every query row."""
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = None
    for q in query_blocks(queries, item, query_text):
        found = search_block(rows, q, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

RANKED_SQL = f"""
WITH asked AS (SELECT item_id, {_TERMS} AS term FROM benchmark),
words AS (SELECT doc_id, {_TERMS} AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
freq AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM freq, total GROUP BY term, docs),
impacts AS (
  SELECT f.doc_id, f.term, w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * l.n * t.docs) // t.terms))) AS v
  FROM freq f JOIN lengths l USING (doc_id) JOIN weights w USING (term), total t),
scores AS (
  SELECT a.item_id, i.doc_id, CAST(sum(i.v) AS BIGINT) AS score
  FROM (SELECT item_id, term FROM asked) a JOIN impacts i USING (term) GROUP BY a.item_id, i.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
