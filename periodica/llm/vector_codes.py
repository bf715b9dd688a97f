"""Vector code compression: product codes whose distances are gathered from per-dimension value dictionaries.

Every component becomes the integer floor(256 x); vectors are cut into ``PARTS`` equal parts, each coded by the nearest
of at most ``ENTRIES`` codebook entries. A batch of vectors is coded through dictionaries: for each dimension the distinct
integers of the batch, and a table of the squared differences of each of them to that dimension of all entries. The
distance of a part to every entry is then a sum of table rows picked by dictionary codes; no vector is subtracted from an
entry. Distances are whole numbers, so ties are real ties and go to the lower entry.

Codebooks start as the parts of the vectors with the smallest identifiers and are refined by ``ROUNDS`` rounds: a task
adds up the parts of each entry, Spark adds up what the tasks found, and only the codebooks (``PARTS`` x ``ENTRIES`` short
rows, whatever the table) pass through the driver.

Edge cases. Vectors that are null or hold null or non-finite components are left out; null identifiers count as the
largest, repeated identifiers (or rows) are ordered by their components and all get a code. With fewer vectors than
entries the codebooks are shorter; an empty table gives no rows. All kept vectors must have the same number of
components, a multiple of ``PARTS``, and integers whose squared distances fit a long; otherwise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.llm.common import fresh, table
from periodica.session import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Vectors coded at once in a task: bounds its tables and distances.
ROWS = 4096
#: Ways in which the vectors of one label are spread when they meet its total.
LABEL_SALTS = 16


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The components of one batch of kept vectors as integers, one row per vector."""
    if len(column) == 0:
        return np.zeros((0, width), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {int(lengths[lengths != width][0])} components")
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() * 2 * np.sqrt(max(width, 1)) >= 2.0**31:
        raise ValueError("components too large for squared distances in a long")
    return values.astype(np.int64).reshape(-1, width)


def dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of one dimension and, for each row, the number of its own among them."""
    low, high = int(values.min()), int(values.max())
    if high - low >= 4 * len(values):
        return np.unique(values, return_inverse=True)
    offsets = values - low
    present = np.zeros(high - low + 1, bool)
    present[offsets] = True
    number = np.cumsum(present) - 1
    return np.flatnonzero(present) + low, number[offsets]


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part of every vector; ``books`` is (parts, entries, components)."""
    parts, entries, width = books.shape
    codes = np.zeros((len(vectors), parts), np.int64)
    errors = np.zeros((len(vectors), parts), np.int64)
    if not len(vectors) or not width:
        return codes, errors
    widest = max(int(np.abs(vectors).max()), int(np.abs(books).max()))
    kind = np.int32 if 4 * widest * widest * width < 2**31 else np.int64
    rows = np.arange(len(vectors))
    for p in range(parts):
        total = np.zeros((len(vectors), entries), kind)
        for j in range(width):
            values, mine = dictionary(vectors[:, p * width + j])
            difference = values[:, None] - books[p, None, :, j]
            total += (difference * difference).astype(kind)[mine]
        best = total.argmin(axis=1)  # the first of equal distances
        codes[:, p], errors[:, p] = best, total[rows, best]
    return codes, errors


def batches_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, integers(part.column("vector"), width)


def first_books(kept: DataFrame) -> np.ndarray:
    """Codebooks made of the parts of the vectors with the smallest identifiers."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()
    vectors = rows.column("vector").combine_chunks()
    if len(vectors) == 0:
        return np.zeros((PARTS, 0, 0), np.int64)
    width = len(vectors[0])
    if width % PARTS:
        raise ValueError(f"{width} components do not make {PARTS} equal parts")
    return integers(vectors, width).reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2).copy()


def refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floors of the means of the parts nearest to them; unused entries stay."""
    parts, entries, width = books.shape
    shipped = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        books = shipped.value
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, vectors in batches_of(batches, parts * width):
            codes, _ = nearest(vectors, books)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                for j in range(width):  # at most ROWS values below 2^30: exact in a double
                    sums[p, :, j] += np.bincount(codes[:, p], vectors[:, p * width + j], entries).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    found = kept.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))
    out = books.copy()
    for r in totals.collect():  # one row per entry in use
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    shipped.unpersist()
    return out


def fit_books(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(kept)
    for _ in range(rounds if books.size else 0):
        books = refined(kept, books)
    return books


def kept_vectors(vectors: DataFrame, vector: str, identifier: str) -> DataFrame:
    """``vectors`` without unusable rows, with ``id`` and ``vector`` for the passes over them."""
    wide = F.col(vector).cast("array<double>")
    return vectors.filter(usable(wide)).select(F.col(identifier).alias("id"), wide.alias("vector"))


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", out: str = "coded") -> DataFrame:
    """The usable rows of ``vectors``, all their columns and a struct column ``out`` (code array<int>, error long)."""
    shipped = vectors.sparkSession.sparkContext.broadcast(books)
    kind = "code array<int>, error long"

    @F.arrow_udf(kind)
    def code(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        books = shipped.value
        for column in columns:
            codes, errors = [], []
            for _, part in batches_of([pa.RecordBatch.from_arrays([column], ["vector"])], books.shape[0] * books.shape[2]):
                found, distance = nearest(part, books)
                codes.append(found.astype(np.int32))
                errors.append(distance.sum(axis=1))
            flat = np.concatenate(codes) if codes else np.zeros((0, books.shape[0]), np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * books.shape[0]), pa.array(flat.reshape(-1)))
            yield pa.StructArray.from_arrays([listed, pa.array(np.concatenate(errors) if errors else np.zeros(0, np.int64))], ["code", "error"])

    wide = F.col(vector).cast("array<double>")
    return vectors.filter(usable(wide)).withColumn(out, code(wide))


def with_group_total(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``group`` (nulls are one group). ``rows`` is read twice.

    Sums are made before the shuffle; the rows of a group meet copies of its one total in ``LABEL_SALTS`` places.
    """
    key, salt = fresh(rows, "_group"), fresh(rows, "_salt")
    totals = rows.groupBy(F.col(group).alias(key)).agg(F.sum(value).alias(out))
    copies = totals.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != group]), F.lit(LABEL_SALTS)).cast("int"))
    met = dealt.join(copies, [dealt[salt] == copies[salt], dealt[group].eqNullSafe(copies[key])])
    return met.select(*[dealt[f"`{c}`"] for c in rows.columns], copies[out])


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    books = fit_books(kept_vectors(rows, "embedding", "vec_id"))
    coded = encode(rows.select("vec_id", "label", "embedding"), books)
    hexed = F.concat_ws("", F.transform("coded.code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    coded = materialize(coded.select("vec_id", "label", hexed.alias("code"), F.col("coded.error").alias("error")))
    out = with_group_total(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    distance = "list_sum(list_transform(list_zip(q.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d
      FROM (SELECT q.r, q.p, b.e, {distance} AS d FROM pieces q JOIN {book} b ON q.p = b.p) GROUP BY r, p"""


def _next(book: str, assigned: str) -> str:
    mean = """SELECT p, e, list(m ORDER BY j) AS s FROM (
        SELECT a.p, a.e, j, CAST(floor(sum(q.s[j]) / count(*)) AS BIGINT) AS m
        FROM {0} a JOIN pieces q ON a.r = q.r AND a.p = q.p, (SELECT unnest(generate_series(1, (SELECT max(len(s)) FROM pieces))) AS j)
        GROUP BY a.p, a.e, j) GROUP BY p, e""".format(assigned)
    return f"SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM {book} b LEFT JOIN ({mean}) m ON b.p = m.p AND b.e = m.e"


VECTOR_CODES_SQL = f"""
WITH kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
pieces AS (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS s
  FROM kept, (SELECT unnest(generate_series(0, {PARTS - 1})) AS p)),
book0 AS (SELECT p, r - 1 AS e, s FROM pieces WHERE r <= {ENTRIES}),
near0 AS ({_assigned("book0")}),
book1 AS ({_next("book0", "near0")}),
near1 AS ({_assigned("book1")}),
book2 AS ({_next("book1", "near1")}),
near2 AS ({_assigned("book2")}),
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, digest.codebooks_sha256
FROM kept k JOIN coded c USING (r), digest
"""
