"""Approximate nearest neighbours: low-dimensional stable projections, kd-trees, and a chi-square stopping test.

Largest inner product becomes smallest distance by one more component: a vector x gets sqrt(M^2 - |x|^2), M being the
largest norm, and a query gets 0. Vectors are projected on ``DIMENSIONS`` Gaussian directions. Gaussians are 2-stable, so
the squared projected distance divided by the squared distance follows a chi-square law with that many degrees of
freedom. A query meets the points in the order of their projected distance and verifies each in full; with the kth best
verified distance d it stops as soon as the next projected distance p has chi2(p^2 / d^2) >= ``CONFIDENCE``: any
unseen point nearer than d would lie closer in the projection with that probability.

Spark deals rows out by a kd-tree over the projected space, fitted on at most ``SAMPLE_ROWS`` rows; every row is indexed
in its cell, and a cell with more than ``BLOCK_ROWS`` rows is split by a hash, so copies never make one task. A query
first searches one block of its own cell, which bounds its kth distance; it is then sent only to those blocks whose
cell is not yet ruled out by the stopping test, at most ``QUERY_ROWS`` queries meeting a block in one task. In a
block a kd-tree of leaves is visited in the order of projected distance, for all queries of the task at once. The answer
is the best k of what the blocks found.

Vectors null, zero, or with null or non-finite components take no part, nor do vectors of another length than
the most frequent one, nor rows without an id. Ties go to the smaller id. Repeated rows are candidates each, but for those
with the query's own id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from periodica.llm.common import table
from periodica.session import materialize

K = 20
DIMENSIONS = 8
CONFIDENCE = 0.96
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 128
SEED = 11


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dof // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


@lru_cache
def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def directions(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Gaussian directions for vectors of ``width`` components and the added one."""
    return np.random.default_rng(SEED).standard_normal((width + 1, dimensions))


def usable(rows: DataFrame) -> DataFrame:
    """(id, v, norm) of the vectors that take part, as doubles."""
    v = F.transform("v", lambda x: x.cast("double"))
    out = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    out = out.filter(finite).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return out.filter(F.col("norm") > 0)


class Cells:
    """A kd-tree over the projected space as a list of boxes; splits at medians of a sample."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; leaves are ~number
        self.boxes: list[np.ndarray] = []
        width = sample.shape[1]
        self.root = self._split(sample, n_cells, np.array([[-np.inf] * width, [np.inf] * width]))

    def _split(self, points: np.ndarray, n: int, box: np.ndarray) -> int:
        if n > 1 and len(points) > 1:
            d = int(points.var(axis=0).argmax())
            value = float(np.median(points[:, d]))
            left = points[:, d] < value
            if left.any() and not left.all():
                low, high = box.copy(), box.copy()
                low[1, d] = high[0, d] = value
                number = len(self.splits)
                self.splits.append((d, value, 0, 0))
                a, b = self._split(points[left], n - n // 2, low), self._split(points[~left], n // 2, high)
                self.splits[number] = (d, value, a, b)
                return number
        self.boxes.append(box)
        return ~(len(self.boxes) - 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = ~node
                continue
            d, value, a, b = self.splits[node]
            left = points[who, d] < value
            todo += [(a, who[left]), (b, who[~left])]
        return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point (rows) to every box (columns)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


def search_block(ids, vectors, projected, norm2, q_ids, q_vectors, q_projected, q_kth, k: int, confidence: float):
    """(query, candidate, score): the k best of one block for each query, ended by the stopping test.

    ``q_kth`` is what is known of each query's kth squared distance so far, infinite at first. ``norm2`` is M^2.
    """
    tree = Cells(projected, max(1, len(ids) // LEAF_ROWS))
    cell = tree.of(projected)
    order = np.argsort(cell, kind="stable")
    edges = np.searchsorted(cell[order], np.arange(len(tree.boxes) + 1))
    filled = [i for i in range(len(tree.boxes)) if edges[i] < edges[i + 1]]
    members = [order[edges[i] : edges[i + 1]] for i in filled]
    low = np.array([projected[m].min(axis=0) for m in members])
    high = np.array([projected[m].max(axis=0) for m in members])
    distance = box_distances(q_projected, low, high)
    visits = distance.argsort(axis=1, kind="stable")
    limit = chi2_quantile(confidence, projected.shape[1])
    nq = len(q_ids)
    best_score = np.full((nq, k), -np.inf)
    best_id = np.full((nq, k), np.iinfo(np.int64).max)
    q2 = (q_vectors**2).sum(axis=1)
    live = np.arange(nq)
    for step in range(len(members)):
        leaf = visits[live, step]
        kth = np.minimum(q_kth[live], q2[live] + norm2 - 2 * best_score[live, -1])
        go = distance[live, leaf] < limit * np.maximum(kth, 0)
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        for one in np.unique(leaf):
            who, rows = live[leaf == one], members[one]
            score = np.einsum("qd,rd->qr", q_vectors[who], vectors[rows])
            score[q_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            all_score = np.concatenate([best_score[who], score], axis=1)
            all_id = np.concatenate([best_id[who], np.broadcast_to(ids[rows], score.shape)], axis=1)
            top = np.lexsort((all_id, -all_score), axis=1)[:, :k]
            best_score[who], best_id[who] = np.take_along_axis(all_score, top, 1), np.take_along_axis(all_id, top, 1)
    found = best_score > -np.inf
    return np.repeat(q_ids, k).reshape(nq, k)[found], best_id[found], best_score[found]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tasks(rows: DataFrame, width: int, norm2: float, k: int, confidence: float) -> DataFrame:
    """(query_id, id, score) of ``rows`` (block, part, asks, id, v, p, kth): the index rows of a task come before its queries."""

    def search(batches):
        def answer(table_):
            asks = table_.column("asks").to_numpy().astype(bool)
            ids, kth = table_.column("id").to_numpy(), table_.column("kth").to_numpy()
            v = _matrix(table_.column("v").combine_chunks(), width)
            p = _matrix(table_.column("p").combine_chunks(), DIMENSIONS)
            if asks.all() or not asks.any():
                return None
            found = search_block(ids[~asks], v[~asks], p[~asks], norm2, ids[asks], v[asks], p[asks], kth[asks], k, confidence)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("task").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                if held and held[0].column("task")[0].as_py() != key[a]:
                    if (out := answer(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := answer(pa.Table.from_batches(held))) is not None:
            yield out

    dealt = rows.withColumn("task", F.xxhash64("block", "part")).repartition("task").sortWithinPartitions("task", "asks")
    return dealt.select("task", F.col("asks").cast("int").alias("asks"), "id", "v", "p", "kth").mapInArrow(search, "query_id long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products found among ``rows`` (id, v) for ``queries`` (id, v)."""
    spark = rows.sparkSession
    held = materialize(usable(rows))
    widths = held.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max("norm").alias("m")).orderBy(F.desc("n"), "w").head(1)
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    width, n, norm = widths[0]
    norm2, axes = norm * norm, directions(width)
    held = held.filter(F.size("v") == width)

    def projected(v, squares, query):
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(norm2 - squares, 0))
        return v @ axes[:-1] + last[:, None] * axes[-1]

    share = min(1.0, SAMPLE_ROWS / n)
    sample = held.filter(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1_000_000)) < int(share * 1_000_000)).select("v", "norm").limit(2 * SAMPLE_ROWS).toArrow()
    v = _matrix(sample.column("v").combine_chunks(), width)
    cells = Cells(projected(v, sample.column("norm").to_numpy() ** 2, False), max(1, math.ceil(n / (block_rows / 2))))
    shipped = spark.sparkContext.broadcast(cells)

    def place(query):
        def run(batches):
            for batch in batches:
                own = _matrix(batch.column("v"), width)
                p = projected(own, batch.column("norm").to_numpy() ** 2, query)
                cell = shipped.value.of(p)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(p), pa.list_(pa.float64())), pa.array(cell)], ["id", "v", "p", "cell"])

        return run

    schema = "id long, v array<double>, p array<double>, cell long"
    index = materialize(held.select("id", "v", "norm").mapInArrow(place(False), schema))
    # blocks of a cell: one for about every block_rows rows
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    sizes = materialize(sizes)
    blocks = F.struct("cell", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).alias("b"))
    index = materialize(index.join(sizes, "cell").select("id", "v", "p", blocks.alias("block")))
    asked = usable(queries).filter(F.size("v") == width).dropDuplicates(["id"]).select("id", "v", "norm").mapInArrow(place(True), schema)
    asked = materialize(asked)

    def run(sent):
        """``sent``: queries with the block and the kth distance known."""
        parts = materialize(sent.groupBy("block").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("parts")))
        part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))
        ask = sent.join(parts, "block").select("block", part.alias("part"), F.lit(True).alias("asks"), "id", "v", "p", "kth")
        many = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        have = index.join(parts, "block").select("block", many.alias("part"), F.lit(False).alias("asks"), "id", "v", "p", F.lit(0.0).alias("kth"))
        return _tasks(have.unionByName(ask), width, norm2, k, confidence)

    # a query's own cell may hold no row; any block of the nearest cell that does then bounds its kth distance
    filled = [r[0] for r in sizes.select("cell").collect()]  # at most as many as the sample has rows
    low, high = (np.array([cells.boxes[c][i] for c in filled]) for i in (0, 1))
    counts = {r[0]: r[1] for r in sizes.collect()}
    held_blocks = spark.sparkContext.broadcast((np.array(filled), low, high, np.array([counts[c] for c in filled])))
    limit = chi2_quantile(confidence, DIMENSIONS)

    def route(first):
        def go(batches):
            names, lows, highs, many = held_blocks.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    own = batch.slice(start, 512)
                    distance = box_distances(_matrix(own.column("p"), DIMENSIONS), lows, highs)
                    kth = own.column("kth").to_numpy()
                    if first:
                        pick = np.zeros_like(distance, bool)
                        pick[np.arange(len(kth)), distance.argmin(axis=1)] = True
                    else:
                        pick = distance < limit * np.maximum(kth, 0)[:, None]
                    q, c = np.nonzero(pick)
                    times = np.ones(len(c), np.int64) if first else many[c]
                    q, c = np.repeat(q, times), np.repeat(c, times)
                    b = np.arange(len(c)) - np.repeat(np.cumsum(times) - times, times)
                    out = own.take(pa.array(q))
                    block = pa.StructArray.from_arrays([pa.array(names[c]), pa.array(b)], ["cell", "b"])
                    yield pa.RecordBatch.from_arrays([*[out.column(x) for x in ("id", "v", "p", "kth")], block], ["id", "v", "p", "kth", "block"])

        return go

    routed = "id long, v array<double>, p array<double>, kth double, block struct<cell: long, b: long>"
    sent = materialize(asked.select("id", "v", "p", F.lit(float("inf")).alias("kth")).mapInArrow(route(True), routed))
    start = materialize(run(sent))
    worst = _best(start, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("low"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kth = F.coalesce(squares + norm2 - 2 * F.col("low"), F.lit(float("inf")))
    known = asked.join(worst, "id", "left").select("id", "v", "p", kth.alias("kth"))
    onward = known.mapInArrow(route(False), routed)
    onward = materialize(onward.join(sent.select("id", "block"), ["id", "block"], "left_anti"))
    return _best(start.unionByName(run(onward)), k).select("query_id", "rank", "id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = nearest(rows, rows.filter(F.col("id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
