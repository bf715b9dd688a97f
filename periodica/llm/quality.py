"""Quality classifier: naive Bayes support vectors over n-grams of whole texts.

A text becomes indicators of hashed n-grams: all byte 1- to 4-grams of its UTF-8 form, and the repetition patterns of four
consecutive words (which of them are equal to which). Spark counts, over every labelled training text, in how many texts
of each class a bucket occurs; the smoothed log-ratio of these counts scales the indicators. A linear hinge-loss model over
the scaled, unit-length vectors is then fitted by dual coordinate descent.

Counts cover all labelled training rows. The descent sees a bounded sample of them: about ``FIT_ROWS`` rows, half from each
class, drawn by a hash of the row's identifier, never more than twice as many and never more than ``FIT_GRAMS`` indicators.
Margins become scores by a logistic curve, fitted on margins of rows that the descent had not seen (``FOLDS`` folds of the
sample), weighted back to the true share of the classes, so that 0.5 is the point where both are equally likely.

Edge cases. A null or empty text has no indicator; its score follows from the intercept. Labels other than 0 and 1 are
ignored, and so are rows without a text label. Where a document has several labels the more frequent one counts, a tie
is no label. With one class in training every score is 1 (or 0), with none 0.5. Empty tables give no rows. Other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.llm.common import slices, table

BITS = 18
BUCKETS = 1 << BITS
LONGEST = 4
FIT_ROWS = 8000
FIT_GRAMS = 40_000_000
FOLDS = 3
COST = 1.0
EPOCHS = 10
#: Bytes of a text turned into n-grams at once.
SPAN = 1 << 20
#: Buckets of a row of partial counts, and ways in which equal rows of many tasks are first added up.
BLOCK = 2048
SALTS = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
TEXT_BATCH = 4_000_000

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def _buckets(x: np.ndarray, kind: int) -> np.ndarray:
    return (((x + np.uint64(kind << 40)) * MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word: its bytes times powers of an odd number, added up from prefix sums."""
    word = _WORD[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    # position inside the word, folded, so that no table of powers grows with a word
    inside = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    spread = (data.astype(np.uint64) + np.uint64(1)) * ((inside.astype(np.uint64) + np.uint64(1)) * MIX)
    spread ^= spread >> np.uint64(29)
    total = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
    return total[ends] - total[starts]


def _repetition(words: np.ndarray) -> np.ndarray:
    """Pattern of equal words in every four consecutive ones."""
    if len(words) < 4:
        return np.zeros(0, np.uint64)
    a, b, c, d = words[:-3], words[1:-2], words[2:-1], words[3:]
    out = np.zeros(len(a), np.uint64)
    for i, same in enumerate((a == b, b == c, c == d, a == c, b == d, a == d)):
        out |= same.astype(np.uint64) << np.uint64(i)
    return out


def grams(text: bytes, last: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of one text. ``last`` is scratch space of ``BUCKETS`` integers that may be used again."""
    data = np.frombuffer(text, np.uint8)
    if last is None:
        last = np.empty(BUCKETS, np.int32)
    kept = np.zeros(0, np.int32)
    for at in range(0, len(data), SPAN):
        span = data[at : at + SPAN + LONGEST - 1]
        wide = span.astype(np.uint64)
        parts, x = [kept, _buckets(wide, 1)], wide
        for n in range(2, LONGEST + 1):
            x = (x[:-1] << np.uint64(8)) | wide[n - 1 :]
            parts.append(_buckets(x, n))
        parts.append(_buckets(_repetition(_word_hashes(span)), LONGEST + 1))
        found = np.concatenate(parts)
        place = np.arange(len(found), dtype=np.int32)
        last[found] = place  # the last place of every bucket stays: one place a bucket
        kept = found[last[found] == place]
    return kept


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, log-ratios included
    ratios: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        last = np.empty(BUCKETS, np.int32)
        pairs = np.column_stack([self.weights, self.ratios * self.ratios])
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            dot, norm = pairs[grams(text, last)].sum(axis=0)
            out[i] = self.intercept + (dot / np.sqrt(norm) if norm > 0 else 0.0)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(self.slope * self.margins(texts) + self.shift)))


def constant_model(score: float) -> Model:
    """Every text gets ``score``."""
    none = np.zeros(BUCKETS, np.float32)
    shift = np.inf if score == 1.0 else -np.inf if score == 0.0 else float(np.log(score / (1.0 - score)))
    return Model(none, none, 0.0, 0.0, shift)


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of label 0 and 1 of ``train`` (text, label) each bucket occurs, and how many texts there are."""

    def count(batches):
        counts, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        last = np.empty(BUCKETS, np.int32)
        for batch in slices(batches, "text", TEXT_BATCH):
            for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label, grams(text or b"", last)] += 1
                rows[label] += 1
        if rows.any():
            yield from blocks(counts, rows)

    def blocks(counts, rows):
        by_block = counts.reshape(2, -1, BLOCK)
        hit = np.flatnonzero(by_block.any(axis=(0, 2)))
        lists = [pa.array(list(by_block[label, hit]), pa.list_(pa.int64())) for label in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), *lists], ["block", "zero", "one"])
        tail = np.zeros((2, BLOCK), np.int64)  # the numbers of rows, as one more block
        tail[:, 0] = rows
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([t], pa.list_(pa.int64())) for t in tail]], ["block", "zero", "one"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            pairs = np.stack([batch.column(c).flatten().to_numpy().reshape(-1, BLOCK) for c in ("zero", "one")], axis=1)
            for block, pair in zip(batch.column("block").to_pylist(), pairs, strict=True):
                held[block] = held[block] + pair if block in held else pair.copy()
        if held:
            keys = list(held)
            lists = [pa.array([held[k][label] for k in keys], pa.list_(pa.int64())) for label in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *lists], ["block", "zero", "one"])

    kind = "block int, zero array<long>, one array<long>"
    partial = train.mapInArrow(count, kind).withColumn("salt", F.spark_partition_id() % SALTS)
    partial = partial.repartition("block", "salt").select("block", "zero", "one").mapInArrow(add, kind)
    counts, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in partial.repartition("block").mapInArrow(add, kind).toLocalIterator():  # BUCKETS / BLOCK rows and one more
        if r["block"] < 0:
            rows[:] = r["zero"][0], r["one"][0]
        else:
            counts[:, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["zero"], r["one"]
    return counts, rows


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log of (count of label 1 + 1, normalised) over (count of label 0 + 1, normalised)."""
    smooth = counts + 1.0
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and intercept of the hinge-loss model, by dual coordinate descent.

    ``labels`` are -1 and 1; both classes weigh the same in the loss.
    """
    weights, intercept = np.zeros(BUCKETS), 0.0
    duals = np.zeros(len(rows))
    per_class = {s: max(1, int((labels == s).sum())) for s in (-1, 1)}
    bound = np.array([COST * len(rows) / (2 * per_class[int(s)]) for s in labels])
    norms = np.array([np.sqrt((ratios[r] * ratios[r]).sum()) or 1.0 for r in rows])
    lengths = np.array([(ratios[r] * ratios[r]).sum() / (n * n) for r, n in zip(rows, norms, strict=True)]) + 1.0
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            scaled = ratios[rows[i]] / norms[i]
            slack = labels[i] * (weights[rows[i]] @ scaled + intercept) - 1.0
            dual = min(max(duals[i] - slack / lengths[i], 0.0), bound[i])
            step = (dual - duals[i]) * labels[i]
            if step:
                weights[rows[i]] += step * scaled
                intercept += step
                duals[i] = dual
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, float(intercept)


def _curve(margins: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on one variable, by Newton steps with a small ridge."""
    x = np.column_stack([margins, np.ones(len(margins))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (truth - p)) - 1e-3 * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(b[0], 1e-6)), float(b[1])


def fit_sample(rows: list[np.ndarray], truth: np.ndarray, ratios: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights, intercept, slope and shift from indicators and labels; ``share`` is the part of each class that the sample holds."""
    signs = np.where(truth == 1, 1, -1)
    weights, intercept = descend(rows, signs, ratios)
    fold = np.arange(len(rows)) % FOLDS
    margins = np.empty(len(rows))
    for k in range(FOLDS):
        seen = np.flatnonzero(fold != k)
        w, b = descend([rows[i] for i in seen], signs[seen], ratios) if len(seen) else (weights, intercept)
        for i in np.flatnonzero(fold == k):
            scaled = ratios[rows[i]]
            norm = np.sqrt((scaled * scaled).sum()) or 1.0
            margins[i] = w[rows[i]] @ scaled / norm + b
    weight = 1.0 / np.maximum(share[truth], 1e-9)
    return weights, intercept, *_curve(margins, truth, weight / weight.mean())


def fit(train: DataFrame) -> Model:
    """A model from ``train`` (id, text, label): label 0 or 1. ``id`` only draws the sample."""
    counts, rows = class_counts(train.select("text", "label"))
    if not rows.all():
        return constant_model(0.5 if not rows.any() else float(rows[1] > 0))
    ratios = log_ratios(counts)
    share = np.minimum(1.0, FIT_ROWS / 2 / rows)
    parts = 1 << 20
    least = F.when(F.col("label") == 1, int(share[1] * parts)).otherwise(int(share[0] * parts))
    place = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(parts))
    drawn = (place < int(share.max() * parts)) & (place < least)  # the first part needs no label, so it reaches the scan of texts
    shipped = train.sparkSession.sparkContext.broadcast((ratios, share))

    def solve(batches):
        last, held, size = np.empty(BUCKETS, np.int32), [], 0
        for batch in batches:
            for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
                if len(held) < 2 * FIT_ROWS and size < FIT_GRAMS:
                    held.append((zlib.crc32(text or b""), label, grams(text or b"", last)))
                    size += len(held[-1][2])
        if not held:
            return
        held.sort(key=lambda r: r[:2])  # an order that does not depend on partitions
        weights, *numbers = fit_sample([r[2] for r in held], np.array([r[1] for r in held]), *shipped.value)
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.float64())), pa.array([numbers], pa.list_(pa.float64()))], ["weights", "numbers"])

    found = train.filter(drawn).select("text", "label").repartition(1).mapInArrow(solve, "weights array<double>, numbers array<double>").toArrow()
    if not found.num_rows:
        return constant_model(float(rows[1] / rows.sum()))
    weights = np.array(found.column("weights")[0].as_py())
    intercept, slope, shift = found.column("numbers")[0].as_py()
    return Model((weights * ratios).astype(np.float32), ratios.astype(np.float32), intercept, slope, shift)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a double column ``out``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = slices([pa.RecordBatch.from_arrays([column], ["text"])], "text", TEXT_BATCH)
            found = [shipped.value.scores([t or b"" for t in p.column("text").cast(pa.binary()).to_pylist()]) for p in parts]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(out, score(F.col(text).cast("string")))


def one_label(labels: DataFrame, identifier: str, label: str) -> DataFrame:
    """(id, label): the more frequent of the labels 0 and 1 of every identifier; none where they tie."""
    valid = labels.filter(F.col(label).isin(0, 1) & F.col(identifier).isNotNull())
    mean = valid.groupBy(F.col(identifier).alias("id")).agg(F.avg(label).alias("_mean"))
    return mean.filter("_mean != 0.5").select("id", (F.col("_mean") > 0.5).cast("int").alias("label"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 3 == 1


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out; only their texts and labels are used.

    Texts meet labels in a sort-merge join at every size: labels grow with the documents, so they are never broadcast.
    """
    texts = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    known = one_label(labels, "doc_id", "quality").filter(~held_out(F.col("id")))
    return fit(texts.hint("merge").join(known, "id"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs, table(spark, sf_dir, "labels"))
    found = predict(docs.select("doc_id", "text"), model, out="score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
