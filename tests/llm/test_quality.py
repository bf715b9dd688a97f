"""The quality model against plain counts, the optimality of its descent, held-out accuracy and edge cases."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from periodica.llm import quality

ROWS = "id long, text string, label int"


def plain_grams(text):
    """Byte n-grams and word repetition patterns, one by one."""
    data = text.encode()
    found = {(n, int.from_bytes(data[i : i + n], "big")) for n in range(1, 5) for i in range(len(data) - n + 1)}
    words = data.split()
    for w in zip(words, words[1:], words[2:], words[3:]):
        a, b, c, d = w
        found.add((5, sum(same << i for i, same in enumerate((a == b, b == c, c == d, a == c, b == d, a == d)))))
    mix, mask = int(quality.MIX), (1 << 64) - 1
    return {(((x + (n << 40)) * mix) & mask) >> (64 - quality.BITS) for n, x in found}


@pytest.mark.parametrize("text", ["", "a", "ab", "a a a a b", "é ñandú $$$ $$$", "one two one two one", " \t\n ", "x" * 3000 + " y" * 50])
def test_grams_equal_plain_ones(text):
    got = quality.grams(text.encode())
    assert len(got) == len(set(got.tolist())) and set(got.tolist()) == plain_grams(text)


def test_grams_of_a_text_longer_than_a_span(monkeypatch):
    text = "wörd and more wörds, " * 40
    whole = {g for g in quality.grams(text.encode()).tolist()}
    monkeypatch.setattr(quality, "SPAN", 64)
    assert whole <= set(quality.grams(text.encode()).tolist())  # a cut may split a word, never lose a gram


def test_counts_cover_every_row(spark):
    texts = ["good text here", "bad!! bad!! bad!! bad!!", "", None, "good text here"]
    rows = [(i, texts[i % 5], i % 2) for i in range(40)]
    counts, n = quality.class_counts(spark.createDataFrame(rows, ROWS).repartition(7).select("text", "label"))
    want = np.zeros((2, quality.BUCKETS), int)
    for _, t, label in rows:
        for g in plain_grams(t or ""):
            want[label, g] += 1
    assert (counts == want).all() and n.tolist() == [20, 20]


def test_descent_reaches_the_optimum():
    """Every dual variable meets its condition, so that no single one can improve the loss."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    labels = np.where(np.array([r.min() for r in rows]) % 2 == 0, 1, -1)
    ratios = np.zeros(quality.BUCKETS)
    ratios[:60] = rng.normal(size=60)
    old, quality.EPOCHS = quality.EPOCHS, 3000
    try:
        w, b = quality.descend(rows, labels, ratios)
    finally:
        quality.EPOCHS = old
    x = np.zeros((80, 61))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
        x[i, 60] = 1
    cost = np.array([80 / (2 * (labels == s).sum()) for s in labels])
    full = np.append(w[:60], b)

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - labels * (x @ v))).sum()

    best = loss(full)
    assert all(loss(full + 1e-2 * d) > best - 1e-3 * best for d in rng.normal(size=(300, 61)))


def test_held_out_documents(spark, sf_dir):
    got = {r.doc_id: r for r in quality.op11_quality(spark, sf_dir).collect()}
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]].predicted, r["quality"]) for r in labels if got[r["doc_id"]].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p == q for p, q in held if q == 0]) > 0.8


def test_edges(spark):
    rows = [(i, "fine words in a row" if i % 2 else "JUNK!! JUNK!! JUNK!!", i % 2) for i in range(60)] + [(None, None, 1), (7, "", 0), (7, "", 0)]
    model = quality.fit(spark.createDataFrame(rows, ROWS))
    docs = spark.createDataFrame([(1, "more fine words"), (1, None), (None, ""), (2, "MORE JUNK!! JUNK!!"), (3, "fine words " * 200_000)], "doc_id long, text string")
    docs = docs.withColumn("label", F.lit("x")).withColumn("block", F.lit(1))
    out = quality.predict(docs, model, out="score")
    assert out.columns == [*docs.columns, "score"]
    by = [(r.text or "", r.score) for r in out.collect()]
    assert all(0 <= s <= 1 for _, s in by) and len({s for t, s in by if t == ""}) == 1
    assert dict(by)["more fine words"] > 0.5 > dict(by)["MORE JUNK!! JUNK!!"]
    assert quality.predict(docs.limit(0), model).count() == 0


def test_one_class_and_none(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ROWS)
    for train, score in ((rows, 1.0), (rows.withColumn("label", F.lit(0)), 0.0), (rows.limit(0), 0.5)):
        assert {r.s for r in quality.predict(rows, quality.fit(train), out="s").collect()} == {score}


def test_labels_by_majority(spark):
    rows = [(1, 1), (1, 1), (1, 0), (2, 0), (2, 1), (3, None), (3, 0), (4, 7), (None, 1)]
    got = quality.one_label(spark.createDataFrame(rows, "doc_id long, quality int"), "doc_id", "quality").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 0)]
