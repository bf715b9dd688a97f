"""Ranked search against a plain scorer, its sketches against exact impacts, and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from periodica.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_force(docs, queries, k):
    words = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in queries:
        scores = []
        for doc, c in words:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 25
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, queries, k=10, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(d, q, k).collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé日z0_ -.\n\x00\x7f", max_size=40), max_size=6), st.integers(1, 9))
def test_hashed_terms_equal_the_pattern(texts, span):
    old, ranked.SPAN = ranked.SPAN, span
    try:
        number, h1, h2 = ranked.hashed_terms(t.encode() for t in texts)
    finally:
        ranked.SPAN = old
    want = [(i, t) for i, text in enumerate(texts) for t in terms(text)]
    assert number.tolist() == [i for i, _ in want]
    names = {}
    for key, (_, t) in zip(zip(h1.tolist(), h2.tolist()), want):
        assert names.setdefault(key, t) == t
    assert len(names) == len({t for _, t in want})


def test_long_terms_are_told_apart():
    texts = ["a" * 63 + "b" * n + c for n in (0, 1, 5, 300) for c in ("x", "y")]
    _, h1, _ = ranked.hashed_terms(t.encode() for t in texts)
    assert len(set(h1.tolist())) == len(texts)


def test_sketches_never_fall_below_the_score():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 400))).encode() for _ in range(60)]
    q = ranked.query_block(list(range(8)), [" ".join(rng.choice(vocabulary, 30)).encode() for _ in range(8)])
    q.documents, q.terms, q.weights = 60, 12000, rng.integers(0, 9000, len(q.h1))
    s = ranked.Sketches(texts, q)
    places = {int(b): tuple((g >> np.uint64(64 - b)).astype(np.int64) for g in ranked._cells(q.h1, q.h2)) for b in np.unique(s.bits)}
    matrix = np.zeros((len(q.h1), 8), np.float32)
    for i, (t, n) in enumerate(q.items):
        matrix[t, i] = ranked.STEP * q.weights[t] * n
    docs = np.flatnonzero(np.diff(s.bounds))
    bounds = s.upper_bounds(docs, places, matrix)
    exact = np.array([[(s.contributions(int(d), q)[t] * n).sum() for t, n in q.items] for d in docs])
    assert (bounds * (1 + 4 * (len(q.h1) + 8) * 2.0**-24) >= exact).all()
    assert bounds.sum() < 1.5 * exact.sum()  # and they are of use


@pytest.mark.parametrize("blocks", [512, 3])
def test_equals_plain_scores(spark, monkeypatch, blocks):
    monkeypatch.setattr(ranked, "QUERY_ITEMS", blocks)
    rng = np.random.default_rng(6)
    words = ["The", "of", "élan", "naïve", "x1", "日本", "rare"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(120)]
    docs += [(200 + i, docs[5][1]) for i in range(15)] + [docs[6], (None, docs[6][1]), (300, None), (301, ""), (302, "... --")]
    queries = [(i, " ".join(rng.choice(words, 12))) for i in range(6)] + [(6, docs[5][1]), (6, "the THE the"), (7, None), (8, "nowhere"), (None, "rare")]
    assert run(spark, docs, queries) == brute_force(docs, queries, 10)
    assert run(spark, docs, queries, 3, 1) == brute_force(docs, queries, 3)


def test_empty_tables_long_texts_and_other_columns(spark):
    docs = [(1, "word " * 300_000 + "end"), (2, "end of it")]
    assert run(spark, docs, [(1, "end word")]) == brute_force(docs, [(1, "end word")], 10)
    assert run(spark, docs, []) == [] and run(spark, [], [(1, "end")]) == []
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    q = spark.createDataFrame([(1, "end")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    assert sorted((r.rank, r.doc_id) for r in ranked.search(d, q).collect()) == [(1, 2), (2, 1)]
