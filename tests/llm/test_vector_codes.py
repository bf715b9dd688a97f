"""Vector codes against a plain brute force, on ties, broken rows, few rows and clashing names."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows):
    """Codes, errors and codebooks by subtracting every part from every entry, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // vc.PARTS
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(part(v, p)) for _, v, _ in kept[: vc.ENTRIES]] for p in range(vc.PARTS)]

    def assign(v):
        found = [min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), i) for i, e in enumerate(books[p])) for p in range(vc.PARTS)]
        return [i for _, i in found], sum(d for d, _ in found)

    for _ in range(vc.ROUNDS):
        codes = [assign(v)[0] for _, v, _ in kept]
        new = [[list(e) for e in b] for b in books]
        for p in range(vc.PARTS):
            for i in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == i]
                if mine:
                    new[p][i] = [sum(col) // len(mine) for col in zip(*mine)]
        books = new
    out = [(i, label, *assign(v)) for i, v, label in kept]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    return sorted(((i is not None, i or 0, "".join(f"{c:02x}" for c in codes), error, totals[label]) for i, label, codes, error in out)), digest


def run(spark, rows, tmp_path, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = vc.op13_vector_codes(spark, path).collect()
    return sorted((r.vec_id is not None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


def test_equals_brute_force_with_ties_repeats_and_broken_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 32) / 256], int(rng.integers(0, 3)) if i % 5 else None) for i in range(300)]
    rows += [rows[7], (8, rows[9][1], 1), (None, rows[9][1], None), (None, [0.5] * 32, 2)]
    rows += [(900, None, 1), (-1, [None] + [0.0] * 31, 1), (-2, [float("nan")] * 32, 1), (-3, [float("inf")] * 32, None)]
    got, digest = run(spark, rows, tmp_path, "many")
    want, sha = brute_force(rows)
    assert got == want and digest == {sha}


def test_fewer_vectors_than_entries_and_wide_integers(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * 1e4], 0) for i in range(5)]
    got, digest = run(spark, rows, tmp_path, "few")
    want, sha = brute_force(rows)
    assert got == want and digest == {sha}


def test_empty_table_and_only_broken_rows(spark, tmp_path):
    assert run(spark, [], tmp_path, "none") == ([], set())
    assert run(spark, [(1, None, 2), (2, [float("nan")] * 16, 2)], tmp_path, "broken") == ([], set())


def test_unequal_vectors_are_refused(spark, tmp_path):
    for i, rows in enumerate(([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], [(1, [1.0] * 15, 0)], [(1, [3e38] * 16, 0)])):
        with pytest.raises(Exception, match="components"):
            run(spark, rows, tmp_path, f"bad{i}")


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, [0.25] * 16, 3), (2, [0.5] * 16, None)], SCHEMA)
    rows = rows.withColumn("id", F.lit("a")).withColumn("vector", F.lit(1)).withColumn("code", F.lit(2)).withColumn("_group", F.lit(4))
    books = vc.fit_books(vc.kept_vectors(rows, "embedding", "vec_id"))
    out = vc.encode(rows, books)
    assert out.columns == [*rows.columns, "coded"] and {(r.id, r.vector, r.code, r.coded.error) for r in out.collect()} == {("a", 1, 2, 0)}
    total = vc.with_group_total(rows.withColumn("v", F.lit(1)), "label", "v", "sum_v")
    assert total.columns == [*rows.columns, "v", "sum_v"] and sorted(r.sum_v for r in total.collect()) == [1, 1]


def test_dictionary_of_near_and_far_values():
    for values in (np.array([5, 3, 5, 9]), np.array([10**9, -7, 10**9])):
        distinct, number = vc.dictionary(values)
        assert (distinct[number] == values).all() and (np.diff(distinct) > 0).all()
