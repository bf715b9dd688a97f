"""Each operator against a brute-force version, an exact round trip or SQL, on the driver's small tables and on edge cases."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import ann, pii, queries, substrings, topk, warc

DOCS = "doc_id long, text string, lang string"


def load(sf_dir, name):
    import pyarrow.parquet as pq

    return pq.read_table(os.path.join(sf_dir, f"{name}.parquet")).to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(queries.ORACLES[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(want.column_names) == sorted(got.columns)
    columns = sorted(got.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert rows == sorted((tuple(r[c] for c in columns) for r in want.to_pylist()), key=key)


def test_personal_data_base_spans(spark, sf_dir):
    want = {r["doc_id"]: pii.brute_force(r["text"] or "") for r in load(sf_dir, "documents")}
    got = {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in pii.op2_pii(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize(
    "text",
    ["", "a@b.cc_d@e.ff", "@@x@y", "a@b", "1.2.3.4.5.6.7.8", "999.1.1.1", "007.0.0.001", "4111 1111 1111 1111", "4111-1111  1111", "+1 (555) 123-4567", "+", "9" * 9000, "x@" * 2000, "é+49 30 1234567890 ü"],
)
def test_personal_data_patterns(text):
    rows = pii.candidates(text)
    spans = [(s, k, e) for s, k, e, base, _ in rows if base]
    counts, _ = pii.brute_force(text) if len(text) < 4300 else ([0, 0, 0, 0], "")
    assert [sum(k == i for _, k, _ in spans) for i in range(4)] == counts


def test_personal_data_edges(spark):
    rows = spark.createDataFrame([(None, "call +1 555 123 4567", "x"), (2, None, None), (2, "", None), (2, "", None)], DOCS)
    got = pii.find_spans(rows.withColumn("found", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, len(r.found)) for r in got) == [(0, 1), (2, 0), (2, 0), (2, 0)]
    assert pii.find_spans(rows.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    big = "é€" * 40_000
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", None), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "WARC/1.1\r\n\r\n" * 30), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    warc.write_warc(pages, f"file://{tmp_path}/w")
    assert warc.read_records(spark, f"file://{tmp_path}/w").filter("kind = 'continuation'").count() > 5
    got = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/w", payload=True).collect()}
    assert all(r.complete for r in got.values()) and set(got) == {1, 2, 3, 4, 5, 6, None}
    for i, _, html in rows:
        revisit = i in (2, None)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert got[i].payload_bytes == len((html or "").encode())
        assert revisit or bytes(got[i].payload) == (html or "").encode()


def test_archive_missing_segment(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 30_000)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w")
    assert [r.complete for r in warc.reassembled(records).collect()] == [True]
    assert [r.complete for r in warc.reassembled(records.filter("segment != 2")).collect()] == [False]


@pytest.mark.parametrize(("length", "group_contexts", "piece_contexts"), [(40, 256, 1), (40, 1, 1), (96, 1, 4096), (96, 1, 1)])
def test_repeated_substrings(spark, length, group_contexts, piece_contexts):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, edge = word(90), word(40)
    texts = [word(50) + shared + word(60), shared, word(9) + edge, edge[:39] + word(30), edge + edge, "", None, "a" * 300, "x" * 39 + "y", word(700), "ab" * 45]
    texts += [word(7) + shared[10:70] + word(5) for _ in range(12)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(0, texts[0], None), (None, texts[9], None)]
    long = word(130)
    rows += [(100 + i, word(20) + long[i % 9 : 130 - i % 7] + word(20), None) for i in range(16)]
    want = substrings.brute_force([(t or "").encode() for _, t, _ in rows], length)
    got = substrings.dedup_substrings(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)), length=length, gram=8, group_contexts=group_contexts, piece_contexts=piece_contexts)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, [(x.s, x.e) for x in r.runs]) for r in got.collect()), key=key) == sorted(((r[0], w) for r, w in zip(rows, want, strict=True)), key=key)


def test_repeated_substrings_of_documents(spark, sf_dir):
    docs = load(sf_dir, "documents")
    want = {d["doc_id"]: w for d, w in zip(docs, substrings.brute_force([(d["text"] or "").encode() for d in docs], substrings.LENGTH), strict=True)}
    for r in substrings.op8_substrings(spark, sf_dir).collect():
        assert (r.n_removed, r.n_spans) == (sum(e - s for s, e in want[r.doc_id]), len(want[r.doc_id]))


def test_interval_tree():
    assert sorted(substrings.lcp_intervals([1, 3, 3, 0, 2])) == [(0, 0, 5), (1, 0, 3), (2, 4, 5), (3, 1, 3)]


def test_neighbours_edges_and_recall(spark, sf_dir):
    kept = {r["vec_id"]: np.array(r["embedding"], float) for r in load(sf_dir, "embeddings") if r["embedding"] and np.isfinite(np.array(r["embedding"], float)).all() and any(r["embedding"])}
    ids, v = np.array(list(kept)), np.array(list(kept.values()))
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in kept.items()], "id long, v array<double>")
    got = {}
    for r in ann.nearest(rows, rows.filter("id % 20 = 0"), block_rows=64, query_rows=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = v @ kept[q]
        order = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][: ann.K]
        own = [i for _, i, _ in sorted(got[q])]
        hit, total = hit + len(set(own) & set(order)), total + len(order)
        assert all(abs(x - v[ids == i][0] @ kept[q]) < 1e-9 for _, i, x in got[q])
    assert hit / total >= 0.9


def test_neighbours_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    got = ann.nearest(table, table.filter("id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 7, -1.0)]
    assert ann.nearest(table.limit(0), table).count() == 0


def test_top_k_edges(spark):
    rows = [(0, 0), (1, 0), (2, 1), (3, -1), (4, 3), (None, 0), (5, None), (100, 0)]
    table = spark.createDataFrame(rows, "id long, code long")
    got = topk.hamming_top_k(table, table.filter("id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.distance) for r in got] == [(0, 1, 0), (0, 100, 0), (0, 2, 1), (100, 0, 0), (100, 1, 0), (100, 2, 1)]
    assert topk.hamming_top_k(table.limit(0), table.limit(0)).count() == 0


def test_top_k_of_clustered_codes(spark):
    """Several radii, near copies and repeated codes, against all distances."""
    rng = np.random.default_rng(9)
    free = rng.integers(-(2**63), 2**63 - 1, 500)
    near = free[0] ^ (np.int64(1) << rng.integers(0, 63, 200))
    codes = [int(c) for c in np.concatenate([free, near, near[:20]])]
    table = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = topk.hamming_top_k(table, table.filter("id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, len(codes), 50):
        all_of = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in enumerate(codes) if i != q)
        want += [(q, rank, i, d) for rank, (d, i) in enumerate(all_of[:5], 1)]
    assert [(r.query_id, r["rank"], r.id, r.distance) for r in got] == want


def test_top_k_refuses_far_codes_in_the_join(spark):
    """A bucket that a query meets makes a row only of codes that can still be an answer."""
    index = spark.createDataFrame([(0, 5, c << 8 | 5, [c]) for c in range(256)], "segment int, value long, code long, ids array<long>")
    probes = spark.createDataFrame([(5, 1, 0, 8, 5, -1), (261, 0, 0, 8, 5, -1)], "query_code long, within int, segment int, n int, value long, top int")
    met = topk._met(probes, index)
    assert sorted((r.query_code, r.distance) for r in met.collect()) == [(5, 0)] + [(5, 1)] * 8 + [(261, 0)]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in next(line for line in plan.splitlines() if "Join Inner" in line)
