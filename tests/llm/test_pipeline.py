"""Line dedup, packing, SimHash and the stages of the pipeline against plain versions, and on edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from periodica.llm import common, line_dedup, packing, simhash
from periodica.session import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def plain_line_dedup(texts, min_docs=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    keys = [[x.strip(SPACE).translate(lower) for x in (t or "").split("\n")] for t in texts]
    docs = {}
    for own in keys:
        for k in {k for k in own if k}:
            docs[k] = docs.get(k, 0) + 1
    gone = [[docs.get(k, 0) >= min_docs for k in own] for own in keys]
    return [(len(g), sum(g), "\n".join(x for x, y in zip((t or "").split("\n"), g, strict=True) if not y)) for t, g in zip(texts, gone, strict=True)]


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=4):
    """The group number of every fingerprint, by comparing all of them."""
    u = np.array(fps, np.uint64)
    group = np.arange(len(u))
    for i in range(len(u)):
        near = np.bitwise_count(u ^ u[i]) <= max_bits
        touched = np.isin(group, group[near])
        group[touched] = group[touched].min()
    return group.tolist()


def edge_rows():
    rng = np.random.default_rng(51)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    notice = "All Rights Reserved"
    rows = [(i, f"{word(30)}\n  {notice.upper() if i % 2 else notice}\t\n{word(6)}", "en", "a", 7) for i in range(12)]
    base = word(400)
    rows += [(20 + i, base + " " + word(2), "en", "a", 1) for i in range(9)]
    rows += [(40, None, None, None, None), (41, "", "en", "a", 0), (42, "\n\n", "en", "b", 2), (None, word(8), "en", "a", 3), (43, word(5) * 4000, None, "a", 4)]
    rows += [(44, "same\nline", "en", "a", 9)] * 11 + [(None, "x", None, None, None)] * 3
    return rows


@pytest.mark.parametrize("broadcast_keys", [line_dedup.BROADCAST_KEYS, 0])
def test_line_dedup_edges_and_joined_keys(spark, broadcast_keys):
    rows = edge_rows()
    docs = spark.createDataFrame([(*r, f"r{i}", i) for i, r in enumerate(rows)], DOCS + ", line_row string, lines_gone long").withColumn("N_LINES", F.lit("mine"))
    got = {r.lines_gone: r for r in line_dedup.dedup_lines(docs, broadcast_keys=broadcast_keys).collect()}
    want = plain_line_dedup([r[1] for r in rows])
    assert len(got) == len(rows)
    for i, (n, dropped, kept) in enumerate(want):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text or "", got[i].line_row) == (n, dropped, kept, f"r{i}")
        assert (got[i].text is None) == (rows[i][1] is None)


def test_line_dedup_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, plain_line_dedup([d.text for d in docs]), strict=True)}
    for r in line_dedup.op5_line_dedup(spark, sf_dir).collect():
        n, dropped, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())


def plain_pieces(rows):
    """(doc_id, piece, start, length, crc) by the tokenizer file itself."""
    exact, out = packing.encoder().exact, []
    for i, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, first = 0, len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for piece, n in enumerate([first] + [2048] * ((len(ids) - first) // 2048)):
            out.append((i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    return out


def check_packed(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = 0
        for offset, n in sorted(own):
            assert offset == ends
            ends += n
        assert ends <= 2048
    return len(bins)


def test_packing_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_pieces(rows)
    used = check_packed(packing.op6_best_fit_packing(spark, sf_dir).collect(), want)
    least = -(-sum(r[3] for r in want) // 2048)
    assert used <= 1.05 * least + 1


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "<|endoftext|> x"), (4, "word " * 9000), (5, "é" * 3000), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("clash")).withColumn("piece", F.lit(9))
    check_packed(packing.pack_documents(docs).collect(), plain_pieces(rows))
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_spreads_rows_without_an_id(spark):
    pieces = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(100).cast("long").alias("length"))
    out = packing.pack(materialize(pieces), pieces_per_packer=500).groupBy(F.shiftright("sequence_id", 40).alias("packer")).count().collect()
    assert len(out) == 8 and max(r["count"] for r in out) < 700


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 3])
def test_fingerprints_and_components(spark, sf_dir, group_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) if len(r.text or "") < 4000 else simhash.fingerprint((r.text or "").encode()) for r in rows]
    group = plain_components(fps)
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{fp:016x}", least[g]) for r, fp, g in zip(rows, fps, group, strict=True)}
    got = simhash.simhash_components(docs, group_rows=group_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "component_id")
    assert {r.doc_id: (r.fp, r.component_id) for r in got.collect()} == want


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(52)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for _ in range(25):
            b ^= sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            fps.add(b)
    fps = sorted(fps)
    rows = materialize(spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long"))
    group = plain_components(fps)
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in set(group)}
    for size in (4096, 2):
        got = {r.doc_id: r.component_id for r in simhash.components_of(rows, group_rows=size).collect()}
        assert got == {i: least[g] for i, g in enumerate(group)}


def test_simhash_edges(spark):
    docs = spark.createDataFrame(edge_rows(), DOCS).withColumn("root", F.lit("r")).withColumn("row_key", F.lit(1))
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id in (40, 41, 42)} == {40}
    assert len({r.component_id for r in got if r.doc_id and 20 <= r.doc_id < 29}) == 1
    assert simhash.simhash_components(docs.limit(0)).count() == 0


STAGES = corpus_pipeline.STAGES


@pytest.mark.parametrize(("name", "stage"), STAGES, ids=[n for n, _ in STAGES])
def test_stage_edges(spark, sf_dir, name, stage):
    clash = ("n_lines", "n_dropped", "_row", "_gone", "row_key", "line_row", "mix", "language", "root", "fp", "key")
    docs = spark.createDataFrame(edge_rows(), DOCS)
    for c in clash:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    docs = materialize(docs)
    out = materialize(stage(spark, docs, sf_dir))
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0
    if stage is STAGES[-1][1]:
        return
    assert out.columns == docs.columns and empty.columns == docs.columns
    for r in out.collect():
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for c in clash)


def test_pipeline_equals_its_plain_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    first = materialize(STAGES[0][1](spark, docs, sf_dir))
    kept = first.collect()
    assert 0.9 * docs.count() < len(kept) <= docs.count()
    lines = [(r.doc_id, t) for r, (_, _, t) in zip(kept, plain_line_dedup([r.text for r in kept]), strict=True)]
    second = materialize(STAGES[1][1](spark, first, sf_dir))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in second.collect()) == sorted((i, t, len(t)) for i, t in lines)
    group = plain_components([simhash.fingerprint(t.encode()) for _, t in lines])
    least = {}
    for (i, _), g in zip(lines, group, strict=True):
        least[g] = min(least.get(g, i), i)
    third = materialize(STAGES[2][1](spark, second, sf_dir))
    assert sorted(r.doc_id for r in third.select("doc_id").collect()) == sorted(least.values())
    fourth = materialize(STAGES[3][1](spark, third, sf_dir))
    texts = {r.doc_id: r.text for r in third.collect()}
    mixed = [(r.doc_id, r.text) for r in fourth.select("doc_id", "text").collect()]
    assert mixed and all(texts[i] == t for i, t in mixed)
    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), plain_pieces(mixed))
