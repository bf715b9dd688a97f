"""Repeated byte strings removed: suffix arrays with common-prefix interval trees, dealt out by content-defined anchors.

Every string of ``length`` bytes holds at least one anchor: a gram of ``GRAM`` bytes whose hash is the least of all grams
in that string. Equal strings have their anchors at equal places, so whoever repeats meets at an anchor's hash. Each
anchor has a context: the bytes around it that a string of ``length`` with this anchor can cover.

1. Contexts are hashed where the text is read. Spark counts (anchor, context) with partial sums; a context found twice
   repeats from end to end, however many copies there are, and none of its text ever moves.
2. Anchors with several different contexts need their text, one representative for each context. Inside an anchor the
   suffixes from the anchor on are sorted (a sparse suffix array), neighbours' common prefixes make the interval tree by a
   stack scan, and each interval is tested for left extensions: among all its occurrences, not only neighbours, the common
   left lengths come from the sorted left contexts. Left plus right of at least ``length`` is a maximal repeat, and all
   its occurrences are marked.
3. An anchor with over ``GROUP_CONTEXTS`` contexts is never one group. Its strings fall into windows of places at which
   they begin; all strings of a window share a piece, so contexts are grouped by (anchor, window, piece). Beside the piece
   only the few bytes to its left and right still matter. Equal sides are counted by partial sums and are one row from
   then on; the different sides of a group go to the same interval tree. A group with over ``PIECE_CONTEXTS`` different
   sides is met again by narrower windows, one context for each of them, down to windows of a single place, where equal
   strings are counted. This is exact for any number of contexts.

Hashes that stand for text have 128 bits. A null text is empty. Texts shorter than ``length`` repeat nothing.
Rows that repeat doc_id and text are documents of their own that repeat each other. Strings are judged on the input.
Other columns than doc_id and text are not returned. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm.common import slices, table, utf8
from periodica.session import materialize

LENGTH = 400
#: Long grams are seldom shared by chance, so few anchors have several contexts; anchors are about 2 / (LENGTH - GRAM) of all places.
GRAM = 128
GROUP_CONTEXTS = 1024
#: Different sides of one piece that one task holds; they are short, at most an eighth of ``LENGTH`` each.
PIECE_CONTEXTS = 4096
#: Bytes of one text that are scanned at a time; windows overlap, so the result is that of the whole.
SCAN_BYTES = 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 65536)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers


def gram_hashes(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every ``k`` bytes: a polynomial modulo 2**64 by prefix sums, mixed."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_BYTE[data] ^ np.uint64(seed)) * up[: len(data)])])
        h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, op: np.ufunc, pad: int) -> np.ndarray:
    """op over x[i : i + w] for every whole window."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    blocks = np.full(size, np.uint64(pad), np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors_of(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    h = gram_hashes(data, gram)
    w = length - gram + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding(h, w, np.minimum, (1 << 64) - 1)
    # the least values of the windows that hold i, the largest of them; windows outside the text do not count
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(around, w, np.maximum, 0) == h)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Places of all grams that are least in some string of ``length`` bytes, ties included."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= SCAN_BYTES:
        return _anchors_of(data, length, gram)
    found = [s + _anchors_of(data[s : s + SCAN_BYTES + length - 1], length, gram) for s in range(0, len(data), SCAN_BYTES)]
    return np.unique(np.concatenate(found))


def _sides(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    return text[max(0, at - (length - gram)) : at], text[at : at + length]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def occurrences(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per document with anchors: key and arrays of (at, a, c1, c2, l, r), the context's sides as lengths."""
    schema = "key string, found array<struct<at: int, a: long, c1: long, c2: long, l: int, r: int>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("l", pa.int32()), ("r", pa.int32())]))

    def find(batches):
        for batch in slices(batches, "text", 2_000_000):
            keys, out = [], []
            for key, t in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), strict=True):
                own = []
                for at in anchors(t, length, gram).tolist():
                    left, right = _sides(t, at, length, gram)
                    c1, c2 = _halves(xxhash.xxh3_128_digest(len(left).to_bytes(4, "little") + left + right))
                    own.append((at, int.from_bytes(xxhash.xxh64_digest(right[:gram]), "little", signed=True), c1, c2, len(left), len(right)))
                if own:
                    keys.append(key)
                    out.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, kind)], ["key", "found"])

    return rows.mapInArrow(find, schema)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differs = x != y
    at = int(differs.argmax()) if n else 0
    return at if n and differs[at] else n


def lcp_intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree, by a stack scan over neighbours' common prefixes."""
    out, stack = [], [(0, 0)]
    for i, h in enumerate([*lcp, -1], 1):
        first = i - 1
        while stack and h < stack[-1][0]:
            value, first = stack.pop()
            out.append((value, first, i - 1))
        if not stack or h > stack[-1][0]:
            stack.append((h, first))
    return [x for x in out if x[2] > x[1]]


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context how far left and right of the anchor it is covered by strings of ``length`` found in another; 0 if not."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [_common(rights[i], rights[j]) for i, j in zip(order, order[1:], strict=False)]
    back = [x[::-1] for x in lefts]
    by_left = sorted(range(n), key=back.__getitem__)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    left_lcp = np.array([*(_common(back[i], back[j]) for i, j in zip(by_left, by_left[1:], strict=False)), 0], np.int64)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for right, first, last in lcp_intervals(lcp):
        members = np.array(order[first : last + 1])
        ranks = np.sort(rank[members])
        between = np.minimum.reduceat(left_lcp, ranks)[:-1]  # of occurrences that are neighbours on the left
        left = np.maximum(np.append(between, 0), np.insert(between, 0, 0))
        good = left + right >= length
        who = np.array(by_left)[ranks[good]]
        far_left[who] = np.maximum(far_left[who], left[good])
        far_right[who] = np.maximum(far_right[who], right)
    return far_left, far_right


def _trees(dealt: DataFrame, group: list[str], own: list[str], length: int) -> DataFrame:
    """(*group, *own, l, r) of rows (*group, *own, left, right) that came sorted by ``group``; rows without a repeat go."""
    n, names = len(group), [*group, *own]

    def scan(batches):
        def solved(rows):
            if len(rows) < 2:
                return []
            left, right = extents([r[-2] for r in rows], [r[-1] for r in rows], length)
            return [(*r[:-2], int(x), int(y)) for r, x, y in zip(rows, left, right, strict=True) if x + y]

        def out(rows):
            kinds = [*names, "l", "r"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(kinds))], kinds)

        held: list[tuple] = []
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "left", "right")), strict=True):
                if held and held[0][:n] != row[:n]:
                    done += solved(held)
                    held = []
                held.append(row)
            yield out(done)
        if held:
            yield out(solved(held))

    return dealt.select(*names, "left", "right").mapInArrow(scan, ", ".join(f"{c} long" for c in (*names, "l", "r")))


def _pieces(contexts: DataFrame, length: int, step: int, asked: bool) -> DataFrame:
    """One row per context and window of ``step`` places, or per window that begins at a place of ``near`` if ``asked``.

    A window at l0 has the strings that begin l0 to l0 + step - 1 bytes before the anchor. (g1, g2) stands for anchor, l0
    and the piece that they share, (s1, s2) for the bytes to its left and right that they can have.
    """
    core, longs = length - step + 1, ["a", "c1", "c2", "l0", "g1", "g2", "s1", "s2"]
    digest = xxhash.xxh3_128_digest

    def cut(batches):
        for batch in slices(batches, "right", 500_000):
            out = []
            near = batch.column("near").to_pylist() if asked else [None] * batch.num_rows
            for a, c1, c2, left, right, places in zip(*(batch.column(c).to_pylist() for c in ("a", "c1", "c2", "left", "right")), near, strict=True):
                whole, n = left + right, len(left)
                for l0 in range(0, n + 1, step) if places is None else places:
                    at, end = n - l0, n - l0 + core
                    if at < 0 or end > len(whole):
                        continue
                    before, after = whole[max(0, at - step + 1) : at], whole[end : end + step - 1]
                    if len(before) + len(after) < step - 1:
                        continue
                    g = digest(a.to_bytes(8, "little", signed=True) + l0.to_bytes(4, "little") + whole[at:end])
                    s = digest(len(before).to_bytes(4, "little") + before + after)
                    out.append((a, c1, c2, l0, *_halves(g), *_halves(s), before, after))
            kinds = [pa.int64()] * len(longs) + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [*longs, "left", "right"])

    return contexts.mapInArrow(cut, ", ".join(f"{c} long" for c in longs) + ", left binary, right binary")


def _refined(contexts: DataFrame, length: int, piece_contexts: int, step: int | None = None) -> DataFrame:
    """(a, c1, c2, l, r) of contexts whose anchors have too many for one group. Contexts that come twice repeat each other."""
    id3, group, side = ["a", "c1", "c2"], ["g1", "g2"], ["s1", "s2"]
    asked, step = step is not None, step or max(1, length // 8)
    core = length - step + 1
    cut = materialize(_pieces(contexts, length, step, asked))
    classes = cut.groupBy(*group, *side).agg(
        F.count("*").alias("n"), F.first("l0").alias("l0"), F.first("left").alias("left"), F.first("right").alias("right"), F.min(F.struct(*id3)).alias("rep")
    )
    classes = materialize(classes)
    l, r = F.col("l0") + F.col("l"), F.lit(core) - F.col("l0") + F.col("r")
    found = classes.filter("n > 1").select(*group, *side, "l0", F.octet_length("left").cast("long").alias("l"), F.octet_length("right").cast("long").alias("r"))
    if step > 1:
        # groups too large for one task are few, so keeping them out seldom moves a row; lone sides are skipped in the scan
        crowded = materialize(classes.groupBy(*group).agg(F.count("*").alias("m")).filter(F.col("m") > piece_contexts).select(*group))
        dealt = classes.join(crowded, group, "left_anti").repartition(*group).sortWithinPartitions(*group)
        found = found.unionByName(_trees(dealt, group, [*side, "l0"], step - 1))
    marks = cut.select(*id3, *group, *side).join(found.select(*group, *side, l.alias("l"), r.alias("r")), [*group, *side]).select(*id3, "l", "r")
    if step > 1:
        narrow = 1 if step <= 8 else int(np.ceil(np.sqrt(step)))
        # equal sides have all their strings by now; one context of each class is enough for the others to meet
        near = classes.join(crowded, group, "left_semi").select("rep.*", F.explode(F.sequence(F.col("l0"), F.col("l0") + (step - 1), F.lit(narrow))).alias("l0"))
        if not crowded.isEmpty():
            again = contexts.drop("near").join(near.groupBy(*id3).agg(F.collect_set("l0").alias("near")), id3)
            marks = marks.unionByName(_refined(again, length, piece_contexts, narrow))
    return marks


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group_contexts: int = GROUP_CONTEXTS, piece_contexts: int = PIECE_CONTEXTS
) -> DataFrame:
    """(key, spans): for each document the places [start, end) that repeated strings cover, one per anchor, of ``rows`` (key, text).

    ``rows`` is read three times. Rows with equal keys must have equal texts.
    """
    found = materialize(occurrences(rows, length, gram))
    flat = found.select("key", F.explode("found").alias("o")).select("key", "o.*")
    id3 = ["a", "c1", "c2"]
    classes = materialize(flat.groupBy(*id3, "l", "r").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("rep")))
    per = classes.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1")
    whole = classes.filter((F.col("n") > 1) & (F.col("l") + F.col("r") >= length)).select(*id3, F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))
    asked = classes.join(per, "a").groupBy(F.col("rep.key").alias("key")).agg(F.collect_list(F.struct(*id3, "m", F.col("rep.at").alias("at"))).alias("asked"))
    schema = "a long, c1 long, c2 long, m long, left binary, right binary"

    def read(batches):
        last = None  # rows come sorted by key; those that repeat a row would bring the same contexts again
        for batch in slices(batches, "text", 1_000_000):
            out = []
            for key, t, wanted in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                if key == last:
                    continue
                last = key
                out += [(w["a"], w["c1"], w["c2"], w["m"], *_sides(t, w["at"], length, gram)) for w in wanted]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["a", "c1", "c2", "m", "left", "right"])

    # a join that sorts: the table of places grows with the input. A context that still comes twice is of repeated rows,
    # and all that these hold is repeated anyway
    contexts = materialize(rows.hint("merge").join(asked, "key").select("key", "text", "asked").mapInArrow(read, schema))
    dealt = contexts.filter(F.col("m") <= group_contexts).repartition("a").sortWithinPartitions("a")
    marks = _trees(dealt, ["a"], ["c1", "c2"], length)
    large = contexts.filter(F.col("m") > group_contexts).drop("m")
    if not large.isEmpty():
        marks = marks.unionByName(_refined(large, length, piece_contexts))
    reach = materialize(whole.unionByName(marks).groupBy(*id3).agg(F.max("l").alias("l"), F.max("r").alias("r")))
    spans = flat.select("key", "at", *id3).join(reach, id3).select("key", F.struct((F.col("at") - F.col("l")).alias("s"), (F.col("at") + F.col("r")).alias("e")).alias("span"))
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered places; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, runs): what stays of each text in bytes, and the runs [start, end) removed."""
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit(""))]
    rows = docs.select(F.md5(F.concat(*parts)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    spans = repeated_spans(rows.select("key", "text"), **options)
    id_kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches):
        for batch in slices(batches, "text", 4_000_000):
            kept, runs = [], []
            for t, found in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                own = merged([(x["s"], x["e"]) for x in found or []])
                edges = [0, *(v for run in own for v in run), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                runs.append([{"s": s, "e": e} for s, e in own])
            sizes = [len(t) for t in utf8(batch.column("text"))]
            longs = [sizes, [n - len(k) for n, k in zip(sizes, kept, strict=True)], [len(r) for r in runs]]
            columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in longs]]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, kind)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "runs"])

    schema = f"doc_id {id_kind}, kept binary, n_bytes long, n_removed long, n_spans long, runs array<struct<s: long, e: long>>"
    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Runs removed from each text, straight from the definition; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            h = hashlib.md5(t[i : i + length]).digest()
            seen[h] = seen.get(h, 0) + 1
    return [merged([(i, i + length) for i in range(len(t) - length + 1) if seen[hashlib.md5(t[i : i + length]).digest()] > 1]) for t in texts]
