"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they are read and only their pieces' lengths move: about 40 bytes a piece, dealt by a
hash over as many packers as the number of pieces asks for. Each packer is an online best-fit with bounded space: a
fixed number of open bins, kept by free space in a bitset, so that the tightest bin that a piece fits in is the lowest
set bit from its length on. If none fits and all bins are open, the fullest closes. Pieces arrive in the order of a
hash, which mixes sizes, and the pieces of one Arrow batch are put longest first. A packer wastes at most what its last
open bins leave free, so the loss depends on the number of packers, not on the number of documents.

A null text is an empty one; an empty text is one piece that holds the end id alone. Repeated rows are packed each.
Token ids come from the byte-level BPE file with its own special tokens; the same vocabulary as ranks gives the same
ids faster, and texts that spell a special token go through the first.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm.common import fresh, plus_longs, slices, table, utf8
from periodica.session import materialize

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 8192
#: Pieces a packer takes on average: a few MB.
PIECES_PER_PACKER = 100_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_loaded: dict[str, object] = {}


class Encoder:
    """Texts to ids. ``exact`` is the tokenizer file itself; ``fast`` has the same merges and no special tokens."""

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Encoder:
    """One encoder per worker process. Names are looked up among the public tokenizers; paths are taken as they are."""
    from public_tokenizers import path

    if (key := f"{tokenizer}|{ranks}") not in _loaded:
        _loaded[key] = Encoder(*[x if "/" in x else str(path(x)) for x in (tokenizer, ranks)])
    return _loaded[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str = TOKENIZER, ranks: str = RANKS, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, tokenised in its whole length."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def tokenise(batches):
        enc = encoder(tokenizer, ranks)
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, "text", 2_000_000):
            row, out, ids = [], [], []
            for i, t in enumerate(utf8(batch.column("text"))):
                own = np.concatenate([enc.ids(t.decode()), end]).astype("<u4")
                for piece, (start, n) in enumerate(cut(len(own), capacity)):
                    part = own[start : start + n]
                    row.append(i)
                    out.append((piece, start, n, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        ids.append(part.astype(np.int64).tolist())
            values = np.array(out, np.int64).reshape(-1, 4)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(values[:, 0].astype(np.int32)), *[pa.array(values[:, k]) for k in (1, 2, 3)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tokenise, schema)


class BestFit:
    """Bounded-space online best-fit. ``put`` returns (sequence, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits = 0  # bit f is set if an open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._pop(free)
        else:
            if self.open == self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_packer: int = PIECES_PER_PACKER
) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more) with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice, so it should be a written table. No length may exceed ``capacity``.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(*[F.col(f"`{c}`") for c in names])
    packers = max(1, math.ceil(pieces.count() / pieces_per_packer))
    # by number of the row, so that many rows of one id, or of none, are spread; the numbers of a written table repeat
    row = fresh(pieces, "piece_row")
    numbered = pieces.withColumn(row, F.monotonically_increasing_id())
    dealt = numbered.repartition(packers, F.xxhash64(row)).sortWithinPartitions(F.xxhash64(row, F.lit(1)), row).drop(row)

    def fill(batches):
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            placed = np.zeros((len(lengths), 2), np.int64)
            for i in np.argsort(-lengths, kind="stable"):
                placed[i] = bins.put(int(lengths[i]))
            columns = [*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(fill, plus_longs(pieces, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise and pack: one row per piece."""
    return pack(materialize(token_pieces(docs, **options)), options.get("capacity", CAPACITY))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
