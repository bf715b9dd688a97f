"""Language identification with interpolated Kneser-Ney character models.

Text is folded to lower-case letters with single spaces between words. Spark counts 4-grams of UTF-16 units (packed in
a long, so exactly) over all training documents, per language, added up inside each task before the shuffle. Lower
orders count how many different units precede a gram, the Kneser-Ney continuation counts, and follow from the 4-grams.
One absolute discount per language and order interpolates each order with the next lower one, down to the uniform.

The model is a sorted hash array per order: 64-bit hashes of the grams of all languages in ascending order, found
through an index of their leading bits, with one column of log-probabilities per language; contexts have one of their
own for the interpolation weights, used where a gram was never seen. Arrays hold at most ``MAX_CELLS`` probabilities of
4-grams: should the corpus hold more, Spark works out all orders from all counts as tables (:class:`Tables`), the arrays
keep the most frequent 4-grams (from a count that Spark finds by a histogram of counts), and the others that a text holds
are looked up by joins. Either way every gram counts, with the same probabilities. A text's language is that with the lowest
cross-entropy per unit. The score is a softmax of these entropies; its sharpness is fitted on the share
``CALIBRATION_SHARE`` of labelled documents that is kept out of the counts, and so is, for each language, how far above its
own mean the entropy of an accepted text may lie: far in short texts, less in long ones (:func:`_spread`). Both are sums
and maxima over all rows of that share, however many.

Null and empty texts and texts without a letter are ``und``, score 0, rejected. Without any training document every
text is. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.llm.common import fresh, slices, table
from periodica.session import bounded_side, materialize

ORDER = 4
#: Probabilities of 4-grams that are sent to every task; those of rarer ones stay in tables.
MAX_CELLS = 8_000_000
#: The labelled documents that calibrate the model, all of them; the others are counted.
CALIBRATION_SHARE = 0.1
SHARPNESSES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: An accepted text's entropy excess may be this many times the largest one seen in calibration, or ``LEAST_EXCESS``.
SLACK = 2.0
LEAST_EXCESS = 5.0
UNDETERMINED = "und"
START, SPACE = 1, 32

_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """UTF-16 unit to folded unit: letters and marks in lower case, U+FFFF the start symbol, all else a space."""
    if not _fold:
        out = np.full(65536, SPACE, np.uint16)
        for c in range(65536):
            ch = chr(c)
            if 0xD800 <= c < 0xE000:
                out[c] = c
            elif ch.isalpha() or unicodedata.category(ch)[0] == "M":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        out[0xFFFF] = START
        _fold.append(out)
    return _fold[0]


_BEYOND = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")


def _letter_beyond(found: re.Match) -> str:
    c = found.group()
    return c if c.isalpha() or unicodedata.category(c)[0] == "M" else " "


def lettered(text: str) -> str:
    """``text`` with code points beyond the first plane that are no letters blanked, or nothing if it has no letter."""
    if not any(c.isalpha() for c in text):
        return ""
    return text if text.isascii() else _BEYOND.sub(_letter_beyond, text)


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded units of all texts, each after ``ORDER - 1`` start symbols, and where each text begins (one more at the end).

    Letters are decided on code points: beyond the first 65,536 only letters and marks keep their two units, and a text
    whose marks stand on no letter has no unit at all.
    """
    parts = [("\uffff" * (ORDER - 1) + lettered(t)).encode("utf-16-le", "surrogatepass") for t in texts]
    units = _folding()[np.frombuffer(b"".join(parts), np.uint16)]
    stay = units != SPACE
    stay[1:] |= units[:-1] != SPACE
    starts = np.concatenate([[0], np.cumsum([len(p) // 2 for p in parts])]).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(stay)])
    return units[stay], kept[starts]


def _packed(units: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each position from the fourth on."""
    u = units.astype(np.uint64)
    return (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]


def _inside(starts: np.ndarray) -> np.ndarray:
    """Which of the packed grams end at a unit of a text, not at a start symbol."""
    inside = np.ones(max(0, starts[-1] - 3), bool)
    for k in range(ORDER - 1):
        at = starts[1:-1] + k - 3
        inside[at[at >= 0]] = False
    return inside


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows of ``train`` (lang, text)."""

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(pairs):
            grams, n = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            own, at = np.unique(grams, return_inverse=True)
            return own, np.bincount(at, n, len(own)).astype(np.int64)

        def rows():
            for lang, pairs in held.items():
                grams, n = merge(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in slices(batches, "text", 4_000_000):
            by: dict[str, list[str]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(t or "")
            for lang, texts in by.items():
                units, starts = folded(texts)
                if len(units) >= ORDER:
                    held.setdefault(lang, []).append(np.unique(_packed(units)[_inside(starts)], return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [merge(held[lang])]
            if sum(len(g) for pairs in held.values() for g, _ in pairs) > 2_000_000:
                yield from rows()
                held.clear()
        yield from rows()

    rows = train.mapInArrow(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mix(grams: np.ndarray) -> np.ndarray:
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class HashArray:
    """Distinct grams as ascending 64-bit hashes (the mixing is one-to-one), with the place where each prefix begins."""

    hashes: np.ndarray
    first: np.ndarray
    shift: np.uint64
    longest: int

    @classmethod
    def of(cls, grams: np.ndarray) -> tuple[HashArray, np.ndarray]:
        hashes = _mix(grams)
        order = np.argsort(hashes)
        bits = max(1, int(len(grams) * 4).bit_length())
        shift = np.uint64(64 - bits)
        size = np.bincount((hashes >> shift).astype(np.int64), minlength=1 << bits)
        return cls(hashes[order], np.concatenate([[0], np.cumsum(size)]).astype(np.int32), shift, int(size.max(initial=0))), order

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Place of each gram, or -1."""
        h = _mix(grams)
        at = self.first[(h >> self.shift).astype(np.int64)]
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        found = np.where(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h, at, -1).astype(np.int64)
        for k in range(1, self.longest):
            miss = np.flatnonzero(found < 0)
            if not len(miss):
                break
            i = np.minimum(at[miss] + k, len(self.hashes) - 1)
            hit = self.hashes[i] == h[miss]
            found[miss[hit]] = i[hit]
        return found


@dataclass
class Tables:
    """``grams[k]`` (gram, log_p) and ``contexts[k]`` (context, weight) of order k + 1, logarithms with a value per language."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    unseen: list[float]

    def look_up(self, grams: DataFrame) -> DataFrame:
        """(gram, log_p) of different 4-grams; those never seen by the weights of their contexts and their longest seen end."""
        found = grams.select("gram")
        for k in range(ORDER, 0, -1):
            end = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k < ORDER else F.col("gram")
            found = found.withColumn("end", end).withColumn("context", F.shiftrightunsigned("end", 16))
            for side, on, value in ((self.grams[k - 1], "end", "log_p"), (self.contexts[k - 1], "context", "weight")):
                units = k if on == "end" else k - 1
                side = side.select(F.col(side.columns[0]).alias(on), F.col(value).alias(f"{value}{k}"))
                found = found.join(_by_units(side, units, len(self.unseen)), on, "left")
            found = found.drop("end", "context")
        value = F.lit(self.unseen)
        for k in range(1, ORDER + 1):
            if k > 1:
                value = F.coalesce(F.zip_with(f"weight{k}", value, lambda w, v: w + v), value)
            value = F.coalesce(F.col(f"log_p{k}").cast("array<double>"), value)
        return found.select("gram", value.alias("log_p"))


def _by_units(side: DataFrame, units: int, width: int) -> DataFrame:
    """A side of a join keyed by so many units: there are at most 65,536 single ones, else a join that sorts."""
    return bounded_side(side, 1 << (16 * units), 16 * width + 48) if units <= 1 else side.hint("merge")


@dataclass
class Model:
    """``grams[k]`` and ``log_p[k]`` (languages x grams) for order k + 1; ``weights[k]`` for the contexts of order k + 1.

    With ``tables`` the only arrays are those of the most frequent 4-grams.
    """

    langs: list[str]
    grams: list[HashArray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[HashArray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    sharpness: float = 1.0
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None
    tables: Tables | None = None
    #: Whether there are tables, also where they are not sent along.
    partial: bool = False

    def shipped(self, spark: SparkSession) -> Broadcast[Model]:
        return spark.sparkContext.broadcast(replace(self, tables=None))

    def absent(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, 4-gram and how often it comes there, of all that the arrays do not hold."""
        units, starts = folded(texts)
        grams = _packed(units)
        place = np.flatnonzero(_inside(starts) & (self.grams[-1].find(grams) < 0))
        who, grams = np.searchsorted(starts, place, "right") - 1, grams[place]
        order = np.lexsort((grams, who))
        who, grams = who[order], grams[order]
        first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (grams[1:] != grams[:-1])])) if len(who) else np.zeros(0, np.int64)
        return who[first], grams[first], np.diff(np.append(first, len(who)))

    def entropies(self, texts: list[str], rest: list[list[float] | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bits per unit (texts x languages) and the number of units; 0 units where a text has no letter.

        ``rest`` has for each text the sums over 4-grams that the arrays do not hold, if these are not all.
        """
        units, starts = folded(texts)
        begin = starts[:-1] + ORDER - 1
        n = starts[1:] - begin
        letters = np.concatenate([[0], np.cumsum((units != SPACE) & (units != START))])
        n = np.where(letters[starts[1:]] - letters[starts[:-1]] > 0, n, 0)
        bits = np.zeros((len(texts), len(self.langs)))
        if not n.any() or not self.langs:
            return bits, n
        grams = _packed(units)
        at = self.grams[-1].find(grams)
        miss = np.flatnonzero(at < 0)
        rare = self._backed_off(grams[miss]) if len(miss) and not self.partial else np.zeros((len(miss), len(self.langs)))
        inside = _inside(starts)
        edges = np.concatenate([starts[:-1], [len(grams)]])  # a gram is counted at its first unit's place
        for k in range(len(self.langs)):
            own = self.log_p[-1][k][at].astype(np.float64) if len(self.grams[-1].hashes) else np.zeros(len(at))
            own[miss] = rare[:, k]
            own[~inside] = 0.0
            total = np.concatenate([[0.0], np.cumsum(own)])
            bits[:, k] = -(total[np.minimum(edges[1:], len(grams))] - total[np.minimum(edges[:-1], len(grams))])
        for i, sums in enumerate(rest or []):
            if sums is not None:
                bits[i] -= sums
        return bits / np.maximum(n, 1)[:, None], n

    def _backed_off(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of unseen 4-grams: the weights of their contexts times the longest seen end."""
        out = np.zeros((len(grams), len(self.langs)))
        rest = np.arange(len(grams))
        for k in range(ORDER - 1, 0, -1):  # order k + 1 was missed
            g = grams[rest] & np.uint64((1 << (16 * (k + 1))) - 1)
            c = self.contexts[k].find(g >> np.uint64(16))
            seen = c >= 0
            out[rest[seen]] += self.weights[k][:, c[seen]].T
            low = self.grams[k - 1].find(g & np.uint64((1 << (16 * k)) - 1))
            hit = low >= 0
            out[rest[hit]] += self.log_p[k - 1][:, low[hit]].T
            rest = rest[~hit]
        out[rest] += self.unseen
        return out


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The model from the 4-gram counts of each language (numbers into ``langs``)."""
    model = Model(langs)
    levels = []  # per order, highest first: lang, gram, count
    cl, cg, cn = lang, gram.astype(np.uint64), n.astype(np.float64)
    for k in range(ORDER, 0, -1):
        levels.append((cl, cg, cn))
        if k > 1:
            suffix = cg & np.uint64((1 << (16 * (k - 1))) - 1)
            order = np.lexsort((suffix, cl))
            l, s = cl[order], suffix[order]
            head = np.concatenate([[True], (l[1:] != l[:-1]) | (s[1:] != s[:-1])]) if len(l) else np.zeros(0, bool)
            at = np.flatnonzero(head)
            cl, cg, cn = l[at], s[at], np.diff(np.concatenate([at, [len(l)]])).astype(np.float64)
    uniform = 1.0 / (len(np.unique(levels[-1][1])) + 1)
    below: tuple[np.ndarray, np.ndarray] | None = None  # sorted grams and probabilities of the next lower order
    for k, (l, g, c) in enumerate(reversed(levels), 1):
        own = np.unique(g)
        contexts = np.unique(own >> np.uint64(16))
        p, weight = np.zeros((len(langs), len(own))), np.ones((len(langs), len(contexts)))
        for i in range(len(langs)):
            mine = l == i
            gi, ci = g[mine], c[mine]
            ones, twos = float((ci == 1).sum()), float((ci == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            ctx = np.searchsorted(contexts, gi >> np.uint64(16))
            total = np.bincount(ctx, ci, len(contexts))
            types = np.bincount(ctx, minlength=len(contexts))
            np.divide(discount * types, total, out=weight[i], where=total > 0)
            p[i, np.searchsorted(own, gi)] = np.maximum(ci - discount, 0) / total[ctx]
        lower = uniform if below is None else below[1][:, np.searchsorted(below[0], own & np.uint64((1 << (16 * (k - 1))) - 1))]
        p += weight[:, np.searchsorted(contexts, own >> np.uint64(16))] * lower
        below = (own, p)
        found, order = HashArray.of(own)
        model.grams.append(found)
        model.log_p.append(np.log2(p[:, order]).astype(np.float32))
        found, order = HashArray.of(contexts)
        model.contexts.append(found)
        model.weights.append(np.log2(weight[:, order]).astype(np.float32))
        if k == 1:
            model.unseen = np.log2(weight[:, 0] * uniform) if len(contexts) else np.full(len(langs), np.log2(uniform))
    return model


def _per_language(value: Column, width: int, default: float) -> Column:
    """An array over languages of the one value that each has in column ``value`` of a group, ``default`` where it has none."""
    return F.array(*[F.coalesce(F.max(F.when(F.col("i") == i, value)), F.lit(default)) for i in range(width)])


def build_tables(langs: list[str], counts: DataFrame) -> Tables:
    """What :func:`build` makes, for all grams of ``counts`` (lang, gram, n), by sums and joins."""
    width = len(langs)
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), f)
    logs = lambda c: F.transform(c, lambda x: F.log2(x).cast("float"))
    levels = [counts.select((F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int").alias("i"), "gram", F.col("n").cast("double").alias("n"))]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")
        levels.insert(0, materialize(levels[0].select("i", suffix).groupBy("i", "gram").agg(F.count("*").cast("double").alias("n"))))
    uniform = 1.0 / (levels[0].select("gram").distinct().count() + 1)
    out, below, unseen = Tables([], [], []), None, []
    for k, level in enumerate(levels, 1):
        discounts = [0.75] * width
        for i, ones, twos in level.groupBy("i").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
            discounts[i] = ones / (ones + 2 * twos) if ones and twos else 0.75
        discount = F.lit(discounts)
        context = F.shiftrightunsigned("gram", 16).alias("context")
        totals = level.groupBy(context, "i").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        weight = F.get(discount, F.col("i")) * F.col("types") / F.col("total")
        contexts = materialize(totals.groupBy("context").agg(_per_language(F.col("total"), width, 0.0).alias("total"), _per_language(weight, width, 1.0).alias("weight")))
        grams = level.groupBy("gram").agg(_per_language(F.col("n"), width, 0.0).alias("n")).withColumn("context", context)
        grams = grams.join(_by_units(contexts, k - 1, width), "context")
        if below is None:
            lower = F.lit([uniform] * width)
            first = contexts.select("weight").head()
            unseen = [float(x) for x in np.log2(np.array(first[0] if first else [1.0] * width) * uniform)]
        else:
            grams = grams.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)))
            grams = grams.join(_by_units(below.select(F.col("gram").alias("end"), F.col("p").alias("lower")), k - 1, width), "end")
            lower = F.col("lower")
        own = lambda i: F.when(F.get("total", i) > 0, F.greatest(F.get("n", i) - F.get(discount, i), F.lit(0.0)) / F.get("total", i)).otherwise(0.0)  # noqa: E731, B023
        below = materialize(grams.select("gram", each(lambda i: own(i) + F.get("weight", i) * F.get(lower, i)).alias("p")))  # noqa: B023
        out.grams.append(below.select("gram", logs("p").alias("log_p")))
        out.contexts.append(contexts.select("context", logs("weight").alias("weight")))
    return replace(out, unseen=unseen)


def train(rows: DataFrame, max_cells: int = MAX_CELLS) -> Model:
    """Fit on ``rows`` (lang, text), lang not null; ``max_cells`` bounds the arrays, not the model."""
    counts = materialize(gram_counts(rows))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    most = max_cells // max(1, len(langs))
    level = F.floor(F.log2("n"))
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).agg(F.count("*")).collect()), reverse=True)
    least, held = 0, 0
    for depth, size in sizes:
        held += size
        if held > most:
            least = depth + 1
            break
    if least:
        tables = build_tables(langs, counts)
        frequent = counts.filter(level >= least).select("gram").distinct()
        found = tables.grams[-1].join(frequent.hint("merge"), "gram").toArrow()
        grams, order = HashArray.of(found.column("gram").to_numpy().view(np.uint64))
        log_p = found.column("log_p").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
        return Model(langs, [grams], [log_p[order].T.copy()], tables=tables, partial=True)
    found = counts.toArrow()
    numbers = np.searchsorted(np.array(langs), np.array(found.column("lang").to_pylist())) if langs and found.num_rows else np.zeros(0, np.int64)
    return build(langs, numbers, found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy())


def _spread(n: np.ndarray) -> np.ndarray:
    """How widely the entropy of texts of n units varies: with chance in short ones, with the subject in long ones."""
    return np.sqrt(1.0 / np.maximum(n, 1) + 0.01)


def _score(model: Model, entropies: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language, score and whether the text is accepted."""
    best = entropies.argmin(axis=1)
    low = entropies[np.arange(len(n)), best]
    sharp = model.sharpness * np.sqrt(np.maximum(n, 1))[:, None]
    score = 1.0 / np.exp(-np.minimum((entropies - low[:, None]) * sharp, 700)).sum(axis=1)
    accepted = n > 0
    if model.limit is not None:
        accepted &= low - model.mean[best] <= model.limit[best] * _spread(n)
    return best, score, accepted


def _with_rest(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """``docs`` with a column ``out``: per language the sum over the text's 4-grams that the model's arrays do not hold."""
    if model.tables is None:
        return docs.withColumn(out, F.lit(None).cast("array<double>"))
    shipped = model.shipped(docs.sparkSession)

    def missing(batches):
        for batch in slices(batches, "text", 2_000_000):
            keys = np.array(batch.column("key").to_pylist(), object)
            who, grams, times = shipped.value.absent([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(keys[who], pa.string()), pa.array(grams.view(np.int64)), pa.array(times, pa.int64())], ["key", "gram", "times"])

    key = F.md5(F.col(text).cast("string"))
    rows = docs.select(key.alias("key"), F.col(text).cast("string").alias("text")).filter(F.col("key").isNotNull())
    # equal texts bring equal rows
    found = materialize(rows.mapInArrow(missing, "key string, gram long, times long").groupBy("key", "gram").agg(F.first("times").alias("times")))
    values = materialize(model.tables.look_up(found.select("gram").distinct()))
    sums = [F.sum(F.col("times") * F.get("log_p", F.lit(i))) for i in range(len(model.langs))]
    name = fresh(docs, "key")
    rest = found.join(values.hint("merge"), "gram").groupBy(F.col("key").alias(name)).agg(F.array(*sums).alias(out))
    return docs.withColumn(name, key).join(rest.hint("merge"), name, "left").drop(name)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Fit sharpness and rejection on all of ``rows`` (lang, text), which the model has not counted."""
    shipped = model.shipped(rows.sparkSession)
    width = len(model.langs)

    def measure(batches):
        for batch in slices(batches, "text", 2_000_000):
            bits, n = shipped.value.entropies([t or "" for t in batch.column("text").to_pylist()], batch.column("rest").to_pylist())
            truth = np.searchsorted(np.array(shipped.value.langs), np.array(batch.column("lang").to_pylist()))
            at = np.arange(len(n))
            losses = []
            for sharpness in SHARPNESSES:
                x = -bits * sharpness * np.sqrt(n)[:, None]
                x -= x.max(axis=1, keepdims=True)
                losses.append(-(x[at, truth] - np.log(np.exp(x).sum(axis=1))))
            columns = [pa.array(truth, pa.int32()), pa.array(n), pa.array(bits[at, truth]), pa.array(_spread(n)), pa.array(list(np.stack(losses, axis=1)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", "own", "spread", "losses"])

    if not width:
        return model
    known = rows.filter(F.col("lang").isin(*model.langs)).select("lang", "text")
    found = _with_rest(known, model, "text", "rest").mapInArrow(measure, "i int, n long, own double, spread double, losses array<double>")
    found = materialize(found.filter("n > 0"))
    sums = [F.sum(F.get("losses", F.lit(k))) for k in range(len(SHARPNESSES))]
    means = found.groupBy("i").agg((F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("mean"), F.array(*sums).alias("loss")).collect()
    if not means:
        return model
    model.sharpness = SHARPNESSES[int(np.sum([r["loss"] for r in means], axis=0).argmin())]
    model.mean, model.limit = np.zeros(width), np.full(width, np.inf)
    for r in means:
        model.mean[r["i"]] = r["mean"]
    excess = (F.col("own") - F.get(F.lit(model.mean.tolist()), F.col("i"))) / F.col("spread")
    for i, largest in found.groupBy("i").agg(F.max(excess)).collect():
        model.limit[i] = SLACK * max(LEAST_EXCESS, largest)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` (lang, score, accepted)."""
    shipped = model.shipped(docs.sparkSession)

    @F.arrow_udf("lang string, score double, accepted boolean")
    def identify(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, rest in columns:
            at = 0
            lang, score, ok = [], np.zeros(len(column)), np.zeros(len(column), bool)
            batch = pa.RecordBatch.from_arrays([column, rest], ["text", "rest"])
            for part in slices([batch], "text", 2_000_000):
                bits, n = shipped.value.entropies([t or "" for t in part.column("text").to_pylist()], part.column("rest").to_pylist())
                if shipped.value.langs:
                    best, s, a = _score(shipped.value, bits, n)
                    lang += [shipped.value.langs[b] if m else UNDETERMINED for b, m in zip(best, n, strict=True)]
                    score[at : at + len(n)], ok[at : at + len(n)] = np.where(n > 0, s, 0.0), a
                else:
                    lang += [UNDETERMINED] * len(n)
                at += len(n)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], ["lang", "score", "accepted"])

    name = fresh(docs, f"{out}_rest")
    return _with_rest(docs, model, text, name).withColumn(out, identify(F.col(text).cast("string"), F.col(name))).drop(name)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 4 == 2


def fit_documents(docs: DataFrame) -> Model:
    """Model and calibration from the documents that are not held out and have a language."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("id"))
    picked = F.coalesce(F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(1_000_000)) < int(CALIBRATION_SHARE * 1_000_000), F.lit(False))
    return calibrate(train(rows.filter(~picked).select("lang", "text")), rows.filter(picked).select("lang", "text"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    name = fresh(docs, "language")
    found = predict(docs, fit_documents(docs), out=name)
    return found.filter(F.col(f"{name}.accepted")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.accepted")
