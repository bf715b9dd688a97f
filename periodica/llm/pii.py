"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates are the base spans (strict patterns and checks) and wider ones: matches that fail a check, national phone
numbers without ``+``, and e-mail addresses written with "at" and "dot". Five labelers vote for, against or not at all
on each: the strict pattern, a gazetteer (top-level domains, country calling codes, card issuers, private networks),
context words before the span, check arithmetic, and the regularity of its layout. Spark counts the distinct vote
patterns of all documents (at most ``3 ** 5`` for each kind and shape); expectation-maximisation on this table
estimates how reliable every labeler is for every kind, and a logistic span classifier over votes and shape is trained
on the posteriors, weighted by the counts. A wider span is added where the classifier gives ``THRESHOLD`` or more and
it overlaps no base span. Base spans always stay.

A null text is empty and has no spans; every row is a document, repeated ones too, also with a null id. An empty table
gives no rows. Extra columns are ignored. Patterns are matched in linear time on texts of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm.common import slices, table
from periodica.session import materialize

KINDS = ("email", "ip", "card", "phone")
N_LABELERS = 5
THRESHOLD = 0.95
CONTEXT = 40
ROUNDS, TOLERANCE = 200, 1e-9

# fixed values: base patterns of the contract
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match always begins and ends with a whole run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# fixed values: wider patterns and the gazetteer
NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?[\[(]dot[\])][\x20]?[A-Za-z]{2,24}){1,4}")
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at eu us ca au jp cn in br ru pl se no fi dk pt".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
FOR = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|address|host|server|adresse|login|from)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|payment)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone|whatsapp)\b", re.I),
}
AGAINST = re.compile(r"\b(version|v|release|isbn|issn|order|invoice|serial|page|figure|section|part|model|sku)[\s.:#]*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ on; every character is looked at a bounded number of times."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the check holds) of every match of a base pattern."""
    for s, e in emails(text):
        yield "email", s, e, True
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        yield "ip", *m.span(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 64 else ""
        yield "card", *m.span(), 14 <= len(d) <= 19 and luhn(d)
    for m in PHONE.finditer(text):
        yield "phone", *m.span(), 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15


def _for(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes(text: str, kind: str, s: int, e: int, base: bool) -> tuple[int, ...]:
    """The five votes on a span: 1 for, -1 against, 0 none."""
    span, before = text[s:e], text[max(0, s - CONTEXT) : s]
    d = _digits(span)
    if kind == "email":
        last = re.split(r"[.\s\])]+", span.rstrip(")] "))[-1].lower()
        listed, sums, regular = _for(last in DOMAINS, last.isdigit()), _for(".." not in span, True), _for(re.match(r"[A-Za-z0-9]", span) is not None, True)
    elif kind == "ip":
        parts = [int(p[-4:]) for p in span.split(".")]
        listed = _for(max(parts) <= 255 and parts[0] not in (0, 127, 255), parts[0] == 0)
        sums, regular = _for(max(parts) <= 255, True), _for(all(p == "0" or p[0] != "0" for p in span.split(".")), True)
        regular = -1 if text[e : e + 1] == "." and text[e + 1 : e + 2].isdigit() else regular
    elif kind == "card":
        listed, sums = _for(d.startswith(ISSUERS), d.startswith("0")), _for(luhn(d), True)
        groups = [len(g) for g in re.split(r"[\x20-]", span)]
        regular = _for(len(groups) == 1 or set(groups[:-1]) == {4} or groups == [4, 6, 5], True)
    else:
        listed = _for(span.startswith("+") and d.startswith(CALLING), len(set(d)) <= 2)
        sums, regular = _for(10 <= len(d) <= 15, True), _for(span.count("(") == span.count(")") and not re.search(r"[\x20.-]{2}", span.replace(") ", ")")), True)
    return (1 if base else 0, listed, _for(FOR[kind].search(before) is not None, AGAINST.search(before) is not None), sums, regular)


def _pattern(text: str, kind: str, s: int, e: int, base: bool) -> int:
    """Votes and shape as one number: five digits to base 3, then whether the span stands alone and whether it has letters."""
    number = 0
    for v in votes(text, kind, s, e, base):
        number = number * 3 + v + 1
    alone = not (text[s - 1 : s].isalnum() if s else False) and not text[e : e + 1].isalnum()
    return number * 4 + 2 * alone + any(c.isalpha() for c in text[s:e][:64])


def unpack(pattern: int) -> np.ndarray:
    """Votes and the two shape bits of a pattern number."""
    rest, out = pattern // 4, []
    for _ in range(N_LABELERS):
        out.append(rest % 3 - 1)
        rest //= 3
    return np.array([*reversed(out), pattern // 2 % 2, pattern % 2])


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind number, end, base, pattern) of base and wider spans, by start and kind."""
    out, base = [], []
    for kind, s, e, ok in base_matches(text):
        if ok:
            base.append((s, e))
            out.append((kind, s, e, True))
        elif kind == "ip" and e - s <= 19 or kind == "card" and 14 <= sum(c.isdigit() for c in text[s : min(e, s + 64)]) <= 19 and e - s < 40 or kind == "phone" and e - s < 32:
            out.append((kind, s, e, False))
    out += [("phone", *m.span(), False) for m in NATIONAL.finditer(text)]
    out += [("email", *m.span(), False) for m in SPELLED.finditer(text)]
    base.sort()
    starts = [s for s, _ in base]
    reach = np.maximum.accumulate([e for _, e in base]) if base else []

    def free(s, e):
        i = np.searchsorted(starts, e)
        return i == 0 or reach[i - 1] <= s

    rows = [(s, KINDS.index(kind), e, ok, _pattern(text, kind, s, e, ok)) for kind, s, e, ok in out if ok or free(s, e)]
    return sorted(rows)


def estimate(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Posterior of each vote pattern by EM: labelers are independent given truth, each with its own reliability per kind."""
    v = np.array([unpack(p)[:N_LABELERS] for p in pattern]).reshape(-1, N_LABELERS)
    post = np.where(v[:, 0] == 1, 0.9, np.clip(0.3 + 0.1 * v[:, 1:].sum(axis=1), 0.05, 0.8))
    for _ in range(ROUNDS):
        log = np.zeros((len(n), 2))
        for k in np.unique(kind):
            mine = kind == k
            for truth, p in ((0, 1 - post), (1, post)):
                w = (n * p)[mine]
                log[mine, truth] = np.log((w.sum() + 1) / (n[mine].sum() + 2))
                for j in range(N_LABELERS):
                    # a little is known beforehand: labelers are right more often than wrong
                    counts = np.array([w[v[mine, j] == x].sum() for x in (-1, 0, 1)]) + ((1.0, 2.0, 4.0) if truth else (4.0, 2.0, 1.0))
                    log[mine, truth] += np.log(counts / counts.sum())[v[mine, j] + 1]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < TOLERANCE:
            break
    return post


def features(kind: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    x = np.array([unpack(p) for p in pattern], float).reshape(-1, N_LABELERS + 2)
    return np.hstack([x[:, 1:], np.eye(len(KINDS))[kind]])  # without the strict pattern itself, so that it speaks of others too


def train(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, Newton steps with a small ridge."""
    x, y = features(kind, pattern), estimate(kind, pattern, n)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) + w)
        size = np.abs(step).max(initial=0)
        w -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w


def find_candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): every document's candidate spans with their vote patterns."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("kind", pa.int32()), ("e", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())]))

    def run(batches):
        for batch in slices(batches, "text", 4_000_000):
            found = [candidates(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, found array<struct<s: long, kind: int, e: long, base: boolean, pattern: int>>"
    return rows.mapInArrow(run, schema)


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, found): base spans and those the classifier adds, each (s, kind, e, base, score)."""
    held = materialize(find_candidates(docs, doc_id, text))
    counts = held.select(F.explode("found").alias("f")).groupBy("f.kind", "f.pattern").agg(F.count("*").alias("n")).collect()
    kind, pattern, n = (np.array([r[i] for r in counts], np.int64) for i in range(3))
    scores: dict[tuple[int, int], float] = {}
    if counts:
        p = 1 / (1 + np.exp(-np.clip(features(kind, pattern) @ train(kind, pattern, n.astype(float)), -500, 500)))
        scores = {(int(a), int(b)): float(c) for a, b, c in zip(kind, pattern, p, strict=True)}
    out = pa.list_(pa.struct([("s", pa.int64()), ("kind", pa.int32()), ("e", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def decide(batches):
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                scored = [x | {"score": scores[x["kind"], x["pattern"]]} for x in found or []]
                rows.append([{k: x[k] for k in ("s", "kind", "e", "base", "score")} for x in scored if x["base"] or x["score"] >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, out)], ["doc_id", "found"])

    schema = f"doc_id {held.schema['doc_id'].dataType.simpleString()}, found array<struct<s: long, kind: int, e: long, base: boolean, score: double>>"
    return held.mapInArrow(decide, schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))
    base = F.filter("found", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, one), ",")
    counts = [F.coalesce(F.regexp_count(joined(base), F.lit(f"{name}:")), F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def brute_force(text: str) -> tuple[list[int], str]:
    """Counts per kind and the digest of the base spans by the plain patterns; for tests."""
    spans = []
    plain = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", CARD.pattern, PHONE.pattern)
    for k, pattern in enumerate(plain):
        for m in re.finditer(pattern, text):
            d = _digits(m[0])
            if k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                spans.append((m.start(), k, m.end()))
    spans.sort()
    digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    return [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))], digest
