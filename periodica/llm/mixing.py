"""Sources mixed to target weights by iterative proportional fitting (raking).

Tokens are summed once per (source, language, topic); every value of a margin is raked on its own. Raking scales the
cells' inclusion probabilities to one margin after the other and holds them at 1 at most, until no margin moves; where
a margin has fewer tokens than its target, its cells end at 1 and the rest is the gap that :func:`rake` reports. A table
of at most ``CELL_ROWS`` cells and ``CELL_BYTES`` bytes of names is raked in one array and broadcast to the documents; a
larger one stays a table, is raked by the same steps as sums and joins (:func:`rake_table`) and joined by salted keys.
Both follow the same rule, so the size decides only where the steps run. Documents are then sampled by their cell's
probability with a uniform number made from doc_id, so a second run keeps the same documents.

A null source, language or topic is a value of its own (the empty string). A null text has no tokens; a cell without
tokens has probability 1. Rows that repeat a doc_id share its number and are kept or left together. Input columns keep
their values, also one named like an output of this module: :func:`sample` says under which name its result stands.
Everything is DataFrame work but for the fit of a bounded table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.llm.common import fresh, table
from periodica.session import materialize

#: Largest table of cells that is raked on the driver and sent to every executor.
CELL_ROWS, CELL_BYTES = 262_144, 32 * 1024 * 1024
#: Parts that the rows of one margin value or cell are dealt to where tables are joined.
SALTS = 32
#: Targets are the measured shares to this power, normalised: small sources gain, large ones lose.
TEMPERATURE = 0.85
#: Share of all tokens to keep.
BUDGET = 0.8
ROUNDS, TOLERANCE = 2000, 1e-10
MARGINS = ("source", "lang", "topic")


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """The topic by form, for corpora without a topic column."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("###")) | F.contains(t, F.lit("$$$")), "noise")
        .when(F.length(t) < 200, "short")
        .when(F.contains(t, F.lit("icense")), "legal")
        .otherwise("prose")
    )


@dataclass(frozen=True)
class Mixture:
    """Cells ``(source, lang, topic, tokens, probability)``, whether their size is bounded, and the gap left to the targets."""

    cells: DataFrame
    small: bool
    gap: float
    #: Shares by value per margin; None where the table of cells is not bounded.
    targets: tuple[dict[str, float], ...] | None = None


def rake(
    tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, float]:
    """Inclusion probabilities of cells with these tokens and the largest gap left to a margin's target, as a share.

    ``margins[k]`` numbers each cell's value in margin k, ``targets[k]`` are shares of the kept tokens. A target for a
    value without tokens cannot be met and counts in the gap.
    """
    total = tokens.sum()
    p = np.full(len(tokens), float(budget))
    if not total:
        return np.ones(len(tokens)), 0.0
    for _ in range(rounds):
        before = p.copy()
        for m, t in zip(margins, targets, strict=True):
            have = np.bincount(m, p * tokens, len(t))
            scale = np.divide(t * budget * total, have, out=np.ones(len(t)), where=have > 0)
            p = np.minimum(1.0, p * scale[m])
        if np.max(np.abs(p - before)) < tolerance:
            break
    gap = max(float(np.max(np.abs(np.bincount(m, p * tokens, len(t)) / (budget * total) - t))) for m, t in zip(margins, targets, strict=True))
    return np.where(tokens > 0, p, 1.0), gap


def tempered(shares: np.ndarray, temperature: float) -> np.ndarray:
    raised = np.where(shares > 0, shares, 0.0) ** temperature * (shares > 0)
    return raised / raised.sum() if raised.sum() else raised


def salted(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Left join of ``big`` to one row per key; rows of a key are dealt to ``SALTS`` parts by the columns of ``spread``."""
    name = fresh(big, "salt")
    copies = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [*keys, name], "left").drop(name)


def rake_table(full: DataFrame, goals: list[DataFrame], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """:func:`rake` for cells ``(source, lang, topic, tokens)`` of any number; ``goals[k]`` is ``(value, goal)`` of margin k."""
    total = float(full.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return full.withColumn("probability", F.lit(1.0)), 0.0
    cells = materialize(full.withColumn("before", F.lit(budget)).withColumn("p", F.lit(budget)))
    for _ in range(rounds):
        cells = cells.withColumn("before", F.col("p"))
        for name, goal in zip(MARGINS, goals, strict=True):
            have = cells.groupBy(name).agg(F.sum(F.col("p") * F.col("tokens")).alias("have")).join(goal.withColumnRenamed("value", name), name, "left")
            scale = F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) * (budget * total) / F.col("have")).otherwise(1.0)
            joined = salted(cells, have.select(name, scale.alias("scale")), [name], list(MARGINS))
            cells = materialize(joined.withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("scale"))).drop("scale"))
        if cells.agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0] < tolerance:
            break
    gaps = []
    for name, goal in zip(MARGINS, goals, strict=True):
        have = cells.groupBy(F.col(name).alias("value")).agg(F.sum(F.col("p") * F.col("tokens")).alias("have")).join(goal, "value", "full")
        gaps.append(have.agg(F.max(F.abs(F.coalesce("have", F.lit(0.0)) / (budget * total) - F.coalesce("goal", F.lit(0.0))))).first()[0])
    p = F.when(F.col("tokens") > 0, F.col("p")).otherwise(1.0)
    return cells.select(*MARGINS, "tokens", p.alias("probability")), float(max(gaps))


def _goal_table(full: DataFrame, name: str, wanted: dict[str, float] | None, temperature: float) -> DataFrame:
    """Normalised target shares ``(value, goal)`` of one margin; without ``wanted`` the tempered measured ones."""
    if wanted is not None:
        whole = sum(wanted.values())
        return full.sparkSession.createDataFrame([(v, float(g / whole if whole else g)) for v, g in wanted.items()], "value string, goal double")
    raised = materialize(full.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0").select("value", F.pow("t", F.lit(temperature)).alias("r")))
    return raised.select("value", (F.col("r") / F.lit(raised.agg(F.sum("r")).first()[0])).alias("goal"))


def fit_mixture(
    docs: DataFrame, tokens: Column, margins: tuple[Column, Column, Column], targets: tuple[dict[str, float], ...] | None = None,
    temperature: float = TEMPERATURE, budget: float = BUDGET,
) -> Mixture:
    """Rake the token table of ``docs``. ``targets`` gives shares by value for each margin; without it they are tempered."""
    named = [F.coalesce(m.cast("string"), F.lit("")).alias(n) for m, n in zip(margins, MARGINS, strict=True)]
    full = materialize(docs.select(*named, tokens.alias("t")).groupBy(*MARGINS).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tokens")))
    size = full.agg(F.count("*").alias("n"), F.sum(sum(F.octet_length(n) for n in MARGINS)).alias("bytes")).first()
    if size["n"] > CELL_ROWS or (size["bytes"] or 0) > CELL_BYTES:
        goals = [_goal_table(full, n, targets[k] if targets else None, temperature) for k, n in enumerate(MARGINS)]
        cells, gap = rake_table(full, goals, budget)
        return Mixture(cells, False, gap)
    rows = sorted((r[0], r[1], r[2], float(r[3])) for r in full.collect())
    x = np.array([r[3] for r in rows])
    numbers, goals, named_goals = [], [], []
    for k in range(3):
        wanted = targets[k] if targets else {}
        own = sorted({r[k] for r in rows} | set(wanted))
        place = {v: i for i, v in enumerate(own)}
        numbers.append(np.array([place[r[k]] for r in rows], np.int64))
        if targets:
            goal = np.array([float(wanted.get(v, 0.0)) for v in own])
            goal = goal / goal.sum() if goal.sum() else goal
        else:
            goal = tempered(np.bincount(numbers[k], x, len(own)) / max(x.sum(), 1), temperature)
        goals.append(goal)
        named_goals.append(dict(zip(own, goal.tolist(), strict=True)))
    p, gap = rake(x, numbers, goals, budget) if rows else (np.zeros(0), 0.0)
    schema = ", ".join(f"{n} string" for n in MARGINS) + ", tokens double, probability double"
    cells = docs.sparkSession.createDataFrame([(*r, float(q)) for r, q in zip(rows, p, strict=True)], schema)
    return Mixture(cells, True, gap, tuple(named_goals))


def uniform(doc_id: Column) -> Column:
    """A number from 0 to below 1 out of the 52 leading bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(16**13)


def sample(docs: DataFrame, mixture: Mixture, margins: tuple[Column, Column, Column], doc_id: str = "doc_id", out: str = "mix") -> DataFrame:
    """``docs`` with ``probability``, ``u`` and ``kept`` in one struct column ``out``; no row is left out.

    ``out`` must not be a column of ``docs``.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out!r} exists already")
    names = [fresh(docs, f"cell_{n}") for n in MARGINS]
    chance = fresh(docs, "cell_p")
    marked = docs.withColumns({c: F.coalesce(m.cast("string"), F.lit("")) for c, m in zip(names, margins, strict=True)})
    found = mixture.cells.select(*[F.col(n).alias(c) for n, c in zip(MARGINS, names, strict=True)], F.col("probability").alias(chance))
    # ids may be null or repeated, so texts help to deal rows out
    spread = [doc_id, *[c for c, t in docs.dtypes if t == "string" and c != doc_id]]
    joined = marked.join(F.broadcast(found), names, "left") if mixture.small else salted(marked, found, names, spread)
    p, u = F.coalesce(F.col(chance), F.lit(1.0)), uniform(F.col(f"`{doc_id}`"))
    mixed = joined.withColumn(out, F.struct(p.alias("probability"), u.alias("u"), (u < p).alias("kept")))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], out)


def _document_margins() -> tuple[Column, Column, Column]:
    return F.col("source"), F.col("lang"), form_topic(F.col("text"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The sampled rows of ``docs`` under tempered targets."""
    margins = _document_margins()
    mixture = fit_mixture(docs, word_tokens(F.col("text")), margins)
    name = fresh(docs, "mix")
    return sample(docs, mixture, margins, out=name).filter(f"`{name}`.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its margins, tokens, probability and whether it is sampled."""
    docs = table(spark, sf_dir, "documents")
    margins, tokens = _document_margins(), word_tokens(F.col("text"))
    out = sample(docs, fit_mixture(docs, tokens, margins), margins)
    return out.select("doc_id", "source", "lang", margins[2].alias("topic"), tokens.alias("n_tokens"), "mix.probability", "mix.u", "mix.kept")
