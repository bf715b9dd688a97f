"""Raking against a plain iteration, clashing names and values; which texts have a language at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import langid, mixing

DOCS = "doc_id long, text string, lang string, source string"


def plain_rake(cells, shares, budget):
    """Scale a dictionary of cells to each margin in turn, held at one."""
    total = sum(cells.values())
    p = dict.fromkeys(cells, budget)
    for _ in range(3000):
        for k, goal in enumerate(shares):
            have = {}
            for c, t in cells.items():
                have[c[k]] = have.get(c[k], 0.0) + p[c] * t
            p = {c: min(1.0, q * goal[c[k]] * budget * total / have[c[k]]) if have[c[k]] else q for c, q in p.items()}
    return p


def corpus(spark):
    rng = np.random.default_rng(40)
    rows = [(i, "word " * int(rng.integers(1, 90)), ["en", "de", None][int(rng.integers(0, 3))], f"src{min(int(rng.exponential(1.5)), 5)}") for i in range(400)]
    rows += [(7, None, "en", "src0"), (7, "", None, None), (None, "a b", "en", "*"), (500, "x y z", "b\x1fen", "a"), (501, "x y", "en", "a\x1fb")]
    return spark.createDataFrame(rows, DOCS)


def test_probabilities_equal_plain_raking(spark):
    docs = corpus(spark)
    margins, tokens = mixing._document_margins(), mixing.word_tokens(F.col("text"))
    mixture = mixing.fit_mixture(docs, tokens, margins)
    out = mixing.sample(docs, mixture, margins).withColumn("n", tokens).withColumn("topic", margins[2]).collect()
    assert len(out) == docs.count()
    cells = {}
    for r in out:
        c = (r.source or "", r.lang or "", r.topic)
        cells[c] = cells.get(c, 0) + r.n
    total = sum(cells.values())
    shares = []
    for k in range(3):
        part = {}
        for c, t in cells.items():
            part[c[k]] = part.get(c[k], 0) + t / total
        raised = {v: s**mixing.TEMPERATURE if s > 0 else 0.0 for v, s in part.items()}
        shares.append({v: s / sum(raised.values()) for v, s in raised.items()})
    want = plain_rake(cells, shares, mixing.BUDGET)
    for r in out:
        c = (r.source or "", r.lang or "", r.topic)
        assert r.mix.probability == pytest.approx(want[c] if cells[c] else 1.0, abs=1e-4)
        assert r.mix.kept == (r.mix.u < r.mix.probability)


def test_every_value_is_raked_on_its_own(spark):
    """Far more values of a margin than fit a short list, each brought to its own target."""
    rng = np.random.default_rng(41)
    rows = [(i, "w " * int(rng.integers(50, 90)) + "x" * 200, "en" if i // 150 % 3 else "de", f"s{i % 150}") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    goal = {f"s{i}": 1.0 + i / 150 for i in range(150)}
    mixture = mixing.fit_mixture(docs, mixing.word_tokens(F.col("text")), mixing._document_margins(), (goal, {"en": 0.6, "de": 0.4}, {"prose": 1.0}), budget=0.3)
    kept = {r[0]: r[1] for r in mixture.cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability"))).collect()}
    total = sum(kept.values())
    assert len(kept) == 150 and mixture.gap < 1e-6
    for v, g in goal.items():
        assert kept[v] / total == pytest.approx(g / sum(goal.values()), abs=1e-6)


@pytest.mark.parametrize("given", [False, True])
def test_a_table_of_cells_is_raked_alike(spark, monkeypatch, given):
    """The same steps as sums and joins; the join of documents by salted keys."""
    docs, margins, tokens = corpus(spark), mixing._document_margins(), mixing.word_tokens(F.col("text"))
    targets = ({"src0": 0.2, "src1": 0.7, "gone": 0.1}, {"en": 0.5, "de": 0.5}, {"prose": 0.5, "short": 0.5}) if given else None
    monkeypatch.setattr(mixing.rake, "__defaults__", (2, 0.0))
    monkeypatch.setattr(mixing.rake_table, "__defaults__", (2, 0.0))
    small = mixing.fit_mixture(docs, tokens, margins, targets)
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    large = mixing.fit_mixture(docs, tokens, margins, targets)
    assert small.small and not large.small and large.gap == pytest.approx(small.gap, rel=1e-9)

    def drawn(mixture):
        out = mixing.sample(docs, mixture, margins).select("doc_id", "text", "source", "lang", "mix.probability")
        return sorted(((r[0] or -1, r[1] or "", r[2] or "", r[3] or ""), r[4]) for r in out.collect())

    a, b = drawn(small), drawn(large)
    assert [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-9)


def test_names_and_values_that_clash(spark):
    docs = corpus(spark).withColumn("mix", F.lit("mine")).withColumn("cell", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = mixing.mix_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert 0 < len(rows) <= docs.count() and {(r["mix"], r["cell"], r["a.b"]) for r in rows} == {("mine", 1, 2)}
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.sample(docs, mixing.fit_mixture(docs, F.lit(1), mixing._document_margins()), mixing._document_margins())


def test_given_targets(spark):
    docs = corpus(spark)
    margins = mixing._document_margins()
    mixture = mixing.fit_mixture(docs, mixing.word_tokens(F.col("text")), margins, ({"src0": 0.2, "src1": 0.8, "gone": 0.0}, {"en": 1.0}, {"prose": 0.5, "short": 0.5}), budget=0.1)
    assert mixture.targets[0]["src1"] == pytest.approx(0.8) and mixture.targets[1]["en"] == pytest.approx(1.0)


@pytest.mark.parametrize("text", [None, "", " \n", "123 !?", "\U0001f600\U0001f680", "́̀", "́ 9 \U0001f600"])
def test_texts_without_a_letter(spark, text):
    rows = [(i, t, lang) for i in range(30) for lang, t in (("en", "the quick word and the other"), ("es", "la palabra que con el otro"))]
    model = langid.train(spark.createDataFrame([(lang, t) for _, t, lang in rows], "lang string, text string"))
    docs = spark.createDataFrame([(1, text), (2, "the other word"), (3, "la otra \U0001f600 palabra")], "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {r.doc_id: r.language for r in langid.predict(docs, model).collect()}
    assert got[1].lang == "und" and got[1].score == 0.0 and not got[1].accepted
    assert got[2].lang == "en" and got[3].lang == "es"


def test_letters_beyond_the_first_plane():
    gothic = "\U00010330\U00010331"
    assert langid.lettered(gothic) == gothic and langid.lettered("a\U0001f600b") == "a b" and langid.lettered("é") == "é"


def sentences(spark):
    rng = np.random.default_rng(42)
    words = {lang: ["".join(rng.choice(list(letters), int(rng.integers(1, 7)))) for _ in range(40)] for lang, letters in (("a", "abcde"), ("b", "cdefg語"), ("c", "éabgh\U00010330"))}
    rows = [(lang, " ".join(rng.choice(own, int(rng.integers(1, 25))))) for lang, own in words.items() for _ in range(60)]
    odd = [None, "", "42", "zzzz qqqq", "語語 abc", "abcde zq", "\U00010330x", rows[0][1] + " zq", "e"]
    docs = [(i, t, "x") for i, t in enumerate([t for _, t in rows[::3]] + odd + odd)] + [(None, rows[0][1], None)]
    return spark.createDataFrame(rows, "lang string, text string"), spark.createDataFrame(docs, "key long, text string, rest string")


@pytest.mark.parametrize("cells", [3, 600])
def test_rare_grams_count_beyond_the_arrays(spark, cells):
    """More 4-grams than the arrays may hold: the same probabilities, entropies and answers as with arrays of all."""
    rows, docs = sentences(spark)
    whole, split = langid.train(rows), langid.train(rows, cells)
    held = split.log_p[-1].size
    assert whole.tables is None and held <= cells < whole.log_p[-1].size
    limits = [langid.calibrate(m, rows) for m in (whole, split)]
    assert limits[0].sharpness == limits[1].sharpness and limits[1].limit == pytest.approx(limits[0].limit, rel=1e-5)
    order = lambda r: (r.key is None, r.key or 0)
    want, got = (sorted(langid.predict(docs, m).collect(), key=order) for m in limits)
    assert [r[:3] for r in want] == [r[:3] for r in got]
    for a, b in zip(want, got, strict=True):
        assert (a.language.lang, a.language.accepted) == (b.language.lang, b.language.accepted)
        assert b.language.score == pytest.approx(a.language.score, abs=1e-5)
    texts = [r.text or "" for r in want]
    sums = {r.key: r.own for r in langid._with_rest(docs, split, "text", "own").collect()}
    bits, n = split.entropies(texts, [sums[r.key] for r in want])
    assert (n == whole.entropies(texts)[1]).all() and bits == pytest.approx(whole.entropies(texts)[0], abs=1e-4)


def test_calibration_takes_its_whole_share(spark, monkeypatch):
    """A tenth of 41,000 documents is over 4,000: all of them calibrate, and the others are counted."""
    rows = spark.range(0, 58_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("ab").alias("text"))
    seen = {}
    monkeypatch.setattr(langid, "train", lambda r: seen.setdefault("counted", r.count()))
    monkeypatch.setattr(langid, "calibrate", lambda m, r: seen.setdefault("calibrated", r.count()))
    langid.fit_documents(rows)
    labelled = rows.filter(~langid.held_out(F.col("doc_id"))).count()
    assert seen["counted"] + seen["calibrated"] == labelled > 41_000
    assert seen["calibrated"] == pytest.approx(labelled / 10, rel=0.05) and seen["calibrated"] > 4_000


def test_calibration_by_sums(spark):
    """Mean, limit and sharpness as of all rows at once; a language without a row here is never rejected."""
    rows, _ = sentences(spark)
    model = langid.train(rows)
    part = rows.filter("lang != 'c'").union(spark.createDataFrame([("a", None), ("b", "42"), ("a", "gggg"), ("gone", "abc")], "lang string, text string"))
    fitted = langid.calibrate(model, part)
    texts = [(r.lang, r.text) for r in part.collect() if r.lang in "ab" and r.text and r.text != "42"]
    bits, n = model.entropies([t for _, t in texts])
    truth = np.array(["abc".index(lang) for lang, _ in texts])
    losses = []
    for sharpness in langid.SHARPNESSES:
        x = -bits * sharpness * np.sqrt(n)[:, None]
        losses.append((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(n)), truth]).sum())
    assert fitted.sharpness == langid.SHARPNESSES[int(np.argmin(losses))]
    for i in range(2):
        own, units = bits[truth == i, i], n[truth == i]
        mean = np.average(own, weights=units)
        assert fitted.mean[i] == pytest.approx(mean)
        assert fitted.limit[i] == pytest.approx(langid.SLACK * max(langid.LEAST_EXCESS, ((own - mean) / langid._spread(units)).max()))
    assert np.isinf(fitted.limit[2])
