"""Kneser-Ney toxicity: definition, held-out accuracy and odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regatta.llm import queries, toxicity


def plain_ratio(word, words, ordinary, toxic, order):
    """The definition, letter by letter."""
    def signed(w):
        return b"\x01" + w.lower() + b"\x02"

    def levels(weights, k):
        grams, contexts = {}, {}
        for w, n in zip(words, weights):
            s = signed(w)
            for i in range(max(1, k - 1), len(s)):
                g = s[i - k + 1:i + 1]
                grams[g] = grams.get(g, 0) + n
        grams = {g: n for g, n in grams.items() if n}
        for g, n in grams.items():
            a, b = contexts.get(g[:-1], (0, 0))
            contexts[g[:-1]] = (a + n, b + 1)
        return grams, contexts

    def p(level, g, lower, d=toxicity.DISCOUNT):
        grams, contexts = level
        if g[:-1] not in contexts:
            return lower
        n, kinds = contexts[g[:-1]]
        return max(grams.get(g, 0) - d, 0) / n + min(1, d * kinds / n) * lower

    shared = [levels([1] * len(words), k) for k in range(1, order)]
    classes = [levels(c, order) for c in (ordinary, toxic)]
    s, total = signed(word), 0.0
    for i in range(1, len(s)):
        lower = 1 / 256
        for k, level in enumerate(shared, 1):
            if i >= k - 1:
                lower = p(level, s[i - k + 1:i + 1], lower)
        if i >= order - 1:
            g = s[i - order + 1:i + 1]
            total += math.log(p(classes[1], g, lower)) - math.log(p(classes[0], g, lower))
    return total


def model_of(words, ordinary, toxic, order=toxicity.ORDER):
    counts = np.stack([ordinary, toxic], axis=1)
    return toxicity.SpellingModel(toxicity.gram_counts(words, counts, order))


def fitted(rows, *options):
    return toxicity.fit(rows.select("id", "text"), rows.select("id", "label"), *options)


def test_definition():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 9))).encode() for _ in range(80)})
    ordinary = np.array([rng.randrange(4) for _ in words])
    toxic = np.array([rng.randrange(4) for _ in words])
    for order in (2, 3, 4):
        model = model_of(words, ordinary, toxic, order)
        for text in ("abca", "ABCa dd\n zz", "a, bcd; é", "", None, "-"):
            want = [
                plain_ratio(w.encode(), words, ordinary, toxic, order)
                for w in (text or "").lower().replace(",", "").replace(";", "").replace("-", "").split()
            ]
            want = sum(want) / max(1, len(want))
            for _ in range(2):
                got = model.differences(pa.array(["dcba", text], pa.string()))[1]
                assert got == pytest.approx(want, abs=1e-9)


def test_long_words_are_cut():
    model = model_of([b"ab", b"x" * 64], np.array([1, 2]), np.array([3, 1]))
    long = model.differences(pa.array(["x" * 640 + " " + "ab" * 100_000, "x" * 64], pa.string()))
    parts = model.differences(pa.array(["x" * 64], pa.string()))
    assert np.isfinite(long).all() and long[1] == parts[0]


def test_calibration_rises():
    rng = np.random.default_rng(0)
    d = np.round(rng.normal(size=400), 1)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * d))).astype(int)
    knots = toxicity.calibration(d, y)
    s = toxicity.calibrated(np.linspace(-9, 9, 200), knots)
    assert (np.diff(s) > 0).all() and s[0] >= 0 and s[-1] <= 1
    assert toxicity.calibrated(np.zeros(1), toxicity.calibration(np.zeros(0), np.zeros(0)))[0] == 0.5


def labelled(n=1200, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=40)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["Scumbag", "idiotic", "vermin"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled()
    train = spark.createDataFrame(rows[:1000], "id long, text string, label int")
    odd = [(None, None, 0), (1, "", 1), (2, "x", None), (3, "y", 7)]
    train = train.unionByName(spark.createDataFrame(odd, train.schema))
    known = fitted(train)
    test = spark.createDataFrame(
        [(i, t, "z") for i, t, _ in rows[1000:]] + [(None, None, "z"), (7, "", "z")],
        "id long, text string, score string",
    )
    got = {r.id: r.score for r in toxicity.score(test, known).collect()}
    assert got[None] == got[7] and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.7) == bool(y) for i, _, y in rows[1000:]]
    assert sum(right) >= 0.97 * len(right), sum(right) / len(right)
    assert not any(got[i] >= 0.7 for i, _, y in rows[1000:] if not y)


def test_layout_does_not_matter(spark):
    train = spark.createDataFrame(labelled(200), "id long, text string, label int")
    a, b = (fitted(train.repartition(n), 150) for n in (1, 5))
    texts = pa.array([t for _, t, _ in labelled(20, 9)])
    assert np.array_equal(a.scores(texts), b.scores(texts))


def test_no_labels(spark):
    none = spark.createDataFrame([], "id long, text string, label int")
    known = fitted(none)
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert {r.score for r in toxicity.score(docs, known).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), known).collect() == []


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_kneser_ney_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    s, y = (np.array(x) for x in zip(*rows))
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.8
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where(F.col("predicted") != (F.col("score") >= 0.7).cast("int")).count() == 0
