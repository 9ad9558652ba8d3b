"""Context mixing: probabilities, base scores, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regatta.llm import common
from regatta.llm import context_mixing as cm
from regatta.llm import queries

TEXTS = [
    None, "", " \n", "one", "One two  three", "é 🙂 x", "a" * 5000, "the cat sat on the mat " * 300,
    "one", "x\x00y \x1f", "ONE\ttwo",
]


def joined(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(words)).encode() + b"\n"


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    code = cm.Code(rng.integers(0, 100, 256))
    return cm.Model(code, [rng.integers(-60, 60, r * cm.COLUMNS).astype(np.int8) for r in cm.ROWS])


def test_joined_bytes():
    for part in (TEXTS, TEXTS[:1], TEXTS[3:5]):
        text, limits, _ = cm.joined_bytes(pa.array(part, pa.string()))
        got = [text[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])]
        assert got == [joined(t) for t in part]


def test_code_is_a_tree():
    code = cm.Code(np.arange(256) ** 2)
    assert sum(2.0 ** -int(s) for s in code.sizes) == 1.0
    counts = np.random.default_rng(1).integers(0, 9, (3, 256))
    low, high = code.node_counts(counts)
    for symbol in (0, 17, 255):
        path = slice(code.starts[symbol], code.starts[symbol + 1])
        nodes, turns = code.nodes[path], code.turns[path]
        one = np.zeros((1, 256))
        one[0, symbol] = 1
        a, b = code.node_counts(one)
        assert set(np.flatnonzero(a + b)) == set(nodes)
        assert all((b if t else a)[0, n] == 1 for n, t in zip(nodes, turns))
    assert (low + high)[:, code.nodes[0]].tolist() == counts.sum(axis=1).tolist()


def test_probabilities_of_what_may_follow_add_up():
    """Whatever came before, the probabilities of all next bytes sum to one."""
    model = small_model()
    for before in (b"", b"ab c", b"q" * (cm.STEP + 3), b"z y" * (cm.SEGMENT // 3) + b"x"):
        limits = np.arange(257) * (len(before) + 1)
        text = np.frombuffer(b"".join(before + bytes([k]) for k in range(256)), np.uint8)
        whole = model._bits(text, limits)
        start = 0.0
        if before:
            start = model._bits(np.frombuffer(before, np.uint8), np.array([0, len(before)]))[0]
        assert np.exp2(start - whole).sum() == pytest.approx(1, abs=1e-3)


def test_scores_do_not_depend_on_neighbours():
    model = small_model(3)
    together = model.score(pa.array(TEXTS, pa.string()))[0]
    alone = [model.score(pa.array([t], pa.string()))[0][0] for t in TEXTS]
    assert together == pytest.approx(alone, rel=1e-6)


def base(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for _, t in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(i), h, len(ws), sum(counts[w] > 0 for w in ws), n,
         round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
        for (i, _), ws, h in zip(rows, words, held)
    )


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.select("doc_id", queries.held_out(10, 0).alias("held_out"), "text")
    return cm.score(docs, cm.train(docs.where(~F.col("held_out")))).collect()


def test_base_scores(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["aa", "B", "b", "c,", "dd", "é"], k=rng.randrange(30)))) for i in range(80)]
    rows += list(enumerate(TEXTS)) + [(None, "one two"), (3, "one")]
    got = run(spark, rows)
    assert sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
    ) == base(rows)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert sorted(r.n_bytes for r in got) == sorted(len(joined(t)) for _, t in rows)


def test_empty(spark):
    assert run(spark, []) == []
    one = run(spark, [(None, None)])[0]
    assert (one.n_tokens, one.n_bytes) == (1, 1)


def test_table(spark, sf):
    rows = queries.QUERIES["op6_context_mixing"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 60 < len(held) < 140
    assert sum(r.bits_per_byte * r.n_bytes for r in held) / sum(r.n_bytes for r in held) < 3
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_training_counts_are_sent_in_slices(spark):
    """A row for each slice and task, not one for each cell, with every byte counted once in each table."""
    docs = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(2)
    classes = cm.Code(np.arange(256)).classes
    rows = cm._cells(docs, classes).collect()
    assert len(rows) <= 2 * (-(-cm.CELLS // cm._SLICE))
    counts = np.zeros(-(-cm.CELLS // cm._SLICE) * cm._SLICE, np.int64)
    for r in rows:
        cells = np.cumsum(cm._numbers(r["cells"]), dtype=np.int64)
        assert (cells < cm._SLICE).all()
        counts[r["slice"] * cm._SLICE + cells] += cm._numbers(r["counts"])
    text, limits, _ = cm.joined_bytes(pa.array(TEXTS, pa.string()))
    want, base = np.zeros_like(counts), 0
    for size, found in zip(cm.ROWS, cm.context_rows(text, limits)):
        np.add.at(want, base + found * cm.COLUMNS + classes[text], 3)
        base += size * cm.COLUMNS
    assert np.array_equal(counts, want)


def test_numbers_by_planes_and_hashes_of_beginnings():
    numbers = np.array([0, 1, 255, 256, 2**31 + 7, 2**32 - 1], np.int64)
    assert cm._numbers(cm._planes(numbers)).tolist() == numbers.tolist()
    data = np.random.default_rng(5).integers(0, 256, 500).astype(np.uint8)
    opens = np.array([0, 1, 40, 41, 499])
    start = np.repeat(opens, np.diff(opens, append=500))
    assert np.array_equal(common.prefix_hashes(data, opens), common.spans_hash(data, start, np.arange(500)))
