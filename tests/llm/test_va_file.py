"""Vector-approximation files against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.llm import va_file


def brute(rows, every=20, k=20):
    kept, queries = [], {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(64 * x) for x in v]
        kept.append((i, v))
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumn("id", F.lit("x")).withColumn("score", F.lit(0)).repartition(3)
    return sorted(tuple(r) for r in va_file.top_k(df, **options).collect())


def some(n, width=12, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, spread, width)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"k": 3, "cells": 4}, {"query_rows": 5}, {"fit_rows": 1}])
def test_equals_brute_force(spark, options, monkeypatch):
    rows = some(700)
    monkeypatch.setattr(va_file, "BLOCK_ROWS", 64)
    assert run(spark, rows, **options) == brute(rows, k=options.get("k", 20))


def test_ties_and_repeats(spark):
    rows = some(30) + [(i, [0.5] * 12) for i in range(100, 400)] + [(40, [1.0] * 12), (40, [0.9] * 12)]
    rows += [(60, [0.5] * 12)] * 3
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (20, [1.0]), (40, []), (1, None), (None, [1.0, 1.0]), (3, [1.0, None]),
        (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (5, [0.0, -3.5]), (6, [2.0, 2.0, 7.0]),
    ]
    assert run(spark, rows) == brute(rows)


def test_large_values(spark):
    rows = [(i, [float(10 ** (i % 7)), -float(3 ** i), 1.0]) for i in range(0, 12)]
    rows += [(20, [1e6, 1e5, 3.0]), (40, [-1e6, 5e5, 2.0])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(20, [1.0])]) == []


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in va_file.top_k(df).collect()) == brute(rows)
