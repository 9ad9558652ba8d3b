"""Exact copies against grouping in plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from regatta.llm import exact_copies


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        name = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            out.append([i, keep, len(ids), False, name])
        next(r for r in out if r[4] == name and r[0] == keep)[3] = True
    return sorted(map(tuple, out), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumn("digest", F.lit("x")).withColumn("keep_id", F.lit(None)).withColumn("n", F.lit(0))
    got = exact_copies.copies(docs, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


ROWS = [
    (1, "a b"), (2, "a  b"), (3, "a\t\nb"), (4, "A b"), (5, None), (6, ""), (7, " "), (8, "\n \r"), (9, "ab"),
    (10, "a b"), (11, "a b "), (None, "a b"), (None, None), (None, "only here"), (None, "only here"),
    (12, "é x"), (0, "é\vx"), (2, "a b"), (2, "a b"), (1, "a b"), (13, "long " * 50_000), (14, "long \t" * 50_000),
]


@pytest.mark.parametrize("digest", [
    exact_copies.digest128,
    lambda text: F.unhex(F.hex(F.length(text))),
    lambda text: F.when(F.length(text) == 3, F.unhex(F.lit("00"))).otherwise(exact_copies.digest128(text)),
    lambda text: F.unhex(F.lit("FF")),
])
def test_equals_plain_version(spark, digest):
    assert run(spark, ROWS, digest=digest) == plain(ROWS)


def test_large_groups(spark):
    draw = random.Random(5)
    rows = [(k, "common text" if k % 3 == 0 else f"text {draw.randrange(900)}") for k in range(3_000)]
    assert run(spark, rows) == plain(rows)


def test_repeats_in_lots(spark, monkeypatch):
    monkeypatch.setattr(exact_copies, "REPEATS", 4)
    rows = [(7, "x")] * 4 + [(8, "x")] * 9 + [(9, "y")] * 5 + [(9, "z")]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
