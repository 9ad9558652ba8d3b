"""Wu-Manber search against a plain one."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from regatta.llm import wu_manber

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    words = {}
    for name, text in items:
        if name is not None and WORD.findall(lower(text)):
            words.setdefault(name, []).append(WORD.findall(lower(text)))
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for name, lists in words.items():
            for p in lists:
                m = min(window, len(p))
                for k in range(len(p) - m + 1):
                    for i in range(len(w) - m + 1):
                        if w[i:i + m] == p[k:k + m]:
                            hit.update(range(i, i + m))
                            found.add(name)
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("hit_items", F.lit(1))
    got = wu_manber.find_passages(d.repartition(2), b, **options)
    assert got.columns == ["doc_id", "text", "item_id", "n_words", "hit_words", "hit_items"]
    return sorted(
        ((r.doc_id, r.n_words, list(r.hit_words), list(r.hit_items)) for r in got.collect()), key=str
    )


LETTERS = " ".join("abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, LETTERS), (2, "One two, three"), (3, "ÉT été x"), (4, None), (None, "never seen"), (5, ""),
    (6, "solo"), (2, "one TWO three"), (7, "a a a a a a a a a a a a"), (8, "k l m n o p q r s t"),
]
DOCS = [
    (1, "x " + LETTERS.upper() + " y"), (2, "a b c d e f g h i"), (3, None), (4, ""), (5, "!!! ..."),
    (6, "one-two\nthree one two threes"), (7, "ét été x Ét été X éT"), (8, "so solo, SOLO."),
    (9, "a " * 40), (9, "a " * 40), (None, "solo"), (10, ("q w e r t y " * 400) + LETTERS),
    (11, "b c d e f g h i j k"), (12, "never seen"),
]


@pytest.mark.parametrize("options", [{}, {"block_words": 9}, {"window": 3}])
def test_equals_plain_search(spark, options):
    assert run(spark, DOCS, ITEMS, **options) == brute(DOCS, ITEMS, options.get("window", 10))


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS[:2], []) == [(1, 28, [], []), (2, 9, [], [])]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = wu_manber.find_passages(docs, items)
    want = brute(
        [(r.doc_id, r.text) for r in docs.collect() if r.doc_id % 4 == 0],
        [tuple(r) for r in items.collect()],
    )
    rows = sorted(
        ((r.doc_id, r.n_words, list(r.hit_words), list(r.hit_items))
         for r in got.where("doc_id % 4 = 0").collect()), key=str,
    )
    assert rows == want
    assert any(r[3] for r in rows)


def test_digest(spark):
    df = spark.createDataFrame([([10, 9, 100],), ([],)], "hit_items array<long>")
    got = [r[0] for r in df.select(wu_manber.hit_digest()).collect()]
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"10,100,9", b"")]
