"""The filter audit against orders applied one by one."""

import random
import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from regatta.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(rows):
    """The failed filters of each row (id, text, part)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        out.append("".join(name for name, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text) is not None,
            i is not None and first[text] < i,
        ), strict=True) if bad))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), []
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                total[name] += len(gone)
                steps.append((
                    part, "".join(order), step, len(left), len(gone),
                    sum(name in f for _, f in own) - len(gone), sum(f == name for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name,
                ))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs = docs.withColumn("key", F.lit(1)).withColumn("good", F.lit("x")).withColumn("quality", F.lit(1))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("q"))
    return sorted(tuple(r) for r in filter_audit.audit(docs, said).collect())


def corpus():
    draw = random.Random(3)
    texts = [
        "", " \n", "short text", "SHOUT", "a # b", " ".join(f"w{k}" for k in range(200)), "w " * 200,
        " ".join(f"w{k}" for k in range(199)), "W" * 3 + "x" * 97, "W" * 4 + "x" * 96,
        " ".join(f"w{k}" for k in range(100)) + " " + "w1 " * 100, "Ä" * 50 + " A", "| " * 300,
        " ".join(f"W{k}" for k in range(300)), "word Word\v" * 5_000, "é\xa0ü " * 300,
    ]
    rows = [(k, draw.choice([*texts, f"own {k}"]), draw.choice(["en", "de", None, ""])) for k in range(300)]
    rows += [(None, None, "en"), (None, "short text", "de"), (None, "never", "en"), (5, None, "fr"), (1000, None, "fr")]
    rows += [rows[7]] * 3 + [(-1, "short text", "en"), (-1, "short text", "de"), (-1, "short text", "en")]
    labels = [(k, draw.randrange(2), draw.randrange(2)) for k in range(0, 300, 2)]
    labels += [(3, None, 1), (3, 1, None), (4, 0, 0), (4, 1, 1), (None, 1, 1), (10**9, 1, 1)]
    return rows, labels


def test_equals_orders_one_by_one(spark):
    rows, labels = corpus()
    assert run(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    rows, labels = corpus()
    assert run(spark, [], labels) == []
    assert run(spark, rows[:20], []) == plain(rows[:20], [])


def test_least_squares_give_shapley_values():
    draw = random.Random(1)
    for n in (2, 3, 4, 5):
        value = [draw.randrange(-50, 1000) for _ in range(1 << n)]
        expected = [Fraction(0)] * n
        for order in permutations(range(n)):
            seen = 0
            for k in order:
                expected[k] += Fraction(value[seen | 1 << k] - value[seen], factorial(n))
                seen |= 1 << k
        assert filter_audit.shapley(value, n) == expected
