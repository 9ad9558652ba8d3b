"""How document filters interact: step counts of every order, and exact Shapley values.

The rows of a part are tabulated by the set of filters that they fail. A coalition of filters
removes the rows whose set meets it, so 2^n counts hold all there is to know. Steps of an order
are differences of two coalitions. Shapley values come from least squares over all coalitions,
weighted by the Shapley kernel, held to the efficiency constraint and solved in rationals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.session import materialize

FILTERS = "ABCDE"

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)

_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D on a text that is not null."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < 200,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < 50 * n.cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def bits(conditions: list[Column]) -> Column:
    """The failed filters as one number, the first filter as its lowest bit."""
    out = F.lit(0)
    for k, failed in enumerate(conditions):
        out = out + F.when(failed, 1 << k).otherwise(0)
    return out


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system, by elimination in rationals."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i, row in enumerate(rows):
            if i != k and row[k]:
                rows[i] = [x - row[k] * y for x, y in zip(row, rows[k], strict=True)]
    return [r[-1] for r in rows]


def shapley(value: list[int], n: int) -> list[Fraction]:
    """Shapley values of a game, given the value of each coalition by its bits.

    They minimise the kernel-weighted squares of ``value[s] - sum of phi in s`` over all
    coalitions but none and all, with the sum of all phi held to the value of all. The normal
    equations have the multiplier of that constraint as one more unknown.
    """
    full = (1 << n) - 1
    matrix = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * (n + 1)
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        members = [k for k in range(n) if s >> k & 1]
        for i in members:
            right[i] += weight * (value[s] - value[0])
            for j in members:
                matrix[i][j] += weight
    for i in range(n):
        matrix[i][n] = matrix[n][i] = Fraction(1)
    right[n] = Fraction(value[full] - value[0])
    return solved(matrix, right)[:n]


def removals(counts: dict[int, int], n: int) -> list[int]:
    """Rows that each coalition of filters removes, from the rows with each set of failures."""
    return [sum(c for failed, c in counts.items() if failed & s) for s in range(1 << n)]


def audited(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """The steps of every order of the filters.

    ``counts`` gives all, good and toxic rows by failed filters. A row is: order, step, kept,
    removed, redundant, unique fails, good lost, toxic lost and the Shapley value times the
    number of orders.
    """
    n = len(filters)
    total = sum(c[0] for c in counts.values())
    gone, good, toxic = (removals({f: c[k] for f, c in counts.items()}, n) for k in range(3))
    values = [int(v) for v in (factorial(n) * x for x in shapley(gone, n))]
    full = (1 << n) - 1
    for order in permutations(range(n)):
        name, before = "".join(filters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = gone[after] - gone[before]
            yield (
                name, step, total - gone[after], removed, gone[1 << k] - removed,
                gone[full] - gone[full ^ 1 << k], good[after] - good[before],
                toxic[after] - toxic[before], values[k],
            )
            before = after


def _marked(labels: DataFrame, id_col: str) -> DataFrame:
    """Ids of labelled rows with whether any of their labels says good or toxic."""
    said = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).cast("long").alias("key")).agg(
        F.max(F.coalesce(col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    return said.withColumn("known", F.lit(True))


def failures(
    docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``part, failed, rows, good, toxic``: the rows of each part by the set of filters they fail.

    Only a digest of a text is shuffled. Rows collapse where they are read if id, part and text
    are equal, and copies before they meet by digest, so that no group of copies is gathered.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    facts = docs.select(
        col(id_col).cast("long").alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), bits(text_failures(text)).alias("failed"),
    )
    facts = facts.groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    # A null id meets no label; its rows are dealt by their digest.
    facts = facts.select(
        "*", F.coalesce("id", F.xxhash64("digest")).alias("key"), F.col("id").isNotNull().alias("known"))
    said = facts.join(_marked(labels, id_col), ["key", "known"], "left").select(
        "id", "part", "digest", "failed", "n",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    alike = materialize(said.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min_by("n", "id").alias("at_first"),
    ))
    # Of the copies of a text those of the smallest id, and rows without an id, pass filter E.
    least = alike.groupBy("digest").agg(F.min("first").alias("least"))
    alike = alike.join(least, "digest").withColumn(
        "passed", F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0))
    both = alike.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("failed").alias("failed"), F.col("passed").alias("n")),
        F.struct((F.col("failed") + (1 << 4)).alias("failed"), (F.col("n") - F.col("passed")).alias("n")),
    )).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    return both.groupBy("part", "failed").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", **columns: str) -> DataFrame:
    """Every step of all 120 orders of the five filters, for each part: see ``RESULT``.

    Filters: A too few words, B too few distinct words, C too many capitals, D symbols, E a copy
    of a smaller id's text. A null text is empty, a null part the empty string. Rows of equal id
    and text are no copies of each other; a row without an id is no copy and nobody's original.
    An id with several labels is good, or toxic, if any of them says so. Empty tables give no
    rows; without labels nothing is lost. Other columns are not read. Very long texts are judged
    as a whole. A part meets in one task as at most 32 rows.
    """
    def steps(part: pd.DataFrame) -> pd.DataFrame:
        counts = {
            int(f): (int(n), int(g), int(t))
            for f, n, g, t in zip(part.failed, part.rows, part.good, part.toxic, strict=True)
        }
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        name = part.part.iloc[0]
        return pd.DataFrame([(name, *row) for row in audited(counts)], columns=names)

    counted = failures(docs, labels, part_col, **columns)
    return counted.groupBy("part").applyInPandas(steps, RESULT)
