"""Train/test split, folds and repeats, all as functions of the row key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.columns import total
from regatta.functions.hashing import MODULUS, add_key_hash, hash_columns
from regatta.operators.quantiles import values_at_ranks

SESSION_IDS = 10_000  # repeat seeds are drawn from 0 .. 9999


def test_threshold(test_size: float) -> int:
    return int(MODULUS * test_size)


def train_test_split(
    df: DataFrame,
    key_cols: list[str],
    seed: int = 42,
    test_size: float = 0.2,
    exact: bool = False,
) -> DataFrame:
    """Adds ``is_test``. Narrow: no shuffle, and stable under repartitioning.

    With ``exact`` the test part holds exactly ``ceil(test_size * n)`` rows: the hash value
    at that rank is found first (counting passes), the assignment stays a plain filter.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    if not exact:
        hashed = add_key_hash(df, key_cols, "__h", seed)
        return hashed.withColumn("is_test", F.col("__h") < test_threshold(test_size)).drop("__h")
    hashed, order = _ordered(df, key_cols, seed)
    n = df.count()
    start = values_at_ranks(hashed.select(order), [(F.col(order), n, math.ceil(n * test_size))])[0]
    return hashed.withColumn("is_test", F.col(order) < F.lit(start)).drop(order)


def assign_folds(
    df: DataFrame,
    key_cols: list[str],
    k: int = 5,
    seed: int = 42,
    test_size: float = 0.2,
    exact: bool = False,
) -> DataFrame:
    """Adds ``is_test`` and ``fold`` (0..k-1, null for test rows).

    Rows are ordered by their key hash; the first part is the test set and the rest is cut
    into k contiguous blocks. By default the cuts are fixed hash values. With ``exact`` they
    are the hash values at the exact ranks, so the first ``n mod k`` blocks hold one row more.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    if not exact:
        first = test_threshold(test_size)
        h = F.col("__h")
        block = F.call_function("div", (h - first) * k, F.lit(MODULUS - first).cast("bigint"))
        return (
            add_key_hash(df, key_cols, "__h", seed)
            .withColumns({"is_test": h < first, "fold": F.when(h >= first, block.cast("int"))})
            .drop("__h")
        )
    hashed, order = _ordered(df, key_cols, seed)
    n = df.count()
    n_test = math.ceil(n * test_size)
    n_train = n - n_test
    if n_train < k:
        raise ValueError(f"{n_train} training rows cannot make {k} folds")
    sizes = [n_train // k + (1 if f < n_train % k else 0) for f in range(k)]
    ranks = [n_test + sum(sizes[:f]) for f in range(k)]
    o = F.col(order)
    starts = values_at_ranks(hashed.select(order), [(o, n, r) for r in ranks])
    reached = total([(o >= F.lit(s)).cast("int") for s in starts])
    return hashed.withColumns(
        {
            "is_test": o < F.lit(starts[0]),
            "fold": F.when(o >= F.lit(starts[0]), reached - 1),
        }
    ).drop(order)


def _ordered(df: DataFrame, key_cols: list[str], seed: int) -> tuple[DataFrame, str]:
    """62 bits of key hash: an order in which distinct keys practically never tie."""
    out = add_key_hash(df, key_cols, "__order", seed)
    low = add_key_hash(out, key_cols or df.columns, "__low", seed, variant=3)
    wide = F.col("__order") * F.lit(MODULUS + 1).cast("bigint") + F.col("__low")
    return low.withColumn("__order", wide).drop("__low"), "__order"


def draw_seeds(candidates: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct ids in a seeded random order, as ``session_id``."""
    return (
        candidates.select(F.col(id_col).cast("bigint").alias("session_id"))
        .distinct()
        .orderBy(hash_columns([F.col("session_id")], seed), "session_id")
        .limit(n)
    )


def repeat_seeds(
    spark: SparkSession, n: int, session_ids: list[int] | str = "random", seed: int = 0
) -> list[int]:
    """Seeds of repeated experiments: drawn from 0..9999, or given and checked."""
    if session_ids != "random":
        if len(session_ids) != n:
            raise ValueError(f"{len(session_ids)} session ids for {n} experiments")
        return list(session_ids)
    if n > SESSION_IDS:
        raise ValueError(f"at most {SESSION_IDS} distinct session ids")
    return [r[0] for r in draw_seeds(spark.range(SESSION_IDS), "id", n, seed).collect()]


def repeat_experiments(table: DataFrame, seeds: list[int]) -> DataFrame:
    """Every row once per seed: ``experiment`` (1..n) and ``session_id`` are added."""
    pairs = F.array(
        *[
            F.struct(F.lit(i + 1).alias("experiment"), F.lit(s).cast("bigint").alias("session_id"))
            for i, s in enumerate(seeds)
        ]
    )
    return table.select(F.inline(pairs), *table.columns)
