"""A keyed hash made of integer arithmetic only.

Splits, folds and samples must not depend on row order or partitioning, so they are
functions of the row key. Plain bigint arithmetic gives the same numbers in any SQL
engine, which keeps every split checkable from outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import col

MODULUS = 2147483647  # 2**31 - 1, prime
MULTIPLIERS = (48271, 69621, 40692, 39373, 16807, 62089911, 630360016, 742938285)
SEED_MULTIPLIER = 950706376
ROUNDS = (1226874159, 1343714438)


def seed_term(seed: int) -> int:
    return (seed % MODULUS) * SEED_MULTIPLIER % MODULUS


def _as_integer(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col(name).cast("bigint")
    digest = F.md5(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _linear(values: list[Column], seed: int, variant: int = 0, wide: bool = True) -> Column:
    modulus = F.lit(MODULUS).cast("bigint")

    def term(value: Column, i: int) -> Column:
        i += variant
        factor = MULTIPLIERS[i % len(MULTIPLIERS)] + i // len(MULTIPLIERS)
        return (F.pmod(value, modulus) * F.lit(factor)) % modulus

    mixed = F.lit(seed_term(seed)).cast("bigint")
    for i, value in enumerate(values):
        value = F.coalesce(value, F.lit(0).cast("bigint"))
        mixed = mixed + term(value, i)
        if wide:  # the part above the modulus; 0 for smaller keys
            mixed = mixed + term(F.call_function("div", value, modulus), i + 5)
    return mixed % modulus


def _round(value: Column, constant: int) -> Column:
    return (value * (value + F.lit(constant))) % F.lit(MODULUS).cast("bigint")


def hash_columns(values: list[Column], seed: int = 0) -> Column:
    """Hash of small bigint expressions, uniform on ``0 .. MODULUS-1``; nulls hash as 0."""
    mixed = _linear(values, seed, wide=False)
    for constant in ROUNDS:
        mixed = _round(mixed, constant)
    return mixed


def add_key_hash(
    df: DataFrame, key_cols: list[str], name: str, seed: int = 0, variant: int = 0
) -> DataFrame:
    """Adds the hash of the key columns; text and other types go through their MD5 digest.

    Every round is a projection of its own, so that the generated code stays small. Variants
    use other multipliers: two of them together tell almost all keys apart. Without key
    columns a row is identified by its whole content.
    """
    if not key_cols:
        content = F.xxhash64(*[col(n) for n in df.columns], F.lit(seed), F.lit(variant))
        return df.withColumn(name, F.pmod(content, F.lit(MODULUS).cast("bigint")))
    out = df.withColumn(name, _linear([_as_integer(df, k) for k in key_cols], seed, variant))
    for constant in ROUNDS:
        out = out.withColumn(name, _round(F.col(name), constant))
    return out


def unit_interval(hashed: Column) -> Column:
    return hashed.cast("double") / F.lit(float(MODULUS))
