"""Full-row duplicates.

Equal rows collapse on the map side (partial aggregation), so a row repeated a billion
times costs one row per task in the shuffle. The surviving key is the smallest one, which
does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, unused
from regatta.session import materialize

WORDS = 1 << 20
"""Words of 64 bits of the bitmap; its size as a broadcast table is 16 bytes a word."""


def _group_distinct(df: DataFrame, compared: list[str], keys: list[str]) -> DataFrame:
    if not keys:
        return df.dropDuplicates()
    groups = df.groupBy(*[col(n) for n in compared])
    if len(keys) == 1:
        out = groups.agg(F.min(col(keys[0])).alias(keys[0]))
    else:
        out = groups.agg(F.min(F.struct(*[col(k) for k in keys])).alias("__key"))
        out = out.select(
            *[F.col("__key").getField(k).alias(k) for k in keys], *[col(n) for n in compared]
        )
    return out.select(*[col(n) for n in df.columns])


def drop_duplicate_rows(
    df: DataFrame, keys: list[str] = (), strategy: str = "digest"
) -> DataFrame:
    """Distinct rows, comparing every column but ``keys``.

    ``"digest"`` shuffles 16-byte row digests. A bitmap of those that repeat, of at most
    ``WORDS`` words whatever the data, goes to every task; rows that miss it are distinct and
    stay where they are. The others, all rows that repeat and a few that share a bit, are grouped
    on their real values, so a digest collision cannot remove a row. ``"group"`` groups all rows.
    """
    keys = list(keys)
    compared = [n for n in df.columns if n not in keys]
    if strategy == "group":
        return _group_distinct(df, compared, keys)
    if strategy != "digest":
        raise ValueError(f"unknown strategy: {strategy}")
    values = [col(n) for n in compared]
    digests = df.select(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))
    repeated = digests.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    words = materialize(
        repeated.groupBy(_word(F.col("a")).alias("word")).agg(F.bit_or(_bit(F.col("b"))).alias("bits")))
    if words.isEmpty():
        return df
    word, bits = unused(df, "word"), unused(df, "bits")
    words = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    marked = df.withColumn(word, _word(F.xxhash64(*values))).join(F.broadcast(words), word, "left")
    hit = F.coalesce(col(bits).bitwiseAND(_bit(F.xxhash64(F.lit(1), *values))), F.lit(0).cast("bigint")) != 0
    alone, several = marked.where(~hit).drop(word, bits), marked.where(hit).drop(word, bits)
    return alone.unionByName(_group_distinct(several, compared, keys))


def _word(digest: Column) -> Column:
    return F.pmod(digest, F.lit(WORDS).cast("bigint"))


def _bit(digest: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(digest, F.lit(64)).cast("int"))


def duplicate_count(df: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    names = list(compared or df.columns)
    sizes = df.groupBy(*[col(n) for n in names]).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
