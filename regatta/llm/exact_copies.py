"""Exact copies: texts grouped by a 128-bit digest, with their bytes compared inside a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.session import materialize

HEAVY_GROUPS = 1_000
"""Groups with more than this share of all rows meet their rows by broadcast; fewer such exist."""

REPEATS = 1_000_000
"""Equal rows of one id that are listed at a time."""


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows by ``digest`` with their group. Rows of heavy groups stay where they are."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    limit = total // HEAVY_GROUPS
    heavy, light = groups.where(F.col("group_size") > limit), groups.where(F.col("group_size") <= limit)
    met = rows.join(F.broadcast(heavy), "digest", "left")
    found = met.where("group_size is not null")
    rest = met.where("group_size is null").select(*rows.columns)
    return found.unionByName(rest.join(light, "digest"))


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = digest128,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if their bytes are equal after ``normalised``. Of equal texts the row with
    the smallest id stays; a null id comes last. Of rows with equal id and text, one stays and
    all count in ``group_size``. A null text is empty, and empty texts are equal. An empty table
    gives no rows; other columns are not read. Very long texts are compared as a whole.

    Equal texts of a task collapse before they are shuffled by digest and bytes, so that a group
    of any size sends one text per task; everything else moves digests and ids alone. If a
    digest turns out to have several texts, its rows are told apart by their bytes.
    """
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), normalised(col(text_col)).alias("text"))
    texts = texts.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    by_bytes = texts.groupBy("digest", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(by_bytes.select(
        "digest", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    several = groups.groupBy("digest").count().where("count > 1").select("digest")
    rows = materialize(texts.groupBy("digest", "doc_id").agg(F.count("*").alias("n")))
    if several.isEmpty():
        met = _with_groups(rows, groups)
    else:
        several = materialize(several)
        alone = groups.join(several, "digest", "left_anti")
        met = _with_groups(rows.join(several, "digest", "left_anti"), alone)
        clashing = texts.join(several, "digest", "left_semi").groupBy("digest", "text", "doc_id").agg(
            F.count("*").alias("n"))
        by_bytes = by_bytes.join(several, "digest", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
        met = met.unionByName(clashing.join(by_bytes, ["digest", "text"]).drop("text"))
    lots = met.withColumn("lot", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATS}"))))
    one = F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.expr(f"n - lot * {REPEATS}")).cast("int"))
    listed = lots.withColumn("k", F.explode(one))
    return listed.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("lot") == 0) & (F.col("k") == 1)).alias("kept"),
        "text_sha256",
    )
