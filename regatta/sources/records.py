"""CSV records of files of any size, with line breaks inside quotes, read by many tasks.

A file is read as lines, block by block. A line break belongs to a record if the quotes before it
are odd in number, so each block's count of quotes, added up over the blocks before it, says
whether the block starts inside a record. Every block then cuts its own records; what it holds of
a record that began earlier is sent to the block where that record starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regatta.session import materialize

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and block; within a task they come in the order of the file."""
    # Line breaks other than \\n stay in the text; a record's last \\r is cut off later.
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def blocks(lines: DataFrame) -> DataFrame:
    """``file, block, inside``: whether each block starts inside a quoted field."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes.cast("long")) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


PIECES = "file string, block bigint, number bigint, text string, head boolean, open boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block in order; number 0 is what belongs to an earlier block's record.

    A line with an even number of quotes outside a quoted field is a record as it is.
    """
    key, held, number, odd = None, [], 0, False
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("text", pa.string()),
        ("head", pa.bool_()), ("open", pa.bool_())])

    def records(texts: pa.Array, is_open: bool) -> pa.RecordBatch:
        n = len(texts)
        numbers = np.arange(number, number + n)
        columns = [
            pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n),
            pa.array(numbers), texts.cast(pa.string()), pa.array(numbers == 0), pa.repeat(is_open, n)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, line, inside = (batch.column(i) for i in range(4))
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        odd_line = pc.count_substring(line, QUOTE).to_numpy(zero_copy_only=False) % 2
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = file[a].as_py(), block[a].as_py()
            if key != here:
                if held:
                    yield records(pa.array(["\n".join(held)]), True)
                key, odd, held = here, bool(inside[a].as_py()), []
                number = 0 if odd else 1
            within = (np.cumsum(odd_line[a:b]) + odd) % 2
            texts = line[a:b]
            if odd or within.any():
                lines, start, whole = texts.to_pylist(), 0, []
                for end in (np.flatnonzero(within == 0) + 1).tolist():
                    whole.append("\n".join(held + lines[start:end]))
                    held, start = [], end
                held += lines[start:]
                texts = pa.array(whole, pa.string())
            if len(texts):
                yield records(texts, False)
            number, odd = number + len(texts), bool(within[-1])
    if held:
        yield records(pa.array(["\n".join(held)]), True)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, number, text``: every record of the CSV files, blank ones left out.

    Lines are read twice, once for the quotes of each block. Only pieces of records that cross a
    block border are shuffled, at most two a block and joined by file; a record may span many
    blocks. The table of blocks, one short row for each, is sent to every task.
    """
    lines = _lines(spark, path)
    starts = materialize(blocks(lines))
    marked = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "line", "inside")
    pieces = materialize(marked.mapInArrow(_cut, PIECES))
    whole = pieces.where("not open and not head").select("file", "block", "number", "text")
    # A record that is open at its block's end goes on in the heads of the blocks after it; the
    # first of those that is closed ends it.
    parts = pieces.where("open or head")
    opened = F.when(~F.col("head"), F.struct("block", "number"))
    order = Window.partitionBy("file").orderBy("block", "number")
    crossing = (
        parts.withColumn("start", F.last(opened, ignorenulls=True).over(order))
        .groupBy("file", "start")
        .agg(F.array_sort(F.collect_list(F.struct("block", "number", "text"))).alias("p"))
        .select(
            "file", F.col("start.block").alias("block"), F.col("start.number").alias("number"),
            F.array_join("p.text", "\n").alias("text"))
    )
    text = F.regexp_replace("text", r"\r$", "")
    return whole.unionByName(crossing).withColumn("text", text).where("text <> ''")
