"""Combining per-task numpy results without piling them on the driver.

A pass over the rows yields one small array per task and key. With many tasks or large arrays
they meet on executors, a few tasks at a time and level by level, so that the driver gets one
array per key: its size depends on the model and not on the rows or tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT = 64  # up to this many tasks, their results go straight to the driver
DIRECT_BYTES = 256 << 20  # if all of them together are no larger
FAN = 32  # results that meet in one group
TASK_BYTES = 32 << 20


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns of an Arrow batch as a float matrix, booleans as 0/1."""
    out = np.empty((batch.num_rows, len(names)))
    for j, name in enumerate(names):
        values = batch.column(batch.schema.get_field_index(name))
        out[:, j] = values.to_numpy(zero_copy_only=False)
    return out


def expected_tasks(df: DataFrame) -> int:
    """Upper estimate of the tasks of a pass, from the optimizer's size of the input; asking
    the physical plan would already run its shuffles."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(size // TASK_BYTES, df.sparkSession.sparkContext.defaultParallelism)


def map_reduce(
    df: DataFrame,
    summarize: Callable[[Iterator[pa.RecordBatch]], dict],
    combine: Callable,
    tasks: int | None = None,
    size: int = 0,
) -> dict:
    """``summarize`` turns one task's batches into ``{key: array(s)}``; equal keys are
    merged with ``combine``, which must be associative and commutative. ``tasks`` is the number
    of partitions, if known, and ``size`` about the bytes of a task's results."""

    def per_task(batches):
        items = summarize(batches)
        keys = list(items)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array([pickle.dumps(items[k]) for k in keys], pa.binary()),
            ],
            names=["key", "blob"],
        )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in pdf["blob"]:
            value = pickle.loads(blob)
            total = value if total is None else combine(total, value)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "g": [pdf["g"].iloc[0]], "blob": [pickle.dumps(total)]})

    partials = df.mapInArrow(per_task, "key bigint, blob binary")
    tasks = expected_tasks(df) if tasks is None else tasks
    if tasks > DIRECT or tasks * size > DIRECT_BYTES:
        partials = partials.withColumn("g", F.spark_partition_id())
        while tasks > 1:
            tasks = -(-tasks // FAN)
            at = F.call_function("div", F.col("g"), F.lit(FAN)) if tasks > 1 else F.lit(0)
            partials = partials.withColumn("g", at.cast("int")).groupBy("key", "g").applyInPandas(
                merge, "key bigint, g int, blob binary")
    out: dict = {}
    for row in partials.collect():
        value = pickle.loads(bytes(row["blob"]))
        out[row["key"]] = value if row["key"] not in out else combine(out[row["key"]], value)
    return out
