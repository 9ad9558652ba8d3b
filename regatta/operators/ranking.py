"""Ranks over a whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regatta.columns import col, is_fractional
from regatta.session import materialize

# Dashboard label -> (column, higher is better, label).
METRIC_INFO = {
    "R²": ("test_R2", True, "R²"),
    "MAE": ("test_MAE", False, "MAE"),
    "MSE": ("test_MSE", False, "MSE"),
}


def metric_info(key: str) -> tuple[str, bool, str]:
    if key not in METRIC_INFO:
        raise ValueError(f"unknown metric: {key}")
    return METRIC_INFO[key]


def without_nan(df: DataFrame, name: str) -> Column:
    c = col(name)
    return F.when(~F.isnan(c), c) if is_fractional(df.schema[name].dataType) else c


def metric_order(df: DataFrame, metric: str, higher_is_better: bool) -> Column:
    """Best first, missing (NULL or NaN) last."""
    value = without_nan(df, metric)
    return value.desc_nulls_last() if higher_is_better else value.asc_nulls_last()


def number_rows(
    df: DataFrame, order: list[Column], name: str = "rank"
) -> DataFrame:
    """Adds 1..n in the given order; a hash of the row breaks ties.

    A window without partitions would send the table to one task. The table is
    range-partitioned on the order, written once (so that the ranges stay what they were when
    counted), and each range numbers its own rows after the sizes of the ranges before it.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    content = F.xxhash64(*[col(n) for n in df.columns])
    ranged = materialize(
        df.withColumn("__tie", content)
        .repartitionByRange(parts, *order, F.col("__tie"))
        .withColumn("__part", F.spark_partition_id())
    )
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    ids = sorted(sizes)
    starts = [0, *accumulate(sizes[i] for i in ids)]
    offsets = df.sparkSession.createDataFrame(
        [(i, s) for i, s in zip(ids, starts)], "__part int, __start bigint"
    )
    within = Window.partitionBy("__part").orderBy(*order, F.col("__tie"))
    return (
        ranged.withColumn(name, F.row_number().over(within).cast("bigint"))
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col(name) + F.col("__start"))
        .drop("__part", "__start", "__tie")
    )


def rank_results(
    df: DataFrame,
    metric: str,
    higher_is_better: bool,
    tie: str = "model_id",
) -> tuple[dict | None, DataFrame]:
    """The best row and the table with ``rank`` in front; no such metric, no best row."""
    if metric not in df.columns:
        return None, df
    order = [metric_order(df, metric, higher_is_better)]
    if tie in df.columns:
        order.append(col(tie).asc())
    ranked = number_rows(df, order, "rank")
    ranked = ranked.select("rank", *[col(n) for n in df.columns])
    best = ranked.where("rank = 1").drop("rank").collect()
    return (best[0].asDict() if best else None), ranked


def rank_within(
    df: DataFrame, by: list[str], metric: str, higher_is_better: bool, tie: str
) -> DataFrame:
    """Rank per group (experiment and stage of a comparison); groups are model lists."""
    order = Window.partitionBy(*[col(b) for b in by]).orderBy(
        metric_order(df, metric, higher_is_better), col(tie).asc()
    )
    return df.withColumn("rank", F.row_number().over(order))
