"""Mutual information between each feature and the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, require_columns, total
from regatta.operators.quantiles import exact_quantiles

BINS = 10


def bin_index(value: Column, edges: list[float]) -> Column:
    """How many edges the value exceeds; equal values always share a bin."""
    inner = sorted(set(edges))
    return total([(value > F.lit(e)).cast("int") for e in inner]) if inner else F.lit(0)


def mutual_info_binned(
    df: DataFrame, features: list[str], target: str, bins: int = BINS
) -> DataFrame:
    """``feature, ordinal, score`` from counts over quantile bins, in nats.

    Counting is map-side combined, so the shuffle carries at most ``features * bins^2`` rows
    per task whatever the number of input rows or their skew.
    """
    require_columns(df, [*features, target])
    names = [*features, target]
    values = {n: col(n).cast("double") for n in names}
    levels = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, values, levels)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                bin_index(values[n], edges[n] or []).alias("bx"),
            )
            for i, n in enumerate(features)
        ]
    )
    by = bin_index(values[target], edges[target] or [])
    counts = (
        df.select(by.alias("by"), F.explode(cells).alias("c"))
        .groupBy(F.col("c.ordinal").alias("ordinal"), F.col("c.bx").alias("bx"), "by")
        .agg(F.count("*").cast("double").alias("n"))
    )
    # sum of p ln(p / (px py)) = (S(cells) - S(rows) - S(columns)) / n + ln n, S(c) = sum c ln c
    joint = counts.groupBy("ordinal").agg(
        F.sum("n").alias("size"), F.sum(_c_ln_c("n")).alias("joint")
    )
    by_x = counts.groupBy("ordinal", "bx").agg(F.sum("n").alias("n"))
    by_y = counts.groupBy("ordinal", "by").agg(F.sum("n").alias("n"))
    sums_x = by_x.groupBy("ordinal").agg(F.sum(_c_ln_c("n")).alias("sx"))
    sums_y = by_y.groupBy("ordinal").agg(F.sum(_c_ln_c("n")).alias("sy"))
    labels = F.array(*[F.lit(n) for n in features])
    score = (F.col("joint") - F.col("sx") - F.col("sy")) / F.col("size") + F.ln("size")
    return (
        joint.join(sums_x, "ordinal")
        .join(sums_y, "ordinal")
        .select(
            F.element_at(labels, F.col("ordinal") + 1).alias("feature"),
            "ordinal",
            F.greatest(score, F.lit(0.0)).alias("score"),
        )
    )


def _c_ln_c(name: str) -> Column:
    return F.col(name) * F.ln(F.col(name))

