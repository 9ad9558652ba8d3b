"""Regression metrics as one aggregate over (target, prediction) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col

METRICS = ("mse", "mae", "r2")
EXTRA_METRICS = ("MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE")


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; with a constant target 1.0 for a perfect prediction, else 0.0."""
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 0, F.lit(1.0) - F.try_divide(sse, sst)).otherwise(
        F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def metric_columns(y: Column, p: Column) -> list[Column]:
    return [
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        r2(y, p).alias("r2"),
    ]


def regression_metrics(
    df: DataFrame, target: str = "label", prediction: str = "prediction", by: list[str] = ()
) -> DataFrame:
    y, p = col(target).cast("double"), col(prediction).cast("double")
    return df.groupBy(*by).agg(F.count(y).alias("n"), *metric_columns(y, p))


def extra_metrics(
    df: DataFrame, target: str = "label", prediction: str = "prediction", by: list[str] = ()
) -> DataFrame:
    """The wider set: MAE, MSE, RMSE, R2, RMSLE (on absolute values), MAPE (nonzero targets)."""
    y, p = col(target).cast("double"), col(prediction).cast("double")
    logs = F.log1p(F.abs(p)) - F.log1p(F.abs(y))
    return df.groupBy(*by).agg(
        F.avg(F.abs(y - p)).alias("MAE"),
        F.avg((y - p) * (y - p)).alias("MSE"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("RMSE"),
        r2(y, p).alias("R2"),
        F.sqrt(F.avg(logs * logs)).alias("RMSLE"),
        F.avg(F.abs(F.try_divide(y - p, y))).alias("MAPE"),
    )


def fold_metrics(scored: DataFrame, fold: str = "fold", **names) -> DataFrame:
    """Per-fold metrics folded into mean, population deviation and the ordered list."""
    per_fold = regression_metrics(scored, by=[fold], **names)
    aggs = []
    for m in METRICS:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(m))))
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            ordered.getField(m).alias(f"{m}_splits"),
        ]
    return per_fold.agg(*aggs)


def cv_performance(
    scored: DataFrame,
    target: str = "label",
    prediction: str = "prediction",
    model: str = "model_name",
    fold: str = "fold",
    split: str = "split",
) -> DataFrame:
    """Long table ``model_name, metric, split, mean, std`` over folds, for train and val rows."""
    per_fold = extra_metrics(scored, target, prediction, [model, split, fold])
    long = per_fold.unpivot([model, split, fold], list(EXTRA_METRICS), "metric", "value")
    return long.groupBy(F.col(model).alias("model_name"), "metric", F.col(split).alias("split")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def performance_wide(long: DataFrame, metrics: list[str] = EXTRA_METRICS) -> DataFrame:
    """One row per model with ``{metric}_{train,val}_{mean,std}`` columns."""
    cells = [
        F.max(F.when((F.col("metric") == m) & (F.col("split") == s), F.col(v))).alias(f"{m}_{s}_{v}")
        for m in metrics
        for s in ("train", "val")
        for v in ("mean", "std")
    ]
    return long.groupBy("model_name").agg(*cells)


def cv_bar_table(
    long: DataFrame, metrics: list[str], split: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Bars of the comparison charts (mean with deviation) and the unknown metrics asked for."""
    if split is not None and split not in ("train", "val"):
        raise ValueError('split must be either "train" or "val"')
    out = long.where(F.col("metric").isin(list(metrics)))
    if split is not None:
        out = out.where(F.col("split") == split)
    known = [r[0] for r in long.select("metric").distinct().collect()]
    return out.select("model_name", "metric", "split", "mean", "std"), [
        m for m in metrics if m not in known
    ]
