"""What the dashboard shows: KPIs, families, best model, the filtered results view, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, require_columns
from regatta.functions import formatting, params
from regatta.operators.clean import select_present
from regatta.operators.quantiles import grouped_quantiles
from regatta.operators.ranking import metric_order, without_nan

# The results view's columns, in order.
VIEW_COLUMNS = [
    "model_id", "model_name", "iteration", "target", "target_transform", "n_trials",
    "train_R2", "train_MAE", "train_MSE",
    "test_R2", "test_MAE", "test_MSE",
    "best_R2", "best_MAE", "best_MSE",
    "optimization_time", "score",
]
SPLIT_COLUMNS = {
    "Train": ("train_R2", "train_MAE", "train_MSE"),
    "Validation": ("best_R2", "best_MAE", "best_MSE"),
    "Test": ("test_R2", "test_MAE", "test_MSE"),
}


def kpis(
    df: DataFrame, metric: str, higher_is_better: bool, time_col: str = "optimization_time"
) -> DataFrame:
    """One row: models evaluated, mean and population deviation of the metric, best value,
    total optimisation time (missing counts as 0)."""
    require_columns(df, [metric])
    value = without_nan(df, metric).cast("double")
    aggs = [
        F.count("*").alias("n_models"),
        F.avg(value).alias("metric_mean"),
        F.stddev_pop(value).alias("metric_std"),
        (F.max(value) if higher_is_better else F.min(value)).alias("metric_best"),
    ]
    if time_col in df.columns:
        seconds = F.sum(F.coalesce(without_nan(df, time_col).cast("double"), F.lit(0.0)))
    else:
        seconds = F.lit(None).cast("double")
    return df.agg(*aggs, seconds.alias("total_time")).withColumn(
        "total_time_hms", formatting.hms(F.col("total_time"))
    )


def family_box(df: DataFrame, metric: str, family: str = "model_name") -> DataFrame:
    """Five-number summary per model family: the data of the box chart."""
    clean = df.withColumn(metric, without_nan(df, metric))
    out = grouped_quantiles(clean, family, metric, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["low", "q1", "median", "q3", "high"]
    return out.select(
        col(family), "n", *[F.col("q").getItem(i).alias(n) for i, n in enumerate(names)]
    )


def family_median(
    df: DataFrame, metric: str, higher_is_better: bool, family: str = "model_name"
) -> DataFrame:
    """Median of the metric per family, best family first."""
    clean = df.withColumn(metric, without_nan(df, metric))
    out = grouped_quantiles(clean, family, metric, [0.5]).select(
        col(family), F.col("q").getItem(0).alias("median")
    )
    best = F.desc_nulls_last("median") if higher_is_better else F.asc_nulls_last("median")
    return out.orderBy(best, family)


def family_points(df: DataFrame, metric: str, family: str = "model_name") -> DataFrame:
    return df.select(col(family), without_nan(df, metric).alias(metric))


def sort_results(df: DataFrame, metric: str, higher_is_better: bool, tie: str = "model_id") -> DataFrame:
    """Best first if the metric is there, else unchanged."""
    if metric not in df.columns:
        return df
    order = [metric_order(df, metric, higher_is_better)]
    return df.orderBy(*order, *([col(tie).asc()] if tie in df.columns else []))


def filter_name(df: DataFrame, pattern: str, column: str = "model_name") -> DataFrame:
    """Case-insensitive regular expression found anywhere in the name; null never matches."""
    return df.where(F.coalesce(col(column).cast("string").rlike("(?i)" + pattern), F.lit(False)))


def filter_target(df: DataFrame, value: str, column: str = "target") -> DataFrame:
    return df.where(col(column).cast("string") == F.lit(value))


def results_view(
    df: DataFrame,
    metric: str,
    higher_is_better: bool,
    name_filter: str = "",
    target_filter: str = "",
    show_params: bool = False,
) -> DataFrame:
    """Filter, project, humanise the time, best first."""
    out = df
    if name_filter:
        out = filter_name(out, name_filter)
    if target_filter:
        out = filter_target(out, target_filter)
    out = sort_results(out, metric, higher_is_better)
    out = select_present(out, VIEW_COLUMNS + (["best_params"] if show_params else []))
    if "optimization_time" in out.columns:
        out = out.withColumn("optimization_time", formatting.hms(F.col("optimization_time")))
    return out


def best_row(df: DataFrame, metric: str, higher_is_better: bool, tie: str = "model_id") -> DataFrame:
    require_columns(df, [metric])
    return df.orderBy(metric_order(df, metric, higher_is_better), col(tie).asc()).limit(1)


def split_table(best: DataFrame) -> DataFrame:
    """Metrics of one results row by split, as formatted text."""
    rows = F.array(
        *[
            F.struct(
                F.lit(split).alias("split"),
                *[
                    formatting.number(_present(best, c)).alias(n)
                    for n, c in zip(("r2", "mae", "mse"), columns)
                ],
            )
            for split, columns in SPLIT_COLUMNS.items()
        ]
    )
    return best.select(F.inline(rows))


def best_params(best: DataFrame) -> DataFrame:
    """Hyperparameters of one results row as ``param, value`` rows."""
    return best.select(F.explode(params.parse(F.col("best_params"))).alias("param", "value"))


def _present(df: DataFrame, name: str) -> Column:
    return col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def tail_lines(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n lines in the given order; 0 keeps all."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df if n == 0 else df.orderBy(*[col(o).desc() for o in order]).limit(n)


def filter_log(
    df: DataFrame,
    text: str = "",
    tail: int = 500,
    case_sensitive: bool = False,
    order: list[str] = ("line_no",),
    line: str = "line",
) -> DataFrame:
    """Lines containing the text among the last ``tail`` ones, in order."""
    out = tail_lines(df, tail, list(order))
    if text:
        value = col(line) if case_sensitive else F.lower(col(line))
        out = out.where(value.contains(text if case_sensitive else text.lower()))
    return out.orderBy(*[col(o) for o in order])

