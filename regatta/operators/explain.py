"""Residuals and Shapley values as ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, require_columns
from regatta.functions.formatting import safe_name
from regatta.models.base import TREE_FAMILIES, FittedModel
from regatta.models.ensemble import shapley_column
from regatta.session import materialize

FILES_PER_ITEM = 8


def residuals(
    model: FittedModel, df: DataFrame, target: str, key_cols: list[str] = ()
) -> DataFrame:
    """Keys, target, prediction and ``target - prediction``; one row each, no join."""
    y = col(target).cast("double")
    return model.predict(df, "prediction").select(
        *[col(k) for k in key_cols], y.alias("label"), "prediction",
        (y - F.col("prediction")).alias("residual"),
    )


def _long(df: DataFrame, key_cols: list[str], features: list[str], values, base) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                col(f).cast("double").alias("feature_value"),
                v.alias("shap_value"),
            )
            for f, v in zip(features, values)
        ]
    )
    return df.select(*[col(k) for k in key_cols], F.inline(rows), base.alias("base_value"))


def shap_linear(
    model: FittedModel, df: DataFrame, key_cols: list[str], background: DataFrame | None = None
) -> DataFrame:
    """``coefficient * (x - mean)`` per feature; the base is the prediction at the means."""
    known = background if background is not None else df
    means = known.agg(
        *[F.avg(col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(model.features)]
    ).first()
    center = [float(means[f"m{i}"] or 0.0) for i in range(len(model.features))]
    base = model.intercept + sum(c * m for c, m in zip(model.coefficients, center))
    values = [
        F.lit(float(c)) * (col(f).cast("double") - F.lit(m))
        for f, c, m in zip(model.features, model.coefficients, center)
    ]
    return _long(df, key_cols, model.features, values, F.lit(float(base)))


def shap_tree(model: FittedModel, df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Exact path-dependent Shapley values; they and the base add up to the prediction."""
    ensemble = model.ensemble(df.sparkSession)
    out = shapley_column(df, ensemble, model.features, "__shap")
    values = [F.col("__shap").getItem(i) for i in range(len(model.features))]
    return _long(out, key_cols, model.features, values, F.lit(ensemble.expectation()))


def shap_values(
    model: FittedModel, df: DataFrame, key_cols: list[str], background: DataFrame | None = None
) -> DataFrame:
    """Long table ``keys, feature, feature_value, shap_value, base_value, target_scale``.

    A model with a transformed target is explained on that scale, named in the last column.
    """
    if model.family in TREE_FAMILIES:
        out = shap_tree(model, df, list(key_cols))
    elif model.family == "LR":
        out = shap_linear(model, df, list(key_cols), background)
    else:
        raise ValueError(f"model {model.family} cannot be explained")
    return out.withColumn("target_scale", F.lit(model.transform.kind))


def shap_summary(shap: DataFrame) -> DataFrame:
    """Mean absolute value per feature, largest first: the bars of the summary chart."""
    return (
        shap.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def label_of(labels: dict[str, str] | None, feature):
    """Pretty name of a feature column, the name itself where there is none."""
    out = feature
    if labels:
        pairs = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
        out = F.coalesce(F.element_at(pairs, feature), feature)
    return out


def shap_scatter(
    shap: DataFrame, feature: str | None = None, labels: dict[str, str] | None = None
) -> DataFrame:
    """Points ``feature, label, feature_value, shap_value`` of one or every feature."""
    out = shap if feature is None else shap.where(F.col("feature") == feature)
    label = label_of(labels, F.col("feature"))
    return out.select("feature", label.alias("label"), "feature_value", "shap_value")


def export_diagnostics(
    residual_table: DataFrame, shap: DataFrame, path: str, labels: dict[str, str] | None = None
) -> None:
    """Residuals, the summary and the points of every feature under one folder."""
    residual_table.write.mode("overwrite").parquet(f"{path}/residuals")
    shap = materialize(shap)  # Shapley values are worked out once
    shap_summary(shap).write.mode("overwrite").parquet(f"{path}/shap_summary")
    points = shap_scatter(shap, labels=labels).withColumn("item", safe_name(F.col("label")))
    salt = F.pmod(F.xxhash64("feature_value"), F.lit(FILES_PER_ITEM))
    points = points.repartition("item", salt)
    points.write.mode("overwrite").partitionBy("item").parquet(f"{path}/scatters")


def additivity(shap: DataFrame, key_cols: list[str]) -> DataFrame:
    """Sum of Shapley values plus base per row, to compare with the prediction."""
    require_columns(shap, key_cols)
    return shap.groupBy(*[col(k) for k in key_cols]).agg(
        (F.sum("shap_value") + F.first("base_value")).alias("explained")
    )
