"""Imputation and one-hot encoding as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, is_numeric, require_columns
from regatta.operators import stats as S


def impute_median(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Missing numbers get the exact median of their column."""
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType)] if names is None else names
    found = S.medians(df, names)
    return df.withColumns(
        {
            n: F.coalesce(col(n).cast("double"), F.lit(float(m)))
            for n, m in found.items()
            if m is not None
        }
    )


def impute_mode(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing categories get the most frequent value of their column."""
    fills = S.modes(df, names)
    return df.withColumns(
        {
            n: F.coalesce(col(n), F.lit(v).cast(df.schema[n].dataType))
            for n, v in fills.items()
            if v is not None
        }
    )


def label_of(value) -> str:
    """How a category appears in a column name; whole numbers carry no fraction."""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def dummy(source: Column, numeric: bool, value) -> Column:
    if numeric:
        return source.cast("double") == F.lit(float(value))
    return source == F.lit(value)


def one_hot(df: DataFrame, names: list[str], max_categories: int | None = None) -> DataFrame:
    """One boolean column ``{column}_{value}`` per value, after the other columns."""
    require_columns(df, names, "categorical")
    counts = S.value_counts(df, names, max_categories)
    others = [col(n) for n in df.columns if n not in names]
    dummies = [
        F.coalesce(dummy(col(n), is_numeric(df.schema[n].dataType), v), F.lit(False)).alias(
            f"{n}_{label_of(v)}"
        )
        for n in names
        for v, _ in counts[n]
    ]
    return df.select(*others, *dummies)
