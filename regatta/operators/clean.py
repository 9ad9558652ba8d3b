"""Cleaning steps that are plain projections and filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import col, is_fractional, require_columns, total

# A spreadsheet's error marker, and the target -> leaking columns table.
SENTINEL_TEXT = "#NAME?"
COMPOSITE_TARGET = "DASS_Sum"
LEAKING_COLUMNS = {
    "CTPI_Mean": ["CTPI_Harried_Mean", "CTPI_Cognitive_Mean"],
    "CTPI_Harried_Mean": ["CTPI_Mean", "CTPI_Cognitive_Mean"],
    "CTPI_Cognitive_Mean": ["CTPI_Mean", "CTPI_Harried_Mean"],
    "DASS_Sum": ["DASS_Depr_Sum", "DASS_Stress_Sum", "DASS_Anxiety_Sum"],
    "DASS_Depr_Sum": ["DASS_Sum", "DASS_Stress_Sum", "DASS_Anxiety_Sum"],
    "DASS_Stress_Sum": ["DASS_Sum", "DASS_Depr_Sum", "DASS_Anxiety_Sum"],
    "DASS_Anxiety_Sum": ["DASS_Sum", "DASS_Depr_Sum", "DASS_Stress_Sum"],
}


def clean_sentinels(df: DataFrame, recast: tuple[str, ...] = ()) -> DataFrame:
    """Infinities, NaN and the spreadsheet error text become NULL in every column.

    ``recast`` names text columns that hold numbers damaged by such markers.
    """
    require_columns(df, recast)

    def cleaned(field: T.StructField) -> Column:
        c = col(field.name)
        if is_fractional(field.dataType):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            return F.when(~bad, c).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            c = F.nullif(c, F.lit(SENTINEL_TEXT))
            if field.name in recast:
                number = c.try_cast("double")
                bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
                c = F.when(~bad, number)
        return c.alias(field.name)

    return df.select(*[cleaned(f) for f in df.schema.fields])


def missing_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``column_name, missing_pct`` for every column with missing values, one pass."""
    names = list(names or df.columns)
    require_columns(df, names)
    pct = [
        F.round(F.avg(col(n).isNull().cast("int")) * 100, 2).alias(f"m{i}")
        for i, n in enumerate(names)
    ]
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.col(f"m{i}").alias("missing_pct"))
            for i, n in enumerate(names)
        ]
    )
    return df.agg(*pct).select(F.inline(pairs)).where("missing_pct > 0")


def all_present(names: list[str]) -> Column:
    return reduce(and_, [col(n).isNotNull() for n in names])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    require_columns(df, [target], "target")
    return df.where(col(target).isNotNull())


def row_sum(names: list[str], skipna: bool = False) -> Column:
    """Sum across columns; with ``skipna`` a missing part counts as 0."""
    parts = [col(n) for n in names]
    if skipna:
        parts = [F.coalesce(p, F.lit(0)) for p in parts]
    return total(parts)


def composite_target(
    df: DataFrame, target: str, parts: list[str], skipna: bool = False
) -> DataFrame:
    """Rows with every part present, plus their sum as ``target`` where it is absent.

    With ``skipna`` the sum is added first, over all rows, counting missing parts as 0.
    """
    require_columns(df, parts, "component")
    if skipna:
        return df if target in df.columns else df.withColumn(target, row_sum(parts, True))
    df = df.where(all_present(parts))
    if target in df.columns:
        return drop_missing_target(df, target)
    return df.withColumn(target, row_sum(parts))


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop columns; a name that does not exist is an error."""
    require_columns(df, names)
    return df.drop(*names)


def drop_leaky(df: DataFrame, target: str, leaks: dict[str, list[str]] | None = None) -> DataFrame:
    leaks = LEAKING_COLUMNS if leaks is None else leaks
    return df.drop(*leaks.get(target, []))


def rename_columns(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Relabel columns; names without a label stay."""
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep the wanted order and skip what is not there."""
    return df.select(*[col(n) for n in wanted if n in df.columns])


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[col(o) for o in order]).limit(n)
