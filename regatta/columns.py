"""Small helpers around column names and types."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def chunks(items: list, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


def require_columns(df: DataFrame, names, what: str = "column") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown {what}(s): {', '.join(missing)}")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
