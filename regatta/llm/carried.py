"""Rows carried whole through an operator, so that its own columns clash with none of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_rows(df: DataFrame, *beside: str, **columns: Column) -> DataFrame:
    """The rows of ``df`` as the one column ``row``, with ``columns`` next to it.

    Whatever names an operator uses next to ``row`` cannot clash with those of ``df``. Columns
    ``beside`` the row are not in it, so that they need not travel twice.
    """
    row = F.struct(*(F.col(quoted(c)) for c in df.columns if c not in beside)).alias("row")
    return df.select(row, *beside, *(c.alias(n) for n, c in columns.items()))


def rows_with(found: DataFrame, names: list[str], *results: str) -> DataFrame:
    """The columns ``names`` of the rows, without those named like a result, and the results."""
    taken, inside = {r.lower() for r in results}, found.schema["row"].dataType.names
    return found.select(*(
        (F.col("row").getField(n) if n in inside else F.col(quoted(n))).alias(n)
        for n in names if n.lower() not in taken
    ), *results)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many marks as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def moved_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named like ``names`` renamed, and where its columns are now, in order."""
    places = []
    for c in df.columns:
        place = free_name(df, c) if c.lower() in names else c
        df = df.withColumnRenamed(c, place) if place != c else df
        places.append(place)
    return df, places
