"""Column statistics in one aggregate, and the decisions taken from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import chunks, col, is_numeric
from regatta.operators.quantiles import column_quantiles

COLUMNS_PER_JOB = 100
SKETCH_ERROR = 0.02
_UNORDERED = (T.MapType, T.VariantType)


@dataclass(frozen=True)
class ColumnStats:
    name: str
    n_rows: int
    n_missing: int
    constant: bool  # exactly one distinct non-null value
    n_distinct: int | None = None  # a sketch's estimate, on request

    @property
    def missing_fraction(self) -> float:
        return self.n_missing / self.n_rows if self.n_rows else 0.0


def column_stats(
    df: DataFrame, names: list[str] | None = None, count_distinct=()
) -> dict[str, ColumnStats]:
    """Row count, missing count and constancy of each column; a value is constant when
    its minimum equals its maximum, which is far cheaper than a distinct count. Columns in
    ``count_distinct`` get an estimate of that too, in the same pass."""
    names = list(names or df.columns)
    out: dict[str, ColumnStats] = {}
    for group in chunks(names, COLUMNS_PER_JOB):
        aggs = [F.count("*").alias("n")]
        for i, n in enumerate(group):
            aggs.append(F.count_if(col(n).isNull()).alias(f"m{i}"))
            if isinstance(df.schema[n].dataType, _UNORDERED):
                aggs.append(F.lit(False).alias(f"c{i}"))
            else:
                aggs.append((F.min(col(n)) == F.max(col(n))).alias(f"c{i}"))
            if n in count_distinct:
                aggs.append(F.approx_count_distinct(col(n), SKETCH_ERROR).alias(f"d{i}"))
        row = df.agg(*aggs).first()
        for i, n in enumerate(group):
            distinct = row[f"d{i}"] if n in count_distinct else None
            out[n] = ColumnStats(n, row["n"], row[f"m{i}"], bool(row[f"c{i}"]), distinct)
    return out


def column_stats_table(df: DataFrame, names: list[str], sparse_threshold: float = 0.2) -> DataFrame:
    """The same decisions as a table: ``column_name, missing_fraction, constant, kept``."""
    aggs = []
    for i, n in enumerate(names):
        aggs += [
            F.avg(col(n).isNull().cast("int")).alias(f"m{i}"),
            F.coalesce(F.min(col(n)) == F.max(col(n)), F.lit(False)).alias(f"c{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                F.col(f"m{i}").alias("missing_fraction"),
                F.col(f"c{i}").alias("constant"),
                ((F.col(f"m{i}") <= sparse_threshold) & ~F.col(f"c{i}")).alias("kept"),
            )
            for i, n in enumerate(names)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def prune_sparse_columns(
    stats: dict[str, ColumnStats], threshold: float = 0.2, exempt=()
) -> list[str]:
    """Columns whose missing fraction is strictly above the threshold."""
    return [
        s.name for s in stats.values()
        if s.name not in exempt and s.missing_fraction > threshold
    ]


def prune_constant_columns(stats: dict[str, ColumnStats], exempt=()) -> list[str]:
    return [s.name for s in stats.values() if s.name not in exempt and s.constant]


def prune_columns(df: DataFrame, threshold: float = 0.2, exempt=()) -> DataFrame:
    """Drop sparse columns and columns with a single value."""
    stats = column_stats(df)
    gone = set(prune_sparse_columns(stats, threshold, exempt))
    gone |= set(prune_constant_columns(stats, exempt))
    return df.drop(*gone)


def medians(df: DataFrame, names: list[str], n_rows: int | None = None) -> dict[str, float | None]:
    found = column_quantiles(df, names, [0.5], n_rows=n_rows)
    return {n: (q[0] if q else None) for n, q in found.items()}


def value_counts(
    df: DataFrame, names: list[str], limit: int | None = None,
    estimates: dict[str, int] | None = None,
) -> dict[str, list[tuple]]:
    """Non-null values of each column with their counts, in value order.

    With a ``limit`` a column with more distinct values is an error, checked with a
    distinct-count sketch (``estimates`` where it was taken before) ahead of collecting.
    """
    if not names:
        return {}
    if limit is not None and estimates is None:
        sketch = df.agg(
            *[
                F.approx_count_distinct(col(n), SKETCH_ERROR).alias(f"d{i}")
                for i, n in enumerate(names)
            ]
        ).first()
        estimates = {n: sketch[f"d{i}"] for i, n in enumerate(names)}
    for n in names if limit is not None else ():
        if estimates[n] > limit * 1.1:
            raise ValueError(f"column {n} has more than {limit} categories")
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), col(n).cast("string").alias("v"))
            for i, n in enumerate(names)
        ]
    )
    rows = (
        df.select(F.explode(pairs).alias("p"))
        .where("p.v IS NOT NULL")
        .groupBy("p.i", "p.v")
        .count()
        .collect()
    )
    out: dict[str, list[tuple]] = {}
    for i, n in enumerate(names):
        dtype = df.schema[n].dataType
        read = float if is_numeric(dtype) else str
        if isinstance(dtype, T.BooleanType):
            read = lambda text: text == "true"
        out[n] = sorted((read(r["v"]), r["count"]) for r in rows if r["i"] == i)
        if limit is not None and len(out[n]) > limit:
            raise ValueError(f"column {n} has more than {limit} categories")
    return out


def modes(df: DataFrame, names: list[str]) -> dict[str, object]:
    """The most frequent value of each column, ties to the smallest; null without values.

    Values are counted where they are and only one of each column reaches the driver.
    """
    if not names:
        return {}
    numeric = {n: is_numeric(df.schema[n].dataType) for n in names}
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("i"), col(n).cast("string").alias("v"),
            (col(n).cast("double") if numeric[n] else F.lit(None).cast("double")).alias("x"),
        )
        for i, n in enumerate(names)
    ])
    counted = df.select(F.explode(pairs).alias("p")).where("p.v IS NOT NULL").groupBy("p.i", "p.x", "p.v").count()
    best = counted.groupBy("i").agg(F.min(F.struct((-F.col("count")).alias("n"), "x", "v")).alias("best"))
    found = {names[r["i"]]: r["best"] for r in best.collect()}
    out: dict[str, object] = {}
    for n in names:
        r = found.get(n)
        if r is None:
            out[n] = None
        elif numeric[n]:
            out[n] = r["x"]
        else:
            out[n] = r["v"] == "true" if isinstance(df.schema[n].dataType, T.BooleanType) else r["v"]
    return out


def mode_of(counts: list[tuple]):
    """Most frequent value; ties go to the smallest."""
    return min(counts, key=lambda vc: (-vc[1], vc[0]))[0] if counts else None
