"""Exact quantiles that do not need one task to hold a column.

The built-in ``percentile`` keeps every distinct value of a column in one buffer, which is right
for small columns and fails beyond that. Above a checked size the values at all wanted ranks of
all columns, or of all large groups, are found together by narrowing: one pass sums up the values
between the bounds known so far in a small mergeable sketch, the next counts exactly how many lie
below and at a few values around each rank, and the bounds close in by the sketch's accuracy.
Only counts, sketches and a bounded set of candidate values reach the driver, and the answer is
the exact one, whatever the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import chunks, col
from regatta.models.partials import map_reduce

EXACT_LIMIT = 2_000_000  # rows, or distinct values per group, for the built-in percentile
FINISH_LIMIT = 50_000  # candidate rows that may be collected per rank
SUMMARY = 4_096  # values that a sketch keeps
SERIES_PER_LOT = 500  # columns, or large groups, that passes look at together
COLUMNS_PER_JOB = 24

Series = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]
"""The values of a batch by series, without nulls."""


@dataclass
class _Search:
    """Where the value at one rank of a series is known to lie: between two values, exclusively."""

    series: int
    rank: int
    size: int
    below: int = 0
    low: object = None
    high: object = None
    answer: object = None

    def interval(self) -> tuple:
        return self.series, self.low, self.high


def _inside(values: np.ndarray, low, high) -> np.ndarray:
    if low is not None:
        values = values[values > low]
    return values if high is None else values[values < high]


def _summed(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A sketch of sorted weighted values: at most ``size`` of them, at equal steps of weight."""
    if len(values) <= size:
        return values, weights
    ends = np.cumsum(weights)
    at = np.searchsorted(ends, (np.arange(size) + 0.5) * (ends[-1] / size))
    return values[np.minimum(at, len(values) - 1)], np.full(size, ends[-1] / size)


def _merged(a: tuple, b: tuple, size: int) -> tuple:
    values, weights = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(values, kind="stable")
    return _summed(values[order], weights[order], size)


def _sketches(df: DataFrame, series: Series, intervals: list[tuple], size: int) -> dict[int, tuple]:
    """A sketch of the values in each interval ``(series, low, high)``."""
    by_series: dict[int, list] = {}
    for k, (s, low, high) in enumerate(intervals):
        by_series.setdefault(s, []).append((k, low, high))

    def summarize(batches):
        out: dict[int, tuple] = {}
        for batch in batches:
            for s, values in series(batch):
                for k, low, high in by_series.get(s, ()):
                    kept = np.sort(_inside(values, low, high))
                    if len(kept):
                        new = (kept, np.ones(len(kept)))
                        # four times the size on the way, so that many merges add little error
                        out[k] = _merged(out[k], new, 4 * size) if k in out else _summed(*new, 4 * size)
        return {k: _summed(*v, size) for k, v in out.items()}

    return map_reduce(df, summarize, lambda a, b: _merged(a, b, size), size=16 * size * len(intervals))


def _counts(df: DataFrame, series: Series, probes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each series the rows between and at its sorted probes: gap, probe, gap, probe, ..., gap."""
    def summarize(batches):
        out = {s: np.zeros(2 * len(p) + 1, np.int64) for s, p in probes.items()}
        for batch in batches:
            for s, values in series(batch):
                if s in probes:
                    p = probes[s]
                    slot = np.searchsorted(p, values, "left") + np.searchsorted(p, values, "right")
                    out[s] += np.bincount(slot, minlength=2 * len(p) + 1)
        return out

    return map_reduce(df, summarize, lambda a, b: a + b)


def _candidates(df: DataFrame, series: Series, intervals: list[tuple], size: int) -> dict[int, tuple]:
    """The distinct values in each interval and their rows."""
    def tallied(values, counts):
        found, place = np.unique(values, return_inverse=True)
        return found, np.bincount(place, counts, len(found)).astype(np.int64)

    def summarize(batches):
        out: dict[int, list] = {}
        for batch in batches:
            for s, values in series(batch):
                for k, (t, low, high) in enumerate(intervals):
                    if s == t and len(kept := _inside(values, low, high)):
                        out.setdefault(k, []).append(kept)
        whole = {k: np.concatenate(v) for k, v in out.items()}
        return {k: tallied(v, np.ones(len(v))) for k, v in whole.items()}

    def combine(a, b):
        return tallied(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))

    return map_reduce(df, summarize, combine, size=16 * size * len(intervals))


def _search(
    df: DataFrame, series: Series, requests: list[tuple[int, int, int]], finish_limit: int,
    summary: int = SUMMARY,
) -> list:
    """Values at ``(series, size, rank)``; every pass serves all searches that are still open."""
    searches = [_Search(s, rank, size) for s, size, rank in requests]
    while active := [s for s in searches if s.answer is None]:
        large = [s for s in active if s.size > finish_limit]
        if not large:
            intervals = list(dict.fromkeys(s.interval() for s in active))
            found = _candidates(df, series, intervals, finish_limit)
            for s in active:
                values, counts = found.get(intervals.index(s.interval()), (np.zeros(0), np.zeros(0)))
                at = int(np.searchsorted(np.cumsum(counts), s.rank - s.below, "right"))
                if at >= len(values):
                    raise ValueError(f"rank {s.rank} is outside the column")
                s.answer = values[at].item()
            break
        intervals = list(dict.fromkeys(s.interval() for s in large))
        sketches = _sketches(df, series, intervals, summary)
        probes: dict[int, set] = {}
        for s in large:
            values, weights = sketches[intervals.index(s.interval())]
            ends = np.cumsum(weights)
            at = (s.rank - s.below + 0.5) / s.size
            places = np.searchsorted(ends, [(at + g) * ends[-1] for g in (-4 / summary, 0.0, 4 / summary)])
            probes.setdefault(s.series, set()).update(values[np.clip(places, 0, len(values) - 1)].tolist())
        sorted_probes = {k: np.array(sorted(v)) for k, v in probes.items()}
        counted = _counts(df, series, sorted_probes)
        for s in large:
            _shrink(s, sorted_probes[s.series], np.concatenate([[0], np.cumsum(counted[s.series])]))
    return [s.answer for s in searches]


def _shrink(s: _Search, probes: np.ndarray, before: np.ndarray) -> None:
    """Move the open interval next to the probes; an equal probe ends the search."""
    end = s.below + s.size
    for k, value in enumerate(probes.tolist()):
        start, after = int(before[2 * k + 1]), int(before[2 * k + 2])
        if (s.low is not None and value <= s.low) or (s.high is not None and value >= s.high):
            continue
        if s.rank < start:
            s.high, end = value, start
            break
        if s.rank < after:
            s.answer = value
            return
        s.low, s.below = value, after
    s.size = end - s.below


def _columns(n: int) -> Series:
    """Each of the first ``n`` columns of a batch as a series."""
    def series(batch):
        for k in range(n):
            values = pc.drop_null(batch.column(k))
            yield k, values.to_numpy(zero_copy_only=False)

    return series


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows ``series, value`` by series."""
    s, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
    order = np.argsort(s, kind="stable")
    found, first = np.unique(s[order], return_index=True)
    for k, part in zip(found.tolist(), np.split(values[order], first[1:]), strict=True):
        yield k, part


def values_at_ranks(
    df: DataFrame,
    requests: list[tuple[Column, int, int]],
    finish_limit: int = FINISH_LIMIT,
) -> list:
    """Exact values at 0-based ``rank`` among the ``size`` non-null values of a column.

    ``requests`` are ``(column, size, rank)``; the column must be orderable and numeric,
    without NaN.
    """
    names = list(dict.fromkeys(str(value) for value, _, _ in requests))
    columns = {str(value): value for value, _, _ in requests}
    out: list = [None] * len(requests)
    for lot in chunks(names, SERIES_PER_LOT):
        chosen = [k for k, (value, _, _) in enumerate(requests) if str(value) in lot]
        rows = df.select(*[columns[n].alias(f"c{i}") for i, n in enumerate(lot)])
        wanted = [(lot.index(str(requests[k][0])), *requests[k][1:]) for k in chosen]
        for k, value in zip(chosen, _search(rows, _columns(len(lot)), wanted, finish_limit), strict=True):
            out[k] = value
    return out


def _positions(n: int, q: float) -> tuple[int, int, float]:
    at = q * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    levels: list[float],
    exact_limit: int = EXACT_LIMIT,
    finish_limit: int = FINISH_LIMIT,
    n_rows: int | None = None,
) -> dict[str, list[float] | None]:
    """Interpolated quantiles of several column expressions; nulls are skipped.

    A name maps to ``None`` when its column holds no value.
    """
    names = list(values)
    if not names:
        return {}
    n_rows = df.count() if n_rows is None else n_rows
    out: dict[str, list[float] | None] = {}
    if n_rows <= exact_limit:
        for group in chunks(names, COLUMNS_PER_JOB):
            row = df.agg(
                *[F.percentile(values[n], levels).alias(f"q{i}") for i, n in enumerate(group)]
            ).first()
            for i, n in enumerate(group):
                out[n] = None if row[f"q{i}"] is None else list(row[f"q{i}"])
        return out
    row = df.agg(*[F.count(values[n]).alias(f"n{i}") for i, n in enumerate(names)]).first()
    sizes = {n: row[f"n{i}"] for i, n in enumerate(names)}
    requests = [(values[n], sizes[n], r) for n in names for r in _ranks(sizes[n], levels)]
    found = dict(zip(
        [(str(v), r) for v, _, r in requests], values_at_ranks(df, requests, finish_limit), strict=True))
    for n in names:
        at = {r: found[str(values[n]), r] for r in _ranks(sizes[n], levels)}
        out[n] = [_between(at, sizes[n], q) for q in levels] if at else None
    return out


def _ranks(n: int, levels: list[float]) -> list[int]:
    """The ranks that quantiles of ``n`` values lie between."""
    return sorted({r for q in levels for r in _positions(n, q)[:2]}) if n else []


def _between(at: dict[int, float], n: int, q: float) -> float:
    low, high, weight = _positions(n, q)
    return float(at[low]) + (float(at[high]) - float(at[low])) * weight


def column_quantiles(df: DataFrame, names: list[str], levels: list[float], **kw) -> dict:
    return exact_quantiles(df, {n: col(n).cast("double") for n in names}, levels, **kw)


def grouped_quantiles(
    df: DataFrame,
    by: str,
    value: str,
    levels: list[float],
    exact_limit: int = EXACT_LIMIT,
    finish_limit: int = FINISH_LIMIT,
) -> DataFrame:
    """One row per group: ``by``, ``n``, ``q array<double>``.

    Groups with few distinct values use the built-in percentile. Those too large for one buffer
    are numbered in a table that is joined back to the rows, and searched together, some hundred
    in a lot; there are at most ``rows / exact_limit`` such groups.
    """
    spark = df.sparkSession
    base = df.select(col(by).alias("g"), col(value).cast("double").alias("v"))
    hot = (
        base.groupBy("g")
        .agg(F.count("v").alias("n"), F.approx_count_distinct("v").alias("d"))
        .where((F.col("n") > exact_limit) & (F.col("d") > exact_limit * 0.8))
        .orderBy("g")
        .collect()
    )
    if not hot:
        out = base.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", levels).alias("q"))
        return out.withColumnRenamed("g", by)
    kind = base.schema["g"].dataType
    numbered = F.broadcast(spark.createDataFrame(
        [(r["g"], i) for i, r in enumerate(hot)], T.StructType([T.StructField("hot", kind), T.StructField("s", T.IntegerType())])))
    joined = base.join(numbered, F.col("g").eqNullSafe(F.col("hot")), "left")
    out = joined.where("s IS NULL").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", levels).alias("q"))
    rows = []
    for lot in chunks(list(range(len(hot))), SERIES_PER_LOT):
        part = joined.where(F.col("s").between(lot[0], lot[-1]) & F.col("v").isNotNull()).select("s", "v")
        wanted = [(i, hot[i]["n"], r) for i in lot for r in _ranks(hot[i]["n"], levels)]
        found = dict(zip([(i, r) for i, _, r in wanted], _search(part, _keyed, wanted, finish_limit), strict=True))
        for i in lot:
            at = {r: found[i, r] for r in _ranks(hot[i]["n"], levels)}
            rows.append((hot[i]["g"], hot[i]["n"], [_between(at, hot[i]["n"], q) for q in levels]))
    return out.unionByName(spark.createDataFrame(rows, out.schema)).withColumnRenamed("g", by)
