"""Exact top-k search by inner product with vector-approximation files.

Every component becomes a cell number; a block of vectors keeps the smallest and largest value of
each of its cells. From these a scan gets a lower and an upper bound of each score, two matrix
products for a block. The exact vectors are then read in order of their upper bound until the
k-th result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regatta.llm.schemas import arrow_schema
from regatta.session import materialize

CELLS = 16
FIT_ROWS = 20_000
"""Rows from which cell limits are taken; they change the speed, not the result."""
BLOCK_ROWS = 2048
QUERY_ROWS = 8192
"""Queries that one pass over the index answers; tasks hold their vectors."""
SEED_BLOCKS = 16
"""Blocks whose bounds give the first threshold of each query."""

BLOCKS = "block long, n int, ids binary, width int, exact binary, codes binary, low binary, high binary"
ANSWERS = "query_id long, vec_id long, score long"


def whole(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(
        x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: in floats as far as these are exact, else in whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if top < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.array(a.astype(object) @ b.astype(object).T)


def cell_limits(vectors: DataFrame, width: int, cells: int, fit_rows: int) -> np.ndarray:
    """Per component the limits between cells, from quantiles of a bounded sample by id hash."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    parts = [k / cells for k in range(1, cells)]
    found = sample.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(
        F.percentile_approx("x", parts, 1000).alias("limits")
    )
    limits = np.zeros((width, cells - 1), np.int64)
    for row in found.collect():
        limits[row["at"]] = row["limits"]
    return limits


def build_index(
    vectors: DataFrame, width: int, cells: int = CELLS, fit_rows: int = FIT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The written index of all rows of ``vectors`` (id long, v array<long>)."""
    limits = cell_limits(vectors, width, cells, fit_rows)
    schema = arrow_schema(BLOCKS)

    def block(number: int, ids: list[int], rows: list) -> pa.RecordBatch:
        exact = _matrix(rows, width)
        codes = np.zeros(exact.shape, np.uint8)
        low, high = np.zeros((2, width, cells), np.int64)
        for j in range(width):
            codes[:, j] = np.searchsorted(limits[j], exact[:, j], "right")
            for c in np.unique(codes[:, j]):
                inside = exact[codes[:, j] == c, j]
                low[j, c], high[j, c] = inside.min(), inside.max()
        top = int(np.abs(exact).max(initial=0))
        kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k - 1))
        return pa.RecordBatch.from_pylist([{
            "block": number, "n": len(ids), "ids": np.array(ids, np.int64).tobytes(),
            "width": kind, "exact": exact.astype(f"<i{kind}").tobytes(), "codes": codes.tobytes(),
            "low": low.tobytes(), "high": high.tobytes(),
        }], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), block_rows):
                yield block(number, ids[a:a + block_rows], rows[a:a + block_rows])
                number += 1

    return materialize(vectors.mapInArrow(blocks, BLOCKS))


class _Search:
    """The best results so far of some queries, in one task."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, k: int, floor: np.ndarray | None):
        self.ids, self.exact, self.k = ids, exact, k
        self.positive, self.negative = np.maximum(exact, 0), np.minimum(exact, 0)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def bounds(self, row: dict, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of a block's vectors."""
        width = self.exact.shape[1]
        low = np.frombuffer(row["low"], np.int64).reshape(width, -1)
        high = np.frombuffer(row["high"], np.int64).reshape(width, -1)
        codes = np.frombuffer(row["codes"], np.uint8).reshape(row["n"], width)
        at = np.arange(width)
        low, high = low[at, codes], high[at, codes]
        p, n = self.positive[part], self.negative[part]
        return (
            _product(p, low) + _product(n, high),
            _product(p, high) + _product(n, low),
        )

    def thresholds(self, row: dict) -> None:
        """Raise each query's floor to the k-th largest lower bound seen."""
        ids = np.frombuffer(row["ids"], np.int64)
        lower, _ = self.bounds(row, slice(None))
        lower = lower.astype(np.float64)
        lower[self.ids[:, None] == ids[None, :]] = -np.inf
        for q in range(len(self.ids)):
            near = np.sort(np.concatenate([lower[q], [s for s, _ in self.best[q]]]))[-self.k:]
            self.best[q] = [(s, 0) for s in near]
            if len(near) == self.k:
                self.floor[q] = near[0]

    def scan(self, row: dict) -> None:
        ids = np.frombuffer(row["ids"], np.int64)
        exact = np.frombuffer(row["exact"], f"<i{row['width']}").reshape(row["n"], -1)
        for a in range(0, len(self.ids), 512):
            part = slice(a, a + 512)
            lower, upper = self.bounds(row, part)
            own = self.ids[part, None] == ids[None, :]
            if row["n"] > self.k:
                near = np.where(own, -np.inf, lower.astype(np.float64))
                near = -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1]
                near = np.maximum(near, self.floor[part])
            else:
                near = self.floor[part]
            some = (upper >= near[:, None]) & ~own
            for q in np.flatnonzero(some.any(axis=1)).tolist():
                self.read(a + q, ids, exact, upper[q], np.flatnonzero(some[q]))

    def read(self, q: int, ids: np.ndarray, exact: np.ndarray, upper: np.ndarray, at: np.ndarray) -> None:
        """Exact vectors in order of their upper bound, until none can enter the best k."""
        at = at[np.lexsort((ids[at], -upper[at]))]
        best = self.best[q]
        for first in range(0, len(at), 4 * self.k):
            part = at[first:first + 4 * self.k]
            if len(best) == self.k:
                least, last = best[-1]
                part = part[(upper[part] > least) | ((upper[part] == least) & (ids[part] < last))]
                if not len(part) and upper[at[first]] < least:
                    break
            if not len(part):
                continue
            scores = _product(self.exact[q:q + 1], exact[part].astype(np.int64))[0]
            best = sorted(
                [*best, *((int(s), int(i)) for s, i in zip(scores, ids[part], strict=True))],
                key=lambda x: (-x[0], x[1]),
            )[:self.k]
        self.best[q] = best
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], best[-1][0])

    def answers(self) -> pa.RecordBatch:
        rows = [
            (int(q), i, s) for q, best in zip(self.ids, self.best, strict=True) for s, i in best
        ]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], schema=arrow_schema(ANSWERS)
        )


def _answers(index: DataFrame, ids: np.ndarray, exact: np.ndarray, k: int) -> DataFrame:
    """Each task's best results for a bounded set of queries."""
    send = index.sparkSession.sparkContext.broadcast
    asked = send((ids, exact))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*asked.value, k, None)
        for batch in batches:
            for row in batch.to_pylist():
                search.thresholds(row)
        floor = pa.array([search.floor.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([floor], names=["floor"])

    bounds = "block", "n", "ids", "codes", "low", "high"
    first = index.select(*bounds).orderBy("block").limit(SEED_BLOCKS).coalesce(1)
    floors = [np.frombuffer(r["floor"]) for r in first.mapInArrow(seed, "floor binary").collect()]
    floor = send(np.max(floors, axis=0) if floors else np.full(len(ids), -np.inf))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*asked.value, k, floor.value.copy())
        for batch in batches:
            for at in range(batch.num_rows):
                search.scan(batch.slice(at, 1).to_pylist()[0])
        yield search.answers()

    return index.mapInArrow(scan, ANSWERS)


def top_k(
    vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
    vector_col: str = "embedding", scale: int = 64, cells: int = CELLS,
    fit_rows: int = FIT_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` highest inner products of each query with all other vectors.

    Queries are the rows whose id is divisible by ``every``; ties go to the smaller id. The index
    is read once for each ``query_rows`` queries, whose vectors are the only thing sent to all
    tasks; no vector is shuffled. Rows whose id or vector is null, or whose vector holds a null
    or non-finite component, take no part. A shorter vector counts as filled up with zeros.
    Repeated ids: each row is a candidate (of other ids), and the query is the smallest vector
    of its id. Scores beyond 64 bits are an error. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole(vector_col, scale).alias("v"))
    rows = rows.where("id is not null and v is not null")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    if not size:
        size = 1
    index = build_index(rows, size, cells, fit_rows)
    asked = materialize(asked)
    n = asked.count()
    passes = max(1, -(-n // query_rows))
    found = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        part = part.orderBy("id").collect()
        ids = np.array([r["id"] for r in part], np.int64)
        answers = _answers(index, ids, _matrix([r["v"] for r in part], size), k)
        found = answers if found is None else found.unionByName(answers)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
