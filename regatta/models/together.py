"""Many iterative fits over one table, step by step, sharing their passes.

A fit is a generator: it yields a ``Step``, what it needs from the rows, and gets the sums back;
it returns its model. All fits that wait are served by the same pass, each on the rows outside
the fold that it leaves out. A fit gets the same sums alone or among others.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from regatta.columns import col
from regatta.functions.hashing import add_key_hash
from regatta.models.base import complete_rows
from regatta.models.partials import map_reduce, matrix
from regatta.operators.transforms import TargetTransform, robust_fit
from regatta.session import materialize, read_table_at, remove_table, write_table

BYTES_PER_PASS = 128 << 20
"""What the steps of a pass may hold in a task together; more take several passes."""
RECORD_BYTES = 1024
"""Of rows in one record of the packed table: an Arrow batch of 10,000 records takes 10 MB."""
RUN_ROWS = 8192
"""Rows of one fold that are packed one after the other, and given to a step together."""


class Step:
    """What a fit needs from the rows. Sums of tasks meet by ``combine``.

    ``start`` makes a task's state, ``add`` takes rows into it, and ``sums`` gives arrays by a
    small number. ``size`` bounds the bytes of both, and of what is sent to a task.
    """

    size = 1 << 16

    def start(self):
        raise NotImplementedError

    def add(self, state, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> None:
        raise NotImplementedError

    def sums(self, state) -> dict[int, object]:
        return {0: state}

    def combine(self, a, b):
        return a + b


@dataclass
class Request:
    """A fit's step with the label it reads and the fold it leaves out."""

    step: Step
    label: int
    fold: int | None


@dataclass(frozen=True)
class Job:
    """A model to fit: parameters, seed, its label with the transform behind it, the fold left out."""

    params: dict
    seed: int = 0
    transform: TargetTransform = TargetTransform()
    label: int = 0
    fold: int | None = None


@dataclass
class FitTable:
    """Complete rows as ``f0 ... y0 ... fold h``, their scalings by left-out fold, and a count of passes.

    Passes that need no order read the rows packed: many rows of one fold side by side in a record,
    which reach Python at a fraction of the cost of as many rows.
    """

    rows: DataFrame
    features: list[str]
    names: list[str]
    labels: list[str]
    scalings: dict = field(default_factory=dict)
    dealings: dict = field(default_factory=dict)
    cuts: dict = field(default_factory=dict)
    passes: int = 0
    _packed: tuple | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False, compare=False)

    def __post_init__(self):
        self.tasks = self.rows.rdd.getNumPartitions()  # a stored table: no job

    @staticmethod
    def of(
        df: DataFrame, features: list[str], labels: list, key_cols: list[str] = (), fold_col: str | None = None,
    ) -> "FitTable":
        names, ys = [f"f{i}" for i in range(len(features))], [f"y{i}" for i in range(len(labels))]
        rows = add_key_hash(df, list(key_cols), "__h").select(
            *[col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)],
            *[y.cast("double").alias(n) for y, n in zip(labels, ys, strict=True)],
            (F.col(fold_col) if fold_col else F.lit(-1)).cast("int").alias("fold"),
            F.col("__h").cast("bigint").alias("h"),
        )
        rows = materialize(complete_rows(rows, [*names, *ys]))
        return FitTable(rows, list(features), names, ys)

    def without(self, fold: int | None) -> DataFrame:
        return self.rows if fold is None else self.rows.where(F.col("fold") != fold)

    def scaling(self, fold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Center and scale of the features outside a fold, found once."""
        if fold not in self.scalings:
            fitted = robust_fit(self.without(fold), self.names)
            self.scalings[fold] = tuple(np.array([fitted[n][k] for n in self.names]) for k in (0, 1))
        return self.scalings[fold]

    def label_summary(self, label: int, fold: int | None) -> tuple[int, float, float]:
        """Rows, mean and deviation of a label outside a fold."""
        key = ("label", label, fold)
        if key not in self.scalings:
            y = self.labels[label]
            r = self.without(fold).agg(
                F.count("*").alias("n"), F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
            self.scalings[key] = (r["n"], float(r["m"] or 0.0), float(r["s"] or 0.0))
        return self.scalings[key]

    def dealt(self, workers: int) -> DataFrame:
        """The rows dealt to workers by their hash, in the order of the hash; kept until ``close``."""
        if workers not in self.dealings:
            rows = self.rows.repartition(workers, "h").sortWithinPartitions("h", *self.names)
            self.dealings[workers] = rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self.dealings[workers]

    def packed(self) -> DataFrame:
        """The rows as records ``fold, block``, dealt to all cores; kept until ``close``."""
        with self._lock:
            if self._packed is None:
                rows, cores = self.rows, self.rows.sparkSession.sparkContext.defaultParallelism
                if self.tasks < cores:
                    rows = rows.repartition(cores)
                rows = rows.mapInArrow(_packer(self.names, self.labels), "fold int, block binary")
                path = write_table(rows)
                self._packed = read_table_at(rows.sparkSession, path, rows.schema), path
            return self._packed[0]

    def close(self) -> None:
        for rows in self.dealings.values():
            rows.unpersist()
        self.dealings = {}
        if self._packed is not None:
            remove_table(self.rows.sparkSession, self._packed[1])
            self._packed = None


def _record_rows(width: int) -> int:
    return max(1, RECORD_BYTES // (8 * width))


def _run_records(width: int) -> int:
    return max(1, RUN_ROWS // _record_rows(width))


def _packer(names: list[str], labels: list[str]) -> Callable:
    """Rows of one fold as numbers row by row, features, labels and hash, in records of few rows."""
    width = len(names) + len(labels) + 1
    step, enough = _record_rows(width), RUN_ROWS

    def records(fold: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        blocks = [rows[at:at + step].tobytes() for at in range(0, len(rows), step)]
        folds = pa.array(np.full(len(blocks), fold), pa.int32())
        return pa.RecordBatch.from_arrays([folds, pa.array(blocks, pa.binary())], names=["fold", "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            rows = np.empty((batch.num_rows, width))
            rows[:, :-1] = matrix(batch, [*names, *labels])
            rows.view(np.int64)[:, -1] = batch.column(batch.schema.get_field_index("h")).to_numpy()
            folds = batch.column(batch.schema.get_field_index("fold")).fill_null(-1).to_numpy()
            for fold in np.unique(folds).tolist():
                parts = waiting.setdefault(fold, [])
                parts.append(rows[folds == fold])
                if sum(map(len, parts)) >= enough:
                    yield records(fold, waiting.pop(fold))
        for fold, parts in waiting.items():
            yield records(fold, parts)

    return pack


def _runs(batch: pa.RecordBatch, width: int, many: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one fold, of at most so many records, with a row for each of their columns."""
    folds, blocks = batch.column(0).to_numpy(), batch.column(1)
    bounds = [0, *(np.flatnonzero(np.diff(folds)) + 1).tolist(), len(folds)]
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        for at in range(start, end, many):
            rows = np.frombuffer(b"".join(blocks.slice(at, min(many, end - at)).to_pylist()))
            yield int(folds[start]), np.ascontiguousarray(rows.reshape(-1, width).T)


def fit_together(table: FitTable, fits: list[Generator], workers: int | None = None) -> list:
    """Run fits to their ends and return what each returns, in order."""
    out: list = [None] * len(fits)
    waiting: dict[int, Request] = {}

    def advance(k: int, found) -> None:
        try:
            waiting[k] = fits[k].send(found)
        except StopIteration as end:
            out[k] = end.value

    for k in range(len(fits)):
        advance(k, None)
    while waiting:
        rows = table.packed() if workers is None else table.dealt(workers)
        served, waiting = waiting, {}
        for part in _parts(served):
            table.passes += 1
            for k, found in _pass(rows, workers, table, part).items():
                advance(k, found)
    return out


def _parts(requests: dict[int, Request]) -> Iterator[dict[int, Request]]:
    part, size = {}, 0
    for k, request in requests.items():
        if part and size + request.step.size > BYTES_PER_PASS:
            yield part
            part, size = {}, 0
        part[k] = request
        size += request.step.size
    yield part


SUMS = 1 << 22
"""Numbers of the arrays of one fit; more than any step has."""


def _pass(rows: DataFrame, workers: int | None, table: FitTable, requests: dict[int, Request]) -> dict[int, dict]:
    shared = rows.sparkSession.sparkContext.broadcast(requests)
    names, labels = table.names, table.labels
    tasks = rows.rdd.getNumPartitions() if workers is None else workers
    d, width = len(names), len(names) + len(labels) + 1
    many = _run_records(width)

    def add_packed(states: dict, batch: pa.RecordBatch) -> None:
        for fold, columns in _runs(batch, width, many):
            x, ys, h = columns[:d].T, columns[d:-1], columns[-1].view(np.int64)
            for k, request in shared.value.items():
                if request.fold is None or request.fold != fold:
                    request.step.add(states[k], x, ys[request.label], h)

    def add_rows(states: dict, batch: pa.RecordBatch) -> None:
        x, ys = matrix(batch, names), matrix(batch, labels)
        fold, h = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("fold", "h"))
        kept, kept_y = {}, {}
        for k, request in shared.value.items():
            at = request.fold, request.label
            if request.fold not in kept:
                mine = slice(None) if request.fold is None else np.flatnonzero(fold != request.fold)
                kept[request.fold] = mine, x[mine], h[mine]
            mine, x_mine, h_mine = kept[request.fold]
            if at not in kept_y:
                kept_y[at] = np.ascontiguousarray(ys[mine, request.label])
            request.step.add(states[k], x_mine, kept_y[at], h_mine)

    def summarize(batches: Iterator[pa.RecordBatch]) -> dict:
        states = {k: r.step.start() for k, r in shared.value.items()}
        for batch in batches:
            (add_packed if workers is None else add_rows)(states, batch)
        out = {}
        for k, request in shared.value.items():
            for i, value in request.step.sums(states[k]).items():
                out[k * SUMS + i] = (k, value)
        return out

    def combine(a, b):
        return a[0], shared.value[a[0]].step.combine(a[1], b[1])

    out: dict[int, dict] = {k: {} for k in requests}
    size = sum(r.step.size for r in requests.values())
    for key, (k, value) in map_reduce(rows, summarize, combine, tasks, size).items():
        out[k][key - k * SUMS] = value
    shared.unpersist()
    return out
