"""Training rows with coded features, and passes over them that serve many trees at once.

Features are coded once, each value as the number of cuts below it. A pass adds up, for every
tree that asks, rows and residuals per open node, feature and code. A model leaves out one fold,
and its fit so far is a stored number plus what its latest trees add, so that models of different
folds and parameters share every scan.

Few bins and features make few different rows. If all of them fit into a task, rows with equal codes
are one row from the start, with its copies and label sums for each draw of rows: a fit depends on
nothing else, and its passes no longer read every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.models.extra import bag_weights, row_uniform
from regatta.models.partials import map_reduce, matrix
from regatta.models.together import FitTable
from regatta.session import materialize

BLOCK_ROWS = 1 << 17
"""Rows a task looks at together."""

CELLS_PER_PASS = 4_000_000
"""Cells (node, feature, code) that a task holds, 16 bytes each; more take several passes."""

SLICE = 256
"""Nodes per array that travels."""

SUMMED_BYTES = 256 << 20
"""What a task may hold of the sums of rows with equal codes; beyond, the table keeps every row."""

OTHER_FOLD = -(1 << 31)
"""The fold of summed rows that no model leaves out."""


def few_values(rows: DataFrame, names: list[str], most: int) -> dict[str, np.ndarray]:
    """The distinct values of the columns that have at most so many, from one pass."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0)] * len(names)
        for batch in batches:
            for j, name in enumerate(names):
                if len(held[j]) <= most:
                    held[j] = np.unique(np.concatenate([held[j], matrix(batch, [name])[:, 0]]))[:most + 1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [len(v) for v in held])),
            pa.array(np.concatenate(held))], names=["j", "value"])

    values = F.slice(F.sort_array(F.collect_set("value")), 1, most + 1).alias("values")
    found = rows.select(*names).mapInArrow(distinct, "j int, value double").groupBy("j").agg(values).collect()
    known = {r["j"]: np.array(r["values"]) for r in found}
    every = {n: known.get(j, np.zeros(0)) for j, n in enumerate(names)}
    return {n: v for n, v in every.items() if len(v) <= most}


def feature_cuts(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts of each column, for at most ``bins`` codes.

    A column of few distinct values has a cut halfway between each two of them, whatever their
    numbers; others have cuts at approximate quantiles.
    """
    found = few_values(rows, names, 2 * bins)
    few, levels = list(found), [k / bins for k in range(1, bins)]
    asked = [F.percentile_approx(n, levels, 100 * bins).alias(n) for n in names if n not in found]
    if asked:
        found |= rows.agg(*asked).first().asDict()
    out = []
    for n in names:
        values = np.unique(np.array([] if found[n] is None else found[n], dtype=float))
        if n in few and len(values) <= bins:
            out.append((values[:-1] + values[1:]) / 2 if len(values) > 1 else np.zeros(0))
        elif n in few:
            out.append(values[np.unique(np.linspace(0, len(values) - 1, bins).astype(int))][:-1])
        else:
            out.append(values)
    return out


@dataclass
class CodedTree:
    """A tree over codes: rows go left when their code is at most ``cut``; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        if self.feature[0] < 0:
            return at
        moving = np.arange(len(codes))
        while len(moving):
            node = at[moving]
            left = codes[moving, self.feature[node]] <= self.cut[node]
            at[moving] = node = np.where(left, self.left[node], self.right[node])
            moving = moving[self.feature[node] >= 0]
        return at


@dataclass(frozen=True)
class Draw:
    """Which rows a tree sees: all, Poisson(1) copies of each, or a share; a function of the key."""

    kind: str = "all"
    number: int = 0
    seed: int = 0
    share: float = 1.0

    def weights(self, row_hash: np.ndarray) -> np.ndarray | None:
        if self.kind == "all":
            return None
        if self.kind == "poisson":
            return bag_weights(row_hash, self.number, self.seed)
        return (row_uniform(row_hash, self.number, self.seed) < self.share).astype(float)


@dataclass
class Request:
    """Nodes of one tree whose histograms a pass shall add up."""

    tree: CodedTree
    nodes: list[int]
    columns: np.ndarray
    draw: Draw


@dataclass
class Learner:
    """What a pass has to know of a model: its label, the fold it leaves out, its fit so far."""

    label: int
    fold: int | None
    base: float = 0.0
    recent: list[tuple[CodedTree, float]] = field(default_factory=list)
    requests: list[Request] = field(default_factory=list)


class BinnedTable:
    """Coded features, labels, fold, row hash and the stored fits of ``learners`` models.

    A row is one binary value, so that a pass hands a single column to Python. With ``draws``, all
    that the models ask for, and ``folds``, all that they leave out, rows of equal codes are summed
    if the sums are few enough.
    """

    def __init__(
        self, source: FitTable, bins: int, learners: int = 1, draws: list[Draw] = (), folds: list[int] = (),
    ):
        self.source, self.labels, self.learners = source, source.labels, learners
        names = source.names
        if bins not in source.cuts:
            source.cuts[bins] = feature_cuts(source.rows, names, bins)
        self.cuts = source.cuts[bins]
        self.bins = max(len(c) for c in self.cuts) + 1
        codes = ("codes", "u1" if self.bins <= 256 else "<u2", (len(names),))
        shape, self.passes = [len(c) + 1 for c in self.cuts], 0
        kinds = math.prod(shape) * (len(folds) + 1)  # a Python number: any number of features
        self.draws = None
        if draws and 8 * kinds * len(draws) * (1 + len(self.labels)) <= SUMMED_BYTES:
            self.draws = {draw: k for k, draw in enumerate(draws)}
            self.row = np.dtype([
                ("n", "<f8", (len(draws),)), ("y", "<f8", (len(draws), len(self.labels))),
                ("fits", "<f8", (learners,)), ("fold", "<i4"), codes,
            ])
            self._take(materialize(self._summed(source.rows, names, shape, sorted(folds))))
            return
        self.row = np.dtype([
            ("y", "<f8", (len(self.labels),)), ("fits", "<f8", (learners,)), ("h", "<i8"), ("fold", "<i4"), codes,
        ])
        self._take(materialize(self._coded(source.rows, names)))

    def _take(self, rows: DataFrame) -> None:
        self.rows, self.tasks = rows, rows.rdd.getNumPartitions()  # a stored table: no job

    def _coded(self, rows: DataFrame, names: list[str]) -> DataFrame:
        cuts, labels, kind = self.cuts, self.labels, self.row

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, out = matrix(batch, names), np.zeros(batch.num_rows, kind)
                for j, c in enumerate(cuts):
                    out["codes"][:, j] = np.searchsorted(c, x[:, j], "left")
                out["y"] = matrix(batch, labels)
                for name in ("h", "fold"):
                    out[name] = batch.column(batch.schema.get_field_index(name)).to_numpy()
                yield pa.RecordBatch.from_arrays([binary(out)], names=["row"])

        return rows.mapInArrow(code, "row binary")

    def _summed(self, rows: DataFrame, names: list[str], shape: list[int], folds: list[int]) -> DataFrame:
        """One row for all rows of equal codes and fold: copies and label sums by draw."""
        cuts, labels, kind, draws = self.cuts, self.labels, self.row, list(self.draws)
        shape, known = (len(folds) + 1, *shape), np.array(folds, np.int64)
        kinds, parts = math.prod(shape), 1 + len(labels)
        sums = [f"s{i}" for i in range(len(draws) * parts)]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(sums), kinds))

            def book(held: list[pa.RecordBatch]) -> None:
                x, y = (np.concatenate([matrix(b, n) for b in held]) for n in (names, labels))
                fold, h = (
                    np.concatenate([b.column(b.schema.get_field_index(n)).to_numpy() for b in held])
                    for n in ("fold", "h"))
                place = np.full(len(x), len(known))
                for k, f in enumerate(known):
                    place[fold == f] = k
                for j, c in enumerate(cuts):
                    place *= len(c) + 1
                    place += np.searchsorted(c, x[:, j], "left")
                for k, draw in enumerate(draws):
                    weights = draw.weights(h)
                    total[k * parts] += np.bincount(place, weights, kinds)
                    for i in range(len(labels)):
                        weighted = y[:, i] if weights is None else y[:, i] * weights
                        total[k * parts + 1 + i] += np.bincount(place, weighted, kinds)

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= max(BLOCK_ROWS, kinds // 4):
                    book(held)
                    held, size = [], 0
            if held:
                book(held)
            drawn = np.flatnonzero((total[::parts] > 0).any(axis=0))
            for at in range(0, len(drawn), 1 << 14):
                some = drawn[at:at + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), *(pa.array(v) for v in total[:, some])], names=["place", *sums])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros(batch.num_rows, kind)
                fold, *codes = np.unravel_index(batch.column(0).to_numpy(), shape)
                out["fold"] = np.append(known, OTHER_FOLD)[fold]
                out["codes"] = np.stack(codes, axis=1)
                values = matrix(batch, sums).reshape(len(out), len(draws), parts)
                out["n"], out["y"] = values[:, :, 0], values[:, :, 1:]
                yield pa.RecordBatch.from_arrays([binary(out)], names=["row"])

        found = rows.mapInArrow(add, ", ".join(["place bigint", *(f"{n} double" for n in sums)]))
        found = found.groupBy("place").agg(*[F.sum(n).alias(n) for n in sums])
        return found.mapInArrow(packed, "row binary")

    def _blocks(self):
        """A function from a task's batches to blocks of rows."""
        kind = self.row

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            held, size = [], 0
            for batch in batches:
                held.append(raw(batch.column(0)).view(kind))
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    yield np.concatenate(held)
                    held, size = [], 0
            if size:
                yield np.concatenate(held)

        return blocks

    def histograms(self, learners: list[Learner]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each learner and request (rows, residuals) by node, column and code.

        Requests beyond the cells of a pass take further passes.
        """
        parts, cells = [[]], 0
        for m, learner in enumerate(learners):
            for q, request in enumerate(learner.requests):
                each = len(request.columns) * self.bins
                step = max(1, min(CELLS_PER_PASS // each, SLICE))
                for at in range(0, len(request.nodes), step):
                    nodes = request.nodes[at:at + step]
                    if cells + len(nodes) * each > CELLS_PER_PASS and parts[-1]:
                        parts.append([])
                        cells = 0
                    parts[-1].append((m, q, at, nodes))
                    cells += len(nodes) * each
        found: dict[tuple[int, int], list] = {}
        for part in filter(None, parts):
            done = self._pass(learners, part)
            for key, (m, q, at, _) in enumerate(part):
                found.setdefault((m, q), []).append((at, done[key]))
        out = []
        for m, learner in enumerate(learners):
            out.append([])
            for q in range(len(learner.requests)):
                pieces = [x for _, x in sorted(found[m, q], key=lambda p: p[0])]
                out[-1].append(tuple(np.concatenate([p[k] for p in pieces]) for k in (0, 1)))
        return out

    def _pass(self, learners: list[Learner], part: list[tuple]) -> dict:
        self.passes += 1
        work: dict[int, list] = {}
        for key, (m, q, _, nodes) in enumerate(part):
            request = learners[m].requests[q]
            lookup = np.full(len(request.tree.feature), -1)
            lookup[nodes] = np.arange(len(nodes))
            work.setdefault(m, []).append((key, request.tree, lookup, len(nodes), request.columns, request.draw))
        sent = [
            (m, learners[m].label, learners[m].fold, learners[m].base, learners[m].recent, jobs)
            for m, jobs in work.items()
        ]
        shared = self.rows.sparkSession.sparkContext.broadcast(sent)
        blocks, bins, places = self._blocks(), self.bins, self.draws

        def summarize(batches):
            out = {
                key: (np.zeros((n, len(columns), bins)), np.zeros((n, len(columns), bins)))
                for *_, jobs in shared.value for key, _, _, n, columns, _ in jobs
            }
            for block in blocks(batches):
                codes, kept, drawn = np.ascontiguousarray(block["codes"]), {}, {}
                for m, label, left_out, base, recent, jobs in shared.value:
                    if left_out not in kept:
                        rows = slice(None) if left_out is None else np.flatnonzero(block["fold"] != left_out)
                        kept[left_out] = (codes[rows], rows)
                    mine, rows = kept[left_out]
                    fit = base + block["fits"][rows, m]
                    for tree, weight in recent:
                        fit += weight * tree.value[tree.leaves(mine)]
                    r = block["y"][rows, label] - fit if places is None else None
                    for key, tree, lookup, n, columns, draw in jobs:
                        if places is not None:
                            weights = block["n"][rows, places[draw]]
                            weighted = block["y"][rows, places[draw], label] - weights * fit
                        else:
                            if draw not in drawn:
                                drawn[draw] = draw.weights(block["h"])
                            weights = None if drawn[draw] is None else drawn[draw][rows]
                            weighted = r if weights is None else r * weights
                        add_histograms(out[key], mine, weights, weighted, tree, lookup, n, columns, bins)
            return out

        size = sum(16 * len(nodes) * len(learners[m].requests[q].columns) * bins for m, q, _, nodes in part)
        done = map_reduce(self.rows, summarize, lambda a, b: (a[0] + b[0], a[1] + b[1]), self.tasks, size)
        shared.unpersist()
        return done

    def store_fits(self, learners: list[Learner]) -> None:
        """Add what the recent trees say to the stored fits, in a table of its own."""
        self.passes += 1
        shared = self.rows.sparkSession.sparkContext.broadcast([x.recent for x in learners])
        blocks = self._blocks()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                codes = np.ascontiguousarray(block["codes"])
                for m, recent in enumerate(shared.value):
                    for tree, weight in recent:
                        block["fits"][:, m] += weight * tree.value[tree.leaves(codes)]
                yield pa.RecordBatch.from_arrays([binary(block)], names=["row"])

        self._take(materialize(self.rows.mapInArrow(add, "row binary")))
        shared.unpersist()
        for learner in learners:
            learner.recent = []


def add_histograms(out, codes, weights, weighted, tree, lookup, n, columns, bins) -> None:
    """Add a block's rows, their copies and weighted residuals, to the histograms of one tree's nodes."""
    slot = lookup[tree.leaves(codes)] if len(lookup) > 1 else np.zeros(len(codes), np.int64)
    seen = slot >= 0 if weights is None else (slot >= 0) & (weights > 0)
    if not seen.all():
        picked = np.flatnonzero(seen)
        slot, codes, weighted = slot[picked], codes[picked], weighted[picked]
        weights = None if weights is None else weights[picked]
    count, total = out
    at = slot * bins
    for k, j in enumerate(columns):
        place = at + codes[:, j]
        count[:, k] += np.bincount(place, weights, n * bins).reshape(n, bins)
        total[:, k] += np.bincount(place, weighted, n * bins).reshape(n, bins)


def binary(rows: np.ndarray) -> pa.Array:
    """Each record of an array as bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def raw(column: pa.Array) -> np.ndarray:
    """The bytes of a column of equal lengths."""
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = ends[column.offset], ends[column.offset + len(column)]
    return np.frombuffer(data, np.uint8)[first:last]
