"""Extremely randomised trees, grown level by level for all trees at once.

At every open node each feature gets one random cut between its smallest and largest value
there, and the cut with the largest variance reduction is kept (Geurts et al. 2006). A level
costs two passes over the rows, whatever the number of trees: one for the ranges, one for the
sums left of the cuts. Tasks hold sums per open node and feature, never rows.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from regatta.models.base import FittedModel
from regatta.models.ensemble import Ensemble, Tree, check_nodes, predict_ensemble
from regatta.models.together import FitTable, Request, Step

CELLS_PER_PASS = 2_000_000  # open nodes x features held by one task
SLICE = 4096  # open nodes per array that travels
POISSON_CDF = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320.0]))


@dataclass
class ExtraTreesModel(FittedModel):
    ensemble_: Ensemble = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.ensemble_.predict(x)

    def raw(self, df: DataFrame, output: str) -> DataFrame:
        return predict_ensemble(df, self.ensemble_, self.features, output)

    def ensemble(self, spark) -> Ensemble:
        return self.ensemble_

    def state(self):
        return self.ensemble_.arrays()


@dataclass
class _Growing:
    """One tree under construction; node 0 is the root."""

    feature: list = field(default_factory=lambda: [-1])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])

    def frozen(self) -> Tree:
        return Tree(
            np.array(self.feature), np.array(self.threshold), np.array(self.left),
            np.array(self.right), np.array(self.value), np.array(self.cover),
        )

    def add(self, value: float, cover: float) -> int:
        for name, v in (
            ("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0),
            ("value", value), ("cover", cover),
        ):
            getattr(self, name).append(v)
        return len(self.feature) - 1


def row_uniform(row_hash: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree, a function of the row's key."""
    salt = (seed * 7919 + tree * 104729 + 1) & 0xFFFFFFFF
    with np.errstate(over="ignore"):
        z = row_hash.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z.astype(np.float64) / 2.0**64


def bag_weights(row_hash: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) copies of each row in a tree's bootstrap."""
    return np.searchsorted(POISSON_CDF, row_uniform(row_hash, tree, seed)).astype(float)


def extra_steps(
    table: FitTable, label: int, fold: int | None, transform, params: dict, seed: int,
) -> Generator[Request, dict, ExtraTreesModel]:
    """One fit on the rows outside a fold, as steps of ``fit_together``."""
    n_trees = int(params.get("n_estimators", 100))
    max_depth = int(params.get("max_depth", 30))
    limits = (int(params.get("min_samples_split", 2)), int(params.get("min_samples_leaf", 1)))
    d, rng = len(table.features), np.random.default_rng(seed)
    trees = [_Growing() for _ in range(n_trees)]
    sample = (seed, bool(params.get("bootstrap", False)))
    open_nodes = [(t, 0) for t in range(n_trees)]
    for depth in range(max_depth + 1):
        if not open_nodes:
            break
        reached = []
        step = max(1, CELLS_PER_PASS // (d + 1))
        for start in range(0, len(open_nodes), step):
            part = open_nodes[start : start + step]
            reached += yield from _grow(
                label, fold, trees, part, d, rng, sample, *limits, last=depth == max_depth)
        open_nodes = reached
        check_nodes(sum(len(t.feature) for t in trees))
    model = Ensemble([t.frozen() for t in trees], [1.0 / n_trees] * n_trees)
    return ExtraTreesModel("ET", list(table.features), dict(params), transform, [], model)


def _grow(label, fold, trees, nodes, d, rng, sample, min_split, min_leaf, last):
    """Split what can be split among ``nodes`` and return the new open nodes."""
    slots = {node: s for s, node in enumerate(nodes)}
    found = yield Request(_Ranges(trees, slots, d, sample), label, fold)
    low, high, count, total = joined(found)
    splittable = []
    for (t, node), s in slots.items():
        trees[t].cover[node] = float(count[s])
        trees[t].value[node] = float(total[s] / count[s]) if count[s] else 0.0
        pure = not low[s, d] < high[s, d]
        if not (last or pure or count[s] < max(min_split, 2 * min_leaf)):
            if (low[s, :d] < high[s, :d]).any():
                splittable.append((t, node))
    if not splittable:
        return []
    picked = np.array([slots[n] for n in splittable])
    # a cut lies in [low, high), so both sides of a drawn cut hold rows
    cuts = low[picked, :d] + rng.random((len(picked), d)) * (high[picked, :d] - low[picked, :d])
    at = {node: s for s, node in enumerate(splittable)}
    found = yield Request(_LeftSums(trees, at, d, sample, cuts), label, fold)
    left_n, left_y = joined(found)
    n = count[picked][:, None]
    y = total[picked][:, None]
    right_n, right_y = n - left_n, y - left_y
    valid = (left_n >= min_leaf) & (right_n >= min_leaf) & (low[picked, :d] < high[picked, :d])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_y**2 / left_n + right_y**2 / right_n - y**2 / n
    gain = np.where(valid, gain, -np.inf)
    best = gain.argmax(axis=1)
    opened = []
    for (t, node), s in at.items():
        j = best[s]
        if not np.isfinite(gain[s, j]):
            continue
        tree = trees[t]
        tree.feature[node], tree.threshold[node] = int(j), float(cuts[s, j])
        for side, cn, cy in (
            ("left", left_n[s, j], left_y[s, j]), ("right", right_n[s, j], right_y[s, j])
        ):
            child = tree.add(float(cy / cn), float(cn))
            getattr(tree, side)[node] = child
            opened.append((t, child))
    return opened


def sliced(*arrays) -> dict:
    """Arrays cut along the open nodes, so that many executors share the merging."""
    size = len(arrays[0])
    return {i: tuple(a[i : i + SLICE] for a in arrays) for i in range(0, size, SLICE)}


def joined(slices: dict) -> tuple:
    return tuple(np.concatenate(parts) for parts in zip(*(slices[i] for i in sorted(slices))))


class _Routing(Step):
    """Rows of each tree by open node. Trees with open nodes go to a task with their lookups."""

    def __init__(self, trees, slots: dict, d: int, sample: tuple[int, bool]):
        by_tree: dict[int, list] = {}
        for (t, node), s in slots.items():
            by_tree.setdefault(t, []).append((node, s))
        self.work = []
        for t, pairs in sorted(by_tree.items()):
            lookup = np.full(len(trees[t].feature), -1)
            for node, s in pairs:
                lookup[node] = s
            self.work.append((t, trees[t].frozen(), lookup))
        self.n, self.d, self.sample = len(slots), d, sample
        self.size = 32 * self.n * (d + 1) + sum(56 * len(lookup) for *_, lookup in self.work)

    def routed(self, x, h):
        """Per tree ``(rows in the order of their nodes, starts, slots, weights)``."""
        seed, bootstrap = self.sample
        for t, tree, lookup in self.work:
            slot = lookup[tree.leaves(x)]
            w = bag_weights(h, t, seed) if bootstrap else np.ones(len(x))
            order = np.flatnonzero((slot >= 0) & (w > 0))
            order = order[np.argsort(slot[order], kind="stable")]
            if len(order):
                found, starts = np.unique(slot[order], return_index=True)
                yield order, starts, found, w[order]

    def sums(self, state):
        return sliced(*state)


class _Ranges(_Routing):
    """Smallest and largest values, rows and label sums of the open nodes."""

    def start(self):
        shape = (self.n, self.d + 1)
        return [np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(self.n), np.zeros(self.n)]

    def add(self, state, x, y, h):
        low, high, count, total = state
        for order, starts, found, w in self.routed(x, h):
            both = np.column_stack([x[order], y[order]])
            low[found] = np.minimum(low[found], np.minimum.reduceat(both, starts))
            high[found] = np.maximum(high[found], np.maximum.reduceat(both, starts))
            count[found] += np.add.reduceat(w, starts)
            total[found] += np.add.reduceat(w * y[order], starts)

    def combine(self, a, b):
        return (np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), a[2] + b[2], a[3] + b[3])


class _LeftSums(_Routing):
    """Rows and label sums left of the drawn cuts."""

    def __init__(self, trees, slots, d, sample, cuts):
        super().__init__(trees, slots, d, sample)
        self.cuts = cuts

    def start(self):
        return [np.zeros((self.n, self.d)), np.zeros((self.n, self.d))]

    def add(self, state, x, y, h):
        n, s = state
        for order, starts, found, w in self.routed(x, h):
            slot = np.repeat(found, np.diff(np.append(starts, len(order))))
            goes_left = (x[order] <= self.cuts[slot]) * w[:, None]
            n[found] += np.add.reduceat(goes_left, starts)
            s[found] += np.add.reduceat(goes_left * y[order][:, None], starts)

    def combine(self, a, b):
        return a[0] + b[0], a[1] + b[1]
