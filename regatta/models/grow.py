"""Trees grown from histograms, their leaves opened best first, and forests and boosts of them."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from regatta.models.binned import BinnedTable, CodedTree, Draw, Learner, Request
from regatta.models.ensemble import Ensemble, Tree, check_nodes

KEPT_CELLS = 8_000_000
"""Cells of parents that wait for the smaller child; beyond, both children are added up."""

TREES_TOGETHER = 256
"""Trees of a forest that grow at the same time."""

RECENT = 10
"""Trees that passes apply to a row before its fit is stored anew."""


@dataclass(frozen=True)
class Limits:
    """What a split must satisfy, and the shrinkage of a node's value."""

    max_depth: int = 30
    max_leaves: float = np.inf
    min_split: float = 2
    min_leaf: float = 1
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0

    def shrunk(self, total):
        return np.sign(total) * np.maximum(np.abs(total) - self.l1, 0.0)

    def score(self, n, total):
        """Twice the loss that a node of n rows takes away."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, self.shrunk(total) ** 2 / (n + self.l2), 0.0)

    def value(self, n: float, total: float) -> float:
        return float(self.shrunk(total) / (n + self.l2)) if n > 0 else 0.0


def best_splits(count: np.ndarray, total: np.ndarray, limits: Limits) -> list[tuple | None]:
    """For each node (gain, place of the column, cut, rows and sum on the left), or none.

    Gains that differ by rounding count as equal, and the first column and cut wins.
    """
    left_n, left_s = np.cumsum(count, axis=2)[:, :, :-1], np.cumsum(total, axis=2)[:, :, :-1]
    n, s = count[:, :1, :].sum(axis=2, keepdims=True), total[:, :1, :].sum(axis=2, keepdims=True)
    parts = limits.score(left_n, left_s) + limits.score(n - left_n, s - left_s)
    gain = parts - limits.score(n, s)
    least = max(limits.min_leaf, 1e-9)
    fits = (left_n >= least) & (n - left_n >= least) & (gain > limits.min_gain) & (gain > 1e-10 * parts)
    gain = np.where(fits, gain, -np.inf)
    out: list[tuple | None] = []
    for k, flat in enumerate(gain.reshape(len(gain), -1)):
        best = flat.max(initial=-np.inf)
        if not np.isfinite(best):
            out.append(None)
            continue
        at = int(np.argmax(flat >= best - 1e-9 * best - 1e-12 * parts[k].max()))
        j, c = divmod(at, gain.shape[2])
        out.append((float(flat[at]), j, c, float(left_n[k, j, c]), float(left_s[k, j, c])))
    return out


class Growing:
    """One tree on its way.

    A leaf with a known split is opened once it is sure that no other choice comes before it:
    each pass opens all leaves that best-first order may still reach, and the final tree keeps
    the splits that it does reach. With no limit on leaves these are all.
    """

    def __init__(self, limits: Limits, columns: np.ndarray, draw: Draw):
        self.limits, self.columns, self.draw = limits, columns, draw
        self.feature, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.n, self.total, self.depth = [0.0], [0.0], [0]
        self.split: dict[int, tuple] = {}
        self.kept: dict[int, tuple] = {}
        self.sibling: dict[int, tuple[int, int]] = {}
        self.wanted, self.done = [0], False

    def coded(self) -> CodedTree:
        value = [self.limits.value(n, s) for n, s in zip(self.n, self.total, strict=True)]
        return CodedTree(*(np.array(x) for x in (self.feature, self.cut, self.left, self.right)), np.array(value))

    def request(self) -> Request:
        return Request(self.coded(), self.wanted, self.columns, self.draw)

    def receive(self, found: tuple[np.ndarray, np.ndarray], kept_cells: int) -> None:
        """Take the histograms of the wanted nodes and open what comes next."""
        known = {node: (found[0][k], found[1][k]) for k, node in enumerate(self.wanted)}
        for small, (parent, other) in self.sibling.items():
            known[other] = tuple(a - b for a, b in zip(self.kept[parent], known[small], strict=True))
            del self.kept[parent]
        self.sibling = {}
        if 0 in known:
            self.n[0], self.total[0] = (float(x[0].sum()) for x in known[0])
        nodes = [i for i in known if self.n[i] >= max(self.limits.min_split, 2 * self.limits.min_leaf)]
        if nodes and self.limits.max_depth > 0:
            splits = best_splits(*(np.stack([known[i][k] for i in nodes]) for k in (0, 1)), self.limits)
            for node, split in zip(nodes, splits, strict=True):
                if split is not None:
                    self.split[node] = split
                    if kept_cells + len(self.kept) * known[node][0].size < KEPT_CELLS:
                        self.kept[node] = known[node]
        self._open()

    def _reached(self) -> tuple[list[int], list[int]]:
        """Splits in best-first order as far as known: those opened, and those still to open."""
        queue = [(-self.split[0][0], 0)] if 0 in self.split else []
        opened, missing, leaves = [], [], 1
        while queue and leaves < self.limits.max_leaves:
            _, node = heapq.heappop(queue)
            leaves += 1
            if self.feature[node] < 0:
                missing.append(node)
                continue
            opened.append(node)
            for child in (self.left[node], self.right[node]):
                if child in self.split:
                    heapq.heappush(queue, (-self.split[child][0], child))
        return opened, missing

    def _open(self) -> None:
        self.wanted = []
        while not self.wanted:
            missing = self._reached()[1]
            if not missing:
                self.done, self.kept = True, {}
                return
            for node in missing:
                self._divide(node)

    def _divide(self, node: int) -> None:
        _, j, cut, n, total = self.split[node]
        self.feature[node], self.cut[node] = int(self.columns[j]), cut
        first = len(self.feature)
        self.left[node], self.right[node] = first, first + 1
        sides = ((n, total), (self.n[node] - n, self.total[node] - total))
        for rows, s in sides:
            for values, v in (
                (self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0),
                (self.n, rows), (self.total, s), (self.depth, self.depth[node] + 1),
            ):
                values.append(v)
        least = max(self.limits.min_split, 2 * self.limits.min_leaf)
        may = [self.depth[c] < self.limits.max_depth and self.n[c] >= least for c in (first, first + 1)]
        parent = self.kept.get(node)
        if not any(may) or parent is None:
            self.kept.pop(node, None)
            self.wanted += [c for c, m in zip((first, first + 1), may, strict=True) if m]
            return
        small = first if n <= self.n[first + 1] else first + 1
        other = 2 * first + 1 - small
        if may[other - first]:
            self.wanted.append(small)
            self.sibling[small] = (node, other)
        else:
            self.kept.pop(node)
            self.wanted.append(small)

    def finished(self) -> tuple[CodedTree, np.ndarray]:
        """The tree with the splits that best-first order reached, and the rows of its nodes."""
        inner = set(self._reached()[0])
        order, at = [0], 0
        while at < len(order):
            if order[at] in inner:
                order += [self.left[order[at]], self.right[order[at]]]
            at += 1
        place = {node: k for k, node in enumerate(order)}
        tree = CodedTree(
            np.array([self.feature[i] if i in inner else -1 for i in order]),
            np.array([self.cut[i] for i in order]),
            np.array([place[self.left[i]] if i in inner else 0 for i in order]),
            np.array([place[self.right[i]] if i in inner else 0 for i in order]),
            np.array([self.limits.value(self.n[i], self.total[i]) for i in order]),
        )
        return tree, np.array([self.n[i] for i in order])


def decoded(tree: CodedTree, rows: np.ndarray, cuts: list[np.ndarray]) -> Tree:
    """The tree over feature values."""
    threshold = [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)]
    return Tree(tree.feature, np.array(threshold), tree.left, tree.right, tree.value, rows)


@dataclass(frozen=True)
class Plan:
    """A forest or a boost, its trees' limits and the rows and columns that a tree draws."""

    boosted: bool
    n_trees: int
    limits: Limits
    seed: int
    bootstrap: bool = False
    rate: float = 1.0
    share: float = 1.0
    bagging_freq: int = 1
    columns: int | None = None
    dart: bool = False

    def draw(self, tree: int) -> Draw:
        if self.bootstrap:
            return Draw("poisson", tree, self.seed)
        if self.share >= 1.0:
            return Draw()
        return Draw("share", tree // self.bagging_freq, self.seed, self.share)

    def draws(self) -> list[Draw]:
        """All draws of rows that its trees make."""
        return list(dict.fromkeys(self.draw(k) for k in range(self.n_trees)))

    def drawn_columns(self, tree: int, d: int) -> np.ndarray:
        if self.columns is None or self.columns >= d:
            return np.arange(d)
        return np.sort(np.random.default_rng((self.seed, tree)).choice(d, self.columns, replace=False))


DROP_RATE, MAX_DROP, SKIP_DROP = 0.1, 50, 0.5
"""Fixed values of dropout boosting: share of trees dropped, at most so many, rounds without."""


class Fit:
    """One model on its way: its learner as passes see it, and its growing trees."""

    def __init__(self, plan: Plan, table: BinnedTable, label: int, fold: int | None):
        self.plan, self.d = plan, len(table.cuts)
        n, mean, _ = table.source.label_summary(label, fold)
        if not n:
            raise ValueError("no rows to fit")
        self.learner = Learner(label, fold, mean)
        self.trees: list[tuple[CodedTree, np.ndarray]] = []
        self.n_nodes = 0
        self.weights: list[float] = []
        self.started, self.active, self.dropped = 0, [], []
        self._start()

    def _start(self) -> None:
        together = 1 if self.plan.boosted else TREES_TOGETHER
        while len(self.active) < together and self.started < self.plan.n_trees:
            if self.plan.dart:
                self._drop()
            k = self.started
            grower = Growing(self.plan.limits, self.plan.drawn_columns(k, self.d), self.plan.draw(k))
            self.active.append((k, grower))
            self.started += 1

    def _drop(self) -> None:
        """Take some trees out of the fit while the next one grows."""
        rng = np.random.default_rng((self.plan.seed, self.started, 1))
        self.dropped = []
        if self.weights and rng.random() >= SKIP_DROP:
            chance = DROP_RATE * np.array(self.weights) / np.mean(self.weights)
            self.dropped = np.flatnonzero(rng.random(len(chance)) < chance)[:MAX_DROP].tolist()
        self._change(self.dropped, -1.0)

    def _change(self, trees: list[int], factor: float) -> None:
        self.learner.recent += [(self.trees[t][0], factor * self.weights[t]) for t in trees]

    def finish(self) -> None:
        """Book the trees that are grown, and start the next ones."""
        left = []
        for k, grower in self.active:
            if not grower.done:
                left.append((k, grower))
                continue
            tree, rows = grower.finished()
            self.trees.append((tree, rows))
            self.n_nodes += len(rows)
            check_nodes(self.n_nodes)
            if not self.plan.boosted:
                continue
            n = len(self.dropped)
            self.weights.append(self.plan.rate / (1 + n))
            self.learner.recent.append((tree, self.weights[-1]))
            for t in self.dropped:
                self.weights[t] *= n / (n + 1)
            self._change(self.dropped, 1.0)
            sampled = self.plan.share < 1.0 or self.plan.columns is not None or self.plan.dart
            if len(rows) == 1 and abs(tree.value[0]) < 1e-12 and not sampled:
                self.started = self.plan.n_trees  # the same rows would give the same single leaf
        self.active = left
        self._start()

    def ensemble(self, table: BinnedTable) -> Ensemble:
        trees = [decoded(tree, rows, table.cuts) for tree, rows in self.trees]
        weights = self.weights if self.plan.boosted else [1.0 / len(trees)] * len(trees)
        return Ensemble(trees, list(weights), self.learner.base)


def grow(table: BinnedTable, fits: list[Fit]) -> list[Ensemble]:
    """Grow all trees of all fits, one pass for a level of every tree that is open."""
    learners = [f.learner for f in fits]
    while any(f.active for f in fits):
        for f in fits:
            f.learner.requests = [g.request() for _, g in f.active]
        found = table.histograms(learners)
        kept = sum(h.size for f in fits for _, g in f.active for h, _ in g.kept.values())
        for f, histograms in zip(fits, found, strict=True):
            for (_, grower), histogram in zip(f.active, histograms, strict=True):
                grower.receive(histogram, kept)
            f.finish()
        if any(f.active for f in fits) and max(len(x.recent) for x in learners) >= RECENT:
            table.store_fits(learners)
    return [f.ensemble(table) for f in fits]
