"""Tree ensembles as flat arrays: prediction and exact Shapley values in Arrow batches.

An ensemble is sent to the tasks in parts of whole trees of a bounded size. Up to one part the
rows are read as they are; with more, they meet one part per pass and carry their sum so far in a
written table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.session import read_table_at, remove_table, write_table

MAX_NODES = 100_000_000  # what the driver holds of an ensemble, about 5 GB; checked while it grows
SENT_NODES = 4_000_000  # nodes sent to every task for predictions, about 200 MB
EXPLAINED_NODES = 500_000  # nodes whose leaf paths are sent to every task
TREE_NODES = 20_000_000  # a larger tree is not sent to tasks at all


@dataclass
class Tree:
    """Node arrays; a leaf has feature -1. Rows go left when value <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            goes_left = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)

    def expectation(self) -> float:
        leaf = self.feature < 0
        return float(np.sum(self.value[leaf] * self.cover[leaf]) / np.sum(self.cover[leaf]))


def check_nodes(nodes: int) -> None:
    if nodes > MAX_NODES:
        raise ValueError(f"{nodes} nodes are too many for the driver")


@dataclass
class Ensemble:
    trees: list[Tree]
    weights: list[float]
    base: float = 0.0
    n_nodes: int = field(init=False)
    leaf_paths: list | None = field(init=False, default=None, repr=False, compare=False)

    def __post_init__(self):
        self.n_nodes = sum(len(t.feature) for t in self.trees)
        check_nodes(self.n_nodes)

    def parts(self, nodes: int) -> "list[Ensemble]":
        """The trees in their order, cut into ensembles of about this many nodes; the first has the base."""
        sizes = [len(t.feature) for t in self.trees]
        if max(sizes, default=0) > TREE_NODES:
            raise ValueError(f"a tree of {max(sizes)} nodes is too large for a task")
        if self.n_nodes <= nodes:
            return [self]
        cuts, held = [0], 0
        for k, size in enumerate(sizes):
            if held and held + size > nodes:
                cuts.append(k)
                held = 0
            held += size
        ends = [*cuts[1:], len(sizes)]
        return [
            Ensemble(self.trees[a:b], self.weights[a:b], 0.0 if a else self.base)
            for a, b in zip(cuts, ends, strict=True)
        ]

    def predict(self, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Predictions, added to what the parts ``before`` this one gave."""
        out = np.full(len(x), self.base) if before is None else before + self.base
        for tree, w in zip(self.trees, self.weights):
            out += w * tree.value[tree.leaves(x)]
        return out

    def expectation(self) -> float:
        return self.base + sum(w * t.expectation() for t, w in zip(self.trees, self.weights))

    def paths(self) -> "list[LeafPaths]":
        """The leaves of all trees with their paths; built once for an ensemble."""
        if self.leaf_paths is None:
            self.leaf_paths = leaf_paths(self.trees, self.weights)
        return self.leaf_paths

    def shapley(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for paths in self.paths():
            paths.add(x, out)
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        sizes = np.array([len(t.feature) for t in self.trees])
        joined = {
            name: np.concatenate([getattr(t, name) for t in self.trees])
            for name in ("feature", "threshold", "left", "right", "value", "cover")
        }
        return {"sizes": sizes, "weights": np.array(self.weights), "base": np.array(self.base), **joined}

    @staticmethod
    def from_arrays(a: dict[str, np.ndarray]) -> "Ensemble":
        cuts = np.cumsum(a["sizes"].astype(int))[:-1]
        parts = {
            n: np.split(a[n], cuts)
            for n in ("feature", "threshold", "left", "right", "value", "cover")
        }
        trees = [
            Tree(f.astype(int), t, lo.astype(int), hi.astype(int), v, c)
            for f, t, lo, hi, v, c in zip(*parts.values())
        ]
        return Ensemble(trees, a["weights"].tolist(), float(a["base"]))


PATTERNS = 10
"""Features of a path up to which its contributions are tabled by the conditions that hold."""

LEAVES = 512
"""Leaves that are looked at together."""

CELLS = 2_000_000
"""Numbers of a block of rows and leaves."""

TABLE_CELLS = 8_000_000
"""Numbers in the tables of an ensemble's leaves; the leaves beyond are worked out row by row."""


@dataclass
class LeafPaths:
    """Leaves reached through equally many features: arrays of leaf x feature of its path.

    A leaf is reached where each feature lies in its interval (low, high]; ``ratio`` is the
    share of the cover that goes along at the splits on the feature, ``value`` the weighted value.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ratio: np.ndarray
    value: np.ndarray
    tabled: bool = True
    table: np.ndarray | None = None

    def __post_init__(self):
        d = self.feature.shape[1]
        if self.tabled:
            holds = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
            self.table = self._contributions(np.broadcast_to(holds, (len(self.value), 1 << d, d)))

    def _contributions(self, holds: np.ndarray) -> np.ndarray:
        """What each feature of a path adds, for conditions that hold (1) or not: leaf x case x feature.

        With cover ratio z_j, and o_j = 1 where the condition on j holds, the weight of feature i
        is the integral over t in (0, 1) of prod_{j != i} (z_j (1-t) + o_j t): the Shapley kernel
        written as a beta integral. The integrand is a polynomial, so Gauss-Legendre nodes give
        it exactly.
        """
        z = self.ratio[:, None, :]
        nodes, gauss = np.polynomial.legendre.leggauss((self.feature.shape[1] + 1) // 2 + 1)
        out = np.zeros(holds.shape)
        for t, g in zip((nodes + 1) / 2, gauss / 2, strict=True):
            factors = z * (1 - t) + holds * t
            out += g * factors.prod(axis=2, keepdims=True) / factors
        return out * (holds - z) * self.value[:, None, None]

    @staticmethod
    def table_cells(leaves: int, d: int) -> int:
        return leaves * d << d

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add the contributions of all leaves to ``out``, row x feature."""
        n, d = self.feature.shape
        place = np.zeros((n * d, x.shape[1]))
        place[np.arange(n * d), self.feature.ravel()] = 1.0
        step = max(1, CELLS // (n * d))
        for at in range(0, len(x), step):
            values = x[at:at + step][:, self.feature]
            holds = (values > self.low) & (values <= self.high)
            if self.table is not None:
                case = holds @ (1 << np.arange(d))
                found = self.table[np.arange(n), case]
            else:
                found = self._contributions(holds.transpose(1, 0, 2).astype(float)).transpose(1, 0, 2)
            out[at:at + step] += found.reshape(len(values), n * d) @ place


def leaf_paths(trees: list[Tree], weights: list[float]) -> list[LeafPaths]:
    """All leaves that add something, by the number of features on their paths."""
    by_size: dict[int, list] = {}
    for tree, weight in zip(trees, weights, strict=True):
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(tree.feature[node])
            if f < 0:
                if path and tree.value[node] != 0.0:
                    by_size.setdefault(len(path), []).append((path, weight * tree.value[node]))
                continue
            cut = tree.threshold[node]
            for child, low, high in (
                (int(tree.left[node]), -np.inf, cut), (int(tree.right[node]), cut, np.inf),
            ):
                a, b, z = path.get(f, (-np.inf, np.inf, 1.0))
                share = tree.cover[child] / tree.cover[node]
                stack.append((child, {**path, f: (max(a, low), min(b, high), z * share)}))
    out, room = [], TABLE_CELLS
    for d, leaves in sorted(by_size.items()):
        for at in range(0, len(leaves), LEAVES):
            part = leaves[at:at + LEAVES]
            tabled = d <= PATTERNS and LeafPaths.table_cells(len(part), d) <= room
            room -= LeafPaths.table_cells(len(part), d) if tabled else 0
            bounds = np.array([list(p.values()) for p, _ in part], dtype=float)
            out.append(LeafPaths(
                np.array([list(p) for p, _ in part]), bounds[:, :, 0], bounds[:, :, 1], bounds[:, :, 2],
                np.array([v for _, v in part]), tabled))
    return out


def predict_ensemble(df: DataFrame, ensemble: Ensemble, features: list[str], output: str) -> DataFrame:
    """Adds the predictions; the same numbers however many parts the ensemble has."""

    def scorer(part: Ensemble):
        shared = df.sparkSession.sparkContext.broadcast(part)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame, *before: pd.Series) -> pd.Series:
            known = before[0].to_numpy(dtype=float) if before else None
            return pd.Series(shared.value.predict(x.to_numpy(dtype=float), known))

        return score, shared

    return _summed(df, ensemble.parts(SENT_NODES), scorer, features, output)


def shapley_column(df: DataFrame, ensemble: Ensemble, features: list[str], output: str) -> DataFrame:
    """Adds an array with one Shapley value per feature; the paths are worked out once."""

    def explainer(part: Ensemble):
        part.paths()
        shared = df.sparkSession.sparkContext.broadcast(part)

        @F.pandas_udf("array<double>")
        def explain(x: pd.DataFrame, *before: pd.Series) -> pd.Series:
            found = shared.value.shapley(x.to_numpy(dtype=float))
            if before:
                found += np.stack(before[0].to_list())
            return pd.Series(list(found))

        return explain, shared

    return _summed(df, ensemble.parts(EXPLAINED_NODES), explainer, features, output)


def _summed(df: DataFrame, parts: list[Ensemble], function, features: list[str], output: str) -> DataFrame:
    """``output``: what ``function`` of the last part adds to the sum of the parts before it.

    Each part but the last costs a pass that writes the rows with their sums; a table is removed
    once the next one is written.
    """
    spark, path = df.sparkSession, None
    if len(parts) > 1 and output in features:
        raise ValueError(f"{output} is a feature and cannot take the predictions")
    for k, part in enumerate(parts):
        call, shared = function(part)
        df = df.withColumn(output, call(_features(features), *([col(output)] if k else [])))
        if k < len(parts) - 1:
            before, path = path, write_table(df)
            shared.unpersist()
            df = read_table_at(spark, path, df.schema)
            if before:
                remove_table(spark, before)
    return df


def _features(features: list[str]):
    return F.struct(*[col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
