"""Support vector regression: the exact primal objective, minimised by reweighting.

The objective 0.5 |w|^2 + C sum max(0, |y - f(x)| - eps) is bounded from above by a quadratic
that touches it at the current fit, so every iteration is one weighted least squares problem
whose sums come from one pass over the rows. Kernels other than the linear one go through the
Nystroem map (Williams and Seeger 2001): exact when the rows are no more than the landmarks.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.models.base import FittedModel
from regatta.models.extra import row_uniform
from regatta.models.together import FitTable, Request, Step

LANDMARKS = 256
MAX_ITER = 1000  # where none is given; the objective settles long before
PATIENCE = 3  # passes at full sharpness without a gain in the objective
KERNELS = ("linear", "rbf", "poly")
BLOCK_ROWS = 1024  # rows mapped together
BLOCK_VALUES = 1 << 16  # and their kernel values: what they make stays in a core's cache


@dataclass
class SvrModel(FittedModel):
    center: np.ndarray = None
    scale: np.ndarray = None
    landmarks: np.ndarray = None
    root: np.ndarray = None  # K(landmarks, landmarks)^(-1/2)
    weights: np.ndarray = None
    intercept: float = 0.0

    def mapped(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.center) / self.scale
        if self.params.get("kernel", "rbf") == "linear":
            return x
        return (self.root.T @ kernel(x, self.landmarks, self.params).T).T

    def blocks(self, rows: int) -> Iterator[slice]:
        """Rows that are mapped together."""
        known = len(self.center) if self.landmarks is None else len(self.landmarks)
        step = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, known)))
        return (slice(at, at + step) for at in range(0, rows, step))

    def decide(self, x: np.ndarray) -> np.ndarray:
        out, linear = np.empty(len(x)), self.params.get("kernel", "rbf") == "linear"
        pulls = self.weights if linear else self.root @ self.weights  # of the landmarks
        for block in self.blocks(len(x)):
            at = (x[block] - self.center) / self.scale
            out[block] = (at if linear else kernel(at, self.landmarks, self.params)) @ pulls
        return out + self.intercept

    def raw(self, df: DataFrame, output: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.decide(x.to_numpy(dtype=float)))

        values = [col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]
        return df.withColumn(output, score(F.struct(*values)))

    def state(self):
        names = ("center", "scale", "landmarks", "root", "weights", "intercept")
        return {n: np.asarray(getattr(self, n)) for n in names if getattr(self, n) is not None}


def kernel(a: np.ndarray, b: np.ndarray, params: dict) -> np.ndarray:
    """Values for each row of ``a`` and each of ``b``; those of a row of ``b`` lie side by side."""
    gamma = float(params.get("gamma", 1.0 / max(1, a.shape[1])))
    if params.get("kernel", "rbf") == "poly":
        out = (gamma * b) @ a.T
        out += float(params.get("coef0", 0.0))
        return _power(out, int(params.get("degree", 3))).T
    # -gamma |a - b|^2 is one product, of binary logarithms
    rate = gamma / np.log(2)
    far_a, far_b = (a * a).sum(1), (b * b).sum(1)
    left = np.column_stack([2 * rate * b, -rate * far_b, np.full(len(b), -rate)])
    out = left @ np.vstack([a.T, np.ones(len(a)), far_a])
    if not rate * (far_a.max(initial=0) + far_b.max(initial=0)) < 1:  # else rounding leaves no more than 1e-15 above 0
        np.minimum(out, 0, out=out)
    return np.exp2(out, out=out).T


def _power(base: np.ndarray, degree: int) -> np.ndarray:
    """``base ** degree`` by squaring; ``base`` is used up."""
    if degree < 1:
        return base ** degree
    out = None
    while degree:
        if degree & 1:
            if out is None:
                out = base.copy() if degree > 1 else base
            else:
                out *= base
        degree >>= 1
        if degree:
            base *= base
    return out


class _Landmarks(Step):
    """The rows with the smallest draws of a seed."""

    def __init__(self, count: int, seed: int, d: int):
        self.count, self.seed, self.size = count, seed, 32 * count * (d + 1)

    def start(self):
        return [np.zeros((0, 0))]

    def add(self, state, x, y, h):
        draws, kept = row_uniform(h, 0, self.seed), state[0]
        if len(kept) < max(1, self.count):
            near = np.arange(len(draws))
        else:  # only these can replace one
            near = np.flatnonzero(draws <= kept[-1, 0])
        if len(near) > self.count:
            near = near[draws[near] <= np.partition(draws[near], self.count - 1)[self.count - 1]]
        if len(near):
            drawn = np.column_stack([draws[near], x[near]])
            state[0] = self._least(np.vstack([kept, drawn]) if kept.size else drawn)

    def _least(self, rows):
        return rows[np.lexsort(rows.T[::-1])[:self.count]]

    def sums(self, state):
        return {0: state[0]} if state[0].size else {}

    def combine(self, a, b):
        return self._least(np.vstack([a, b]))


class _Sums(Step):
    """Sums of the surrogate least squares problem at the current fit.

    The loss, the rows and, in the first pass, the sums of the labels and their squares; then the
    products of the weighted columns and a one, with each other and with the target.
    """

    def __init__(self, model: SvrModel, epsilon: float, smooth: float | None):
        self.model, self.epsilon, self.smooth = replace(model), epsilon, smooth
        known = sum(a.nbytes for a in (model.landmarks, model.root) if a is not None)
        self.size = 16 * (len(model.weights) + 2) ** 2 + known

    def start(self):
        size = len(self.model.weights) + 1
        return [np.zeros(4), np.zeros((size, size)), np.zeros(size)]

    def add(self, state, x, y, h):
        for block in self.model.blocks(len(y)):
            self._add(state, x[block], y[block])

    def _add(self, state, x, y):
        phi = self.model.mapped(x).T
        gap = y - (self.model.weights @ phi + self.model.intercept)
        loss = np.abs(gap)
        loss -= self.epsilon
        np.maximum(loss, 0, out=loss)
        state[0][:2] += loss.sum(), len(y)
        # columns and a one, times the root of the row's weight
        rows = np.empty((len(phi) + 1, len(y)))
        if self.smooth is None:
            rows[:-1], rows[-1], t = phi, 1, y
            state[0][2:] += y.sum(), y @ y
        else:
            above, under = self._closeness(gap - self.epsilon), self._closeness(gap + self.epsilon)
            w = above + under
            # the target (y - eps) above + (y + eps) under, over the root of w
            t = under
            t -= above
            t *= self.epsilon
            t += y * w
            np.sqrt(w, out=w)
            t /= w
            rows[-1] = w
            np.multiply(phi, w, out=rows[:-1])
        state[1] += rows @ rows.T
        state[2] += rows @ t

    def _closeness(self, gap):
        np.abs(gap, out=gap)
        np.maximum(gap, self.smooth, out=gap)
        return np.divide(0.25, gap, out=gap)

    def sums(self, state):
        return dict(enumerate(state))


class _Mixing:
    """Anderson's mixing of the latest steps of a fixed point iteration (Walker and Ni 2011)."""

    def __init__(self, depth: int = 6):
        self.depth, self.points, self.steps = depth, [], []

    def next(self, at: np.ndarray, solution: np.ndarray) -> np.ndarray:
        self.points.append(solution)
        self.steps.append(solution - at)
        del self.points[:-self.depth], self.steps[:-self.depth]
        if len(self.steps) < 2:
            return solution
        changes = np.diff(np.array(self.steps), axis=0).T
        share = np.linalg.lstsq(changes, self.steps[-1], rcond=1e-8)[0]
        return solution - np.diff(np.array(self.points), axis=0).T @ share


def svr_steps(
    table: FitTable, label: int, fold: int | None, transform, params: dict, seed: int,
) -> Generator[Request, dict, SvrModel]:
    """One fit on the rows outside a fold, as steps of ``fit_together``."""
    kind = params.get("kernel", "rbf")
    if kind not in KERNELS:
        raise ValueError(f"unknown kernel: {kind}")
    ignored = ["shrinking"] if "shrinking" in params else []  # a solver shortcut, no effect
    model = SvrModel("SVR", list(table.features), dict(params), transform, ignored)
    model.center, model.scale = table.scaling(fold)
    d = len(table.features)
    if kind != "linear":
        count = int(model.params.setdefault("landmarks", LANDMARKS))
        found = yield Request(_Landmarks(count, seed, d), label, fold)
        if 0 not in found:
            raise ValueError("no rows to fit")
        model.landmarks = np.unique((found[0][:, 1:] - model.center) / model.scale, axis=0)
        values, vectors = np.linalg.eigh(kernel(model.landmarks, model.landmarks, params))
        keep = values > 1e-10 * max(values.max(), 1e-300)
        model.root = vectors[:, keep] / np.sqrt(values[keep])

    c, epsilon = float(params.get("C", 1.0)), float(params.get("epsilon", 0.1))
    tol = float(params.get("tol", 1e-3))
    passes = int(params.get("max_iter", MAX_ITER))
    size = model.root.shape[1] if kind != "linear" else d
    model.weights, smooth, floor = np.zeros(size), None, 0.0
    mixed, best, stale = _Mixing(), None, 0
    for _ in range(passes):
        found = yield Request(_Sums(model, epsilon, smooth), label, fold)
        loss, n, sy, syy = found[0]
        if not n:
            raise ValueError("no rows to fit")
        at = np.append(model.weights, model.intercept)
        objective = 0.5 * model.weights @ model.weights + c * loss
        # 0.5 |w|^2 + C sum W (t - f)^2 with W = 1/(4|u1|) + 1/(4|u2|)
        system = 2 * c * found[1]
        system[:-1, :-1] += np.eye(size)
        solution = np.linalg.lstsq(system, 2 * c * found[2], rcond=None)[0]
        if smooth is None:  # first pass: plain least squares
            spread = max(np.sqrt(max(syy / n - (sy / n) ** 2, 0.0)), 1e-12)
            smooth, floor = spread, 1e-4 * spread
        else:
            gained = best is None or objective < best[0] - 1e-2 * tol * abs(best[0])
            worse = best is not None and objective > best[0]
            if not worse:
                best = (objective, at, solution)
            stale = 0 if gained or smooth > floor else stale + 1
            if stale >= PATIENCE:
                break
            if smooth > floor:
                smooth = max(smooth / 4, floor)
            elif worse:  # back to the plain step from the best point
                mixed, solution = _Mixing(), best[2]
            else:
                solution = mixed.next(at, solution)
        model.weights, model.intercept = solution[:-1], float(solution[-1])
    if best is not None:
        model.weights, model.intercept = best[1][:-1], float(best[1][-1])
    return model
