"""A multilayer perceptron trained by averaging.

The rows are dealt to workers by key hash once. In every round each worker runs mini-batch
Adam over its own rows from the shared weights, and the weights meet as an average weighted
by rows (McMahan et al. 2017). One pass over the data thus makes many useful steps, and only
the weights travel.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.models.base import FittedModel
from regatta.models.extra import row_uniform
from regatta.models.together import FitTable, Request, Step

ROWS_PER_WORKER = 20_000
PATIENCE = 10
LOSS_TOL = 1e-4
HELD_OUT = 0.1  # share of rows that decides on stopping early
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8


@dataclass
class MlpModel(FittedModel):
    center: np.ndarray = None
    scale: np.ndarray = None
    y_center: float = 0.0
    y_scale: float = 1.0
    flat: np.ndarray = None
    rounds: int = 0

    @property
    def shapes(self) -> list[tuple[int, int]]:
        hidden = [int(u) for u in self.params.get("hidden_layer_sizes", (100,))]
        sizes = [len(self.features), *hidden, 1]
        return list(zip(sizes[:-1], sizes[1:]))

    def decide(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.center) / self.scale
        out = forward(x, unflatten(self.flat, self.shapes), self.params.get("activation", "relu"))
        return out[-1][:, 0] * self.y_scale + self.y_center

    def raw(self, df: DataFrame, output: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.decide(x.to_numpy(dtype=float)))

        values = [col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]
        return df.withColumn(output, score(F.struct(*values)))

    def state(self):
        return {
            "center": self.center, "scale": self.scale, "flat": self.flat,
            "y_center": np.array(self.y_center), "y_scale": np.array(self.y_scale),
        }


def unflatten(flat: np.ndarray, shapes) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes:
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def initial(shapes, rng) -> np.ndarray:
    parts = []
    for a, b in shapes:
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(x, layers, activation) -> list[np.ndarray]:
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        if i < len(layers) - 1:
            z = np.maximum(z, 0) if activation == "relu" else np.tanh(z)
        out.append(z)
    return out


def gradient(x, y, flat, shapes, activation, alpha) -> tuple[float, np.ndarray]:
    """Half mean squared error with an L2 penalty, and its gradient."""
    layers = unflatten(flat, shapes)
    acts = forward(x, layers, activation)
    n = len(y)
    error = acts[-1][:, 0] - y
    loss = 0.5 * (error @ error) / n
    delta, parts = error[:, None] / n, []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        loss += 0.5 * alpha * (w * w).sum() / n
        parts.append(delta.sum(axis=0))
        parts.append((acts[i].T @ delta + alpha * w / n).ravel())
        if i:
            slope = (acts[i] > 0) if activation == "relu" else 1 - acts[i] ** 2
            delta = (delta @ w.T) * slope
    return loss, np.concatenate(parts[::-1])


class _Round(Step):
    """One pass: every worker's own Adam run, summed with row counts as weights."""

    def __init__(self, model: MlpModel, state: tuple, steps: int, early: bool, seed: int):
        self.model, self.state, self.steps, self.early, self.seed = replace(model, flat=None), state, steps, early, seed
        self.size = 64 * len(state[0])

    def start(self):
        flat, m, v = (a.copy() for a in self.state)
        return {"flat": flat, "m": m, "v": v, "rng": np.random.default_rng(self.seed), "t": self.steps,
                "n": 0, "loss": 0.0, "held_n": 0, "held": 0.0, "taken": 0}

    def add(self, state, x, y, h):
        model, params, shapes = self.model, self.model.params, self.model.shapes
        batch_size = int(params.get("batch_size", 200))
        rate = float(params.get("learning_rate_init", 1e-3))
        alpha, activation = float(params.get("alpha", 1e-4)), params.get("activation", "relu")
        x, y = (x - model.center) / model.scale, (y - model.y_center) / model.y_scale
        if self.early:
            train = row_uniform(h, 0, self.seed_of_rows) < 1 - HELD_OUT
            if not train.all():  # scored with the weights the round started from
                error = forward(x[~train], unflatten(self.state[0], shapes), activation)[-1][:, 0] - y[~train]
                state["held"] += 0.5 * (error @ error)
                state["held_n"] += len(error)
            x, y = x[train], y[train]
        order = state["rng"].permutation(len(y))
        flat, m, v = state["flat"], state["m"], state["v"]
        for i in range(0, len(y), batch_size):
            part = order[i : i + batch_size]
            value, g = gradient(x[part], y[part], flat, shapes, activation, alpha)
            state["t"] += 1
            state["taken"] += 1
            m = BETA1 * m + (1 - BETA1) * g
            v = BETA2 * v + (1 - BETA2) * g * g
            step = rate * (m / (1 - BETA1 ** state["t"])) / (np.sqrt(v / (1 - BETA2 ** state["t"])) + EPS)
            flat = flat - step
            state["loss"] += value * len(part)
        state["flat"], state["m"], state["v"] = flat, m, v
        state["n"] += len(y)

    seed_of_rows = 0
    """The rows held out for early stopping are the same in every round."""

    def sums(self, s):
        counts = np.array([s["n"], s["loss"], s["held_n"], s["held"], s["taken"]], float)
        return {0: (counts, s["n"] * np.stack([s["flat"], s["m"], s["v"]]))}

    def combine(self, a, b):
        counts = a[0] + b[0]
        counts[4] = max(a[0][4], b[0][4])
        return counts, a[1] + b[1]


def worker_count(table: FitTable, params: dict) -> int:
    """Runs that are averaged: part of the model and not of the cluster."""
    each = int(params.get("rows_per_worker", ROWS_PER_WORKER))
    return max(1, -(-table.label_summary(0, None)[0] // each))


def mlp_steps(
    table: FitTable, label: int, fold: int | None, transform, params: dict, seed: int,
) -> Generator[Request, dict, MlpModel]:
    """One fit on the rows outside a fold, as steps of ``fit_together`` over dealt rows."""
    activation = params.get("activation", "relu")
    if activation not in ("relu", "tanh"):
        raise ValueError(f"unknown activation: {activation}")
    # the schedule belongs to plain gradient descent; Adam does not read it
    ignored = ["learning_rate"] if "learning_rate" in params else []
    model = MlpModel("NN", list(table.features), dict(params), transform, ignored)
    model.params.setdefault("rows_per_worker", ROWS_PER_WORKER)
    model.center, model.scale = table.scaling(fold)
    n, mean, deviation = table.label_summary(label, fold)
    if not n:
        raise ValueError("no rows to fit")
    model.y_center, model.y_scale = mean, deviation or 1.0

    early = bool(params.get("early_stopping", False))
    flat = initial(model.shapes, np.random.default_rng(seed))
    state = (flat, np.zeros_like(flat), np.zeros_like(flat))
    best, best_flat, stale, steps = np.inf, flat, 0, 0
    for r in range(int(params.get("max_iter", 200))):
        start = state[0]
        done = yield Request(_Round(model, state, steps, early, seed + r), label, fold)
        (n, loss, held_n, held, most), sums = done[0]
        weight = max(n, 1.0)
        state = tuple(v / weight for v in sums)
        steps += int(most)
        model.rounds = r + 1
        value = held / held_n if early and held_n else loss / weight
        stale = 0 if value < best - LOSS_TOL else stale + 1
        if value < best:
            # held-out rows were scored with the weights the round started from
            best, best_flat = value, (start if early and held_n else state[0])
        if stale >= PATIENCE:
            break
    model.flat = best_flat if early else state[0]
    return model
