"""Search domains and seeded random sampling of trials (Bergstra and Bengio 2012)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.functions.hashing import hash_columns, unit_interval


@dataclass(frozen=True)
class Domain:
    """One hyperparameter: ``int`` or ``float`` range, or ``choice`` among values."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 0.0
    step: float | None = None
    log: bool = False
    choices: tuple = ()
    when: tuple | None = None  # (parameter, values) that must hold

    def expression(self, u: Column) -> Column:
        if self.kind == "choice":
            at = F.floor(u * len(self.choices)).cast("int") + 1
            if isinstance(self.choices[0], tuple):
                options = [F.array(*[F.lit(v) for v in c]) for c in self.choices]
            else:
                options = [F.lit(v) for v in self.choices]
            return F.element_at(F.array(*options), at)
        if self.kind == "int":
            step = int(self.step or 1)
            count = int((self.high - self.low) // step) + 1
            return (F.lit(int(self.low)) + F.lit(step) * F.floor(u * count)).cast("int")
        if self.step:
            count = int(round((self.high - self.low) / self.step)) + 1
            return F.round(F.lit(self.low) + F.floor(u * count) * self.step, 10)
        if self.log:
            low, high = math.log(self.low), math.log(self.high)
            return F.exp(F.lit(low) + u * (high - low))
        return F.lit(self.low) + u * (self.high - self.low)


def _int(name, low, high, step=None, when=None):
    return Domain(name, "int", low, high, step, when=when)


def _float(name, low, high, step=None, log=False, when=None):
    return Domain(name, "float", low, high, step, log, when=when)


def _choice(name, *choices):
    return Domain(name, "choice", choices=choices)


# The search space of every family.
HIDDEN_LAYERS = (
    (32,), (64,), (128,), (256,), (512,), (1024,),
    (64, 32), (128, 64), (256, 128), (512, 256),
    (1024, 512), (128, 32), (256, 64), (512, 128),
    (128, 64, 32), (256, 128, 64), (512, 256, 128),
    (1024, 512, 256), (64, 32, 16), (256, 128, 32),
    (512, 256, 128, 64), (1024, 512, 256, 128),
    (128, 64, 32, 16), (256, 128, 64, 32), (512, 256, 128, 32),
    (1024, 512, 256, 128, 64), (512, 256, 128, 64, 32),
    (256, 128, 64, 32, 16), (128, 64, 32, 16, 8),
    (64, 64, 64, 64), (128, 128, 128, 128),
    (256, 256, 256, 256), (512, 512, 512, 512),
    (1024, 512, 256, 128, 64, 32),
    (512, 256, 128, 64, 32, 16),
    (256, 128, 64, 32, 16, 8),
    (128, 64, 32, 16, 8, 4),
)
_FOREST = (
    _int("n_estimators", 100, 2000, 100),
    _int("max_depth", 5, 30),
    _int("min_samples_split", 2, 10),
    _int("min_samples_leaf", 1, 10),
    _choice("bootstrap", True, False),
)
SEARCH_SPACE: dict[str, tuple[Domain, ...]] = {
    "RF": _FOREST,
    "ET": _FOREST,
    "XGB": (
        _choice("objective", "reg:squarederror"),
        _choice("booster", "gbtree"),
        _choice("tree_method", "approx", "hist"),
        _int("n_estimators", 100, 2000, 100),
        _int("max_depth", 5, 30),
        _float("learning_rate", 1e-3, 0.3, log=True),
        _int("min_child_weight", 1, 100),
        _float("subsample", 0.5, 1.0, 0.1),
        _float("colsample_bytree", 0.5, 1.0, 0.1),
        _float("gamma", 0.0, 5.0, 0.1),
        _float("lambda", 1e-8, 10.0, log=True),
        _float("alpha", 1e-8, 10.0, log=True),
    ),
    "LGB": (
        _choice("boosting_type", "gbdt", "dart"),
        _int("n_estimators", 100, 2000, 100),
        _int("max_depth", 5, 30),
        _float("learning_rate", 1e-3, 0.3, log=True),
        _int("num_leaves", 31, 512),
        _int("min_child_samples", 5, 100),
        _float("subsample", 0.5, 1.0, 0.1),
        _float("colsample_bytree", 0.5, 1.0, 0.1),
        _float("reg_alpha", 1e-8, 10.0, log=True),
        _float("reg_lambda", 1e-8, 10.0, log=True),
        _float("min_split_gain", 0.0, 1.0),
        _int("bagging_freq", 1, 10),
        _int("max_bin", 128, 512),
    ),
    "NN": (
        _choice("solver", "adam"),
        _choice("activation", "relu", "tanh"),
        _float("alpha", 1e-5, 1e-2, log=True),
        _float("learning_rate_init", 1e-4, 1e-2, log=True),
        _choice("hidden_layer_sizes", *HIDDEN_LAYERS),
        _choice("batch_size", 16, 32, 64, 128),
        _choice("learning_rate", "constant", "adaptive"),
        _choice("early_stopping", True, False),
        _int("max_iter", 1000, 4000),
    ),
    "SVR": (
        _float("C", 1e-3, 1e4, log=True),
        _float("epsilon", 1e-4, 1.0, log=True),
        _choice("kernel", "linear", "rbf", "poly"),
        _float("tol", 1e-5, 1e-1, log=True),
        _choice("shrinking", True, False),
        _int("max_iter", 1000, 20000),
        _int("degree", 2, 6, when=("kernel", ("poly",))),
        _float("gamma", 1e-6, 1e-1, log=True, when=("kernel", ("rbf", "poly"))),
        _float("coef0", 0.0, 1.0, when=("kernel", ("rbf", "poly"))),
    ),
    "LR": (),
}


def search_space(family: str, overrides: dict[str, Domain] | None = None) -> tuple[Domain, ...]:
    """The family's domains; ``overrides`` replaces some of them, for smaller searches."""
    if family not in SEARCH_SPACE:
        raise ValueError(f"unknown model: {family}")
    overrides = overrides or {}
    return tuple(overrides.get(d.name, d) for d in SEARCH_SPACE[family])


def domain_table(spark: SparkSession) -> DataFrame:
    """Every domain as a row."""
    rows = [
        (family, i, d.name, d.kind, float(d.low), float(d.high),
         None if d.step is None else float(d.step), d.log,
         [json.dumps(c) for c in d.choices], json.dumps(d.when) if d.when else None)
        for family, domains in SEARCH_SPACE.items()
        for i, d in enumerate(domains)
    ]
    return spark.createDataFrame(
        rows,
        "model string, position int, param string, kind string, low double, high double, "
        "step double, log boolean, choices array<string>, condition string",
    )


def sample_trials(
    ids: DataFrame, id_col: str, family: str, seed: int = 0, overrides: dict | None = None
) -> DataFrame:
    """One typed column per hyperparameter, a function of the trial id and the seed."""
    domains = search_space(family, overrides)
    key = col(id_col).cast("bigint")
    sampled: dict[str, Column] = {}
    for i, d in enumerate(domains):
        value = d.expression(unit_interval(hash_columns([key], seed * 1000 + i)))
        if d.when:
            value = F.when(sampled[d.when[0]].isin(list(d.when[1])), value)
        sampled[d.name] = value
    return ids.select(key.alias("trial_id"), *[v.alias(n) for n, v in sampled.items()])


def sample_hidden_layers(
    ids: DataFrame, id_col: str, seed: int = 0, max_layers: int = 10, max_units: int = 1024
) -> DataFrame:
    """1 to ``max_layers`` layers of 32 to ``max_units`` units in steps of 32."""
    key = col(id_col).cast("bigint")
    u = [unit_interval(hash_columns([key], seed * 1000 + i)) for i in range(max_layers + 1)]
    n_layers = (F.floor(u[0] * max_layers) + 1).cast("int")
    units = [(32 * (F.floor(v * (max_units // 32)) + 1)).cast("int") for v in u[1:]]
    return ids.select(
        key.alias("trial_id"),
        n_layers.alias("n_layers"),
        F.slice(F.array(*units), F.lit(1), n_layers).alias("hidden_layer_sizes"),
    )


def draw_params(
    spark: SparkSession, family: str, n_trials: int, seed: int, overrides: dict | None = None
) -> list[dict]:
    """Parameter dictionaries of trials 0..n-1; parameters whose condition fails are absent."""
    domains = search_space(family, overrides)
    if not domains:
        return [{}]
    trials = sample_trials(spark.range(n_trials), "id", family, seed, overrides)
    packed = F.to_json(F.struct(*[col(d.name) for d in domains]))
    rows = trials.select("trial_id", packed.alias("p")).orderBy("trial_id").collect()
    return [json.loads(r["p"]) for r in rows]
