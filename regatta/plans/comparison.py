"""Compare many models with default parameters, tune the best, rank them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.models.base import FAMILIES
from regatta.operators import clean
from regatta.operators.metrics import EXTRA_METRICS, cv_performance, performance_wide
from regatta.operators.prepare import PrepareConfig, prepare
from regatta.operators.ranking import rank_within
from regatta.operators.split import assign_folds, repeat_seeds
from regatta.plans.search import (
    TrainingTable, best_trial, cv_models, run_trials, score_folds, seed_of,
)
from regatta.plans.space import draw_params
from regatta.session import materialize

KEPT_MODELS = 10
TUNING_TRIALS = 200
FOLDS = 5
SPLIT_SEED = 42

# metric -> higher is better
DIRECTIONS = {m: m == "R2" for m in EXTRA_METRICS}


def model_performances(
    table: TrainingTable, candidates: dict[str, tuple[str, dict]], seed: int, n_jobs: int = 1
) -> DataFrame:
    """Train and validation metrics over folds of named ``(family, params)`` candidates."""
    scored = None
    for name, (family, params) in candidates.items():
        models = cv_models(table, family, params, seed, n_jobs)
        part = score_folds(table, models, with_train=True).withColumn("model_name", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    return cv_performance(scored)


@dataclass
class ModelComparison:
    """Steps in order: ``create_experiments``, ``select_models``, ``tune_models``."""

    dataset: DataFrame
    config: PrepareConfig
    session_ids: list[int] | str = "random"
    n_experiments: int = 1
    families: tuple[str, ...] = FAMILIES
    defaults: dict = field(default_factory=dict)  # family -> default parameters
    overrides: dict = field(default_factory=dict)  # family -> {parameter: Domain}
    n_jobs: int = 4
    n_trials: int = TUNING_TRIALS

    def __post_init__(self):
        spark = self.dataset.sparkSession
        self.seeds = repeat_seeds(spark, self.n_experiments, self.session_ids)
        rows, config = self.dataset, self.config
        if config.target == clean.COMPOSITE_TARGET:
            parts = clean.LEAKING_COLUMNS[clean.COMPOSITE_TARGET]
            rows = clean.composite_target(rows, config.target, parts, skipna=True)
        prepared = prepare(rows, config)
        split = assign_folds(prepared.df, prepared.key_cols, FOLDS, SPLIT_SEED)
        self.table = TrainingTable(
            materialize(split), prepared.features, prepared.target, prepared.key_cols, FOLDS
        )
        self.experiments: dict[str, dict] = {}

    def create_experiments(self) -> None:
        self.experiments = {
            f"Experiment_{i + 1}": {"seed": s} for i, s in enumerate(self.seeds)
        }

    def select_models(self) -> None:
        """Keep the best models of each experiment by validation R2."""
        if not self.experiments:
            raise RuntimeError("create_experiments() comes first")
        candidates = {f: (f, self.defaults.get(f, {})) for f in self.families}
        for e in self.experiments.values():
            wide = performance_wide(
                model_performances(self.table, candidates, e["seed"], self.n_jobs)
            )
            kept = wide.orderBy(F.desc_nulls_last("R2_val_mean"), "model_name").limit(KEPT_MODELS)
            e["models_results"] = materialize(kept)
            e["models"] = [
                r["model_name"]
                for r in e["models_results"].orderBy(
                    F.desc_nulls_last("R2_val_mean"), "model_name"
                ).collect()
            ]

    def tune_models(self) -> None:
        """Tune every kept model; the tuned one is used whether or not it is better."""
        if not all("models" in e for e in self.experiments.values()) or not self.experiments:
            raise RuntimeError("select_models() comes first")
        spark = self.dataset.sparkSession
        for e in self.experiments.values():
            tuned = {}
            for family in e["models"]:
                seed = seed_of(e["seed"], family)
                drawn = draw_params(
                    spark, family, self.n_trials, seed, self.overrides.get(family)
                )
                trials = run_trials(self.table, family, drawn, seed, self.n_jobs)
                tuned[family] = (family, drawn[best_trial(trials, "r2")["trial_id"]])
            wide = performance_wide(
                model_performances(self.table, tuned, e["seed"], self.n_jobs)
            )
            e["tuned_models"] = tuned
            e["tuned_results"] = materialize(wide)

    def performances(self) -> DataFrame | None:
        """Wide results of every finished step with ``experiment`` and ``stage``."""
        out = None
        for name, e in self.experiments.items():
            for stage, key in (("selected", "models_results"), ("tuned", "tuned_results")):
                if key in e:
                    part = e[key].withColumns(
                        {"experiment": F.lit(name), "stage": F.lit(stage)}
                    )
                    out = part if out is None else out.unionByName(part)
        return out

    def rank_models(self, metric: str = "R2") -> DataFrame:
        """Models ranked by a validation metric, per experiment and stage."""
        if metric not in DIRECTIONS:
            raise ValueError(f"unknown metric: {metric}")
        table = self.performances()
        if table is None:
            raise RuntimeError("no models were selected")
        return rank_performances(table, metric)


def rank_performances(table: DataFrame, metric: str = "R2") -> DataFrame:
    column = f"{metric}_val_mean"
    ranked = rank_within(table, ["experiment", "stage"], column, DIRECTIONS[metric], "model_name")
    return ranked.select("experiment", "stage", "rank", "model_name", column)
