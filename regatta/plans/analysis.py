"""A whole analysis: prepare, select, split, search every model, write the results."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from regatta.models.base import FittedModel
from regatta.operators.prepare import PrepareConfig, Prepared, prepare
from regatta.operators.scoring import SCORERS, project_features, select_features
from regatta.operators.split import assign_folds
from regatta.operators.transforms import check_transform
from regatta.plans.search import (
    TrainingTable, check_metric, check_model, optimize_and_evaluate,
)
from regatta.session import materialize
from regatta.sources import store
from regatta.sources.tables import read_table


@dataclass(frozen=True)
class AnalysisConfig:
    """Everything a run needs; the defaults are those of the launch form."""

    prepare: PrepareConfig
    models: tuple[str, ...] = ("LR",)
    metrics: tuple[str, ...] = ("mse",)
    target_transform: str = "none"
    n_features: int = 0
    feature_scoring: str = "f_regression"
    n_iter: int = 3
    k: int = 5
    n_trials: int = 50
    n_jobs: int = 4
    random_state: int = 42
    test_size: float = 0.2
    exact_folds: bool = False
    save_models: bool = False
    data_path: str | None = None
    overrides: dict = field(default_factory=dict)  # model -> {parameter: Domain}


@dataclass
class AnalysisRun:
    results: DataFrame
    prepared: Prepared
    table: TrainingTable
    models: dict[str, FittedModel]
    log: list[str]


def check_config(config: AnalysisConfig) -> None:
    for m in config.models:
        check_model(m)
    for m in config.metrics:
        check_metric(m)
    check_transform(config.target_transform)
    if config.feature_scoring not in SCORERS:
        raise ValueError(f"unknown feature scoring: {config.feature_scoring}")
    if config.n_iter < 1 or config.n_trials < 1 or config.k < 2:
        raise ValueError("n_iter and n_trials must be at least 1, k at least 2")


def build_context(df: DataFrame, config: AnalysisConfig, reuse: bool = True) -> tuple:
    """Prepared data and the training table: same inputs, same rows, folds and test set."""
    prepared = prepare(df, config.prepare)
    features = select_features(
        prepared.df, prepared.features, prepared.target, config.n_features, config.feature_scoring
    )
    keys, target = prepared.key_cols, prepared.target
    chosen = project_features(prepared.df, keys, target, features)
    split = assign_folds(
        chosen, keys, config.k, config.random_state, config.test_size, config.exact_folds
    )
    # read many times below: written once, so that fits prune and survive lost executors
    rows = materialize(split) if reuse else split
    return prepared, TrainingTable(rows, features, target, keys, config.k)


def run_grid(
    table: TrainingTable, config: AnalysisConfig, spark: SparkSession, exp: int,
    root: str | None = None, log: list[str] | None = None,
) -> tuple[DataFrame, dict[str, FittedModel]]:
    """models x metrics x iterations over one written table; trials are kept with the results."""
    log = [] if log is None else log
    table.fit_transforms(config.target_transform)
    rows, models = [], {}
    for family in config.models:
        for metric in config.metrics:
            for i in range(1, config.n_iter + 1):
                started = time.time()
                row, model, trials = optimize_and_evaluate(
                    table, family, metric, i, config.n_trials, config.n_jobs,
                    config.random_state, config.target_transform,
                    config.overrides.get(family),
                )
                rows.append(row)
                name = f"{family}_Exp{exp}_{metric}_{i}"
                models[name] = model
                if root:
                    store.write_trials(trials, root, name)
                if config.save_models and root:
                    size = store.save_model(spark, model, root, name)
                    log.append(f"Saved model: {name} | Size: {size / 1e6:.2f} MB")
                log.append(f"Iteration {i}/{config.n_iter} for {family} ({metric}) "
                           f"completed in {_elapsed(time.time() - started)}")
    return store.results_frame(spark, rows, exp), models


def run_analysis(
    spark: SparkSession, df: DataFrame, config: AnalysisConfig, root: str | None = None,
    exp: int | None = None,
) -> AnalysisRun:
    """One target end to end. With ``root`` the results, metadata, log and models are stored."""
    check_config(config)
    started = time.time()
    if exp is None:
        exp = store.allocate_experiment(spark, root) if root else 1
    log = [f"{n}: {v}" for n, v in _described(config).items()]
    prepared, table = build_context(df, config)
    log += [f"{s[0]}: {s[1]} rows, {s[2]} columns {s[3]}".rstrip() for s in prepared.steps]
    log.append(f"features: {', '.join(table.features)}")
    results, models = run_grid(table, config, spark, exp, root, log)
    log.append(f"Elapsed Time: {_elapsed(time.time() - started)}")
    if root:
        store.write_results(results, root)
        store.write_metadata(spark, root, exp, metadata_fields(config))
        store.write_log(spark, root, exp, log)
    return AnalysisRun(results, prepared, table, models, log)


def run_targets(
    spark: SparkSession, df: DataFrame, targets: list[str], config: AnalysisConfig, root: str
) -> list[int]:
    """One experiment per target, in order; returns their numbers."""
    done = []
    if len(targets) > 1:
        df = materialize(df)  # read from its source once
    for target in targets:
        exp = store.allocate_experiment(spark, root)
        one = replace(config, prepare=replace(config.prepare, target=target))
        run_analysis(spark, df, one, root, exp)
        done.append(exp)
    return done


def metadata_fields(config: AnalysisConfig) -> dict:
    p = config.prepare
    return {
        "data_path": config.data_path,
        "random_state": config.random_state,
        "target": p.target,
        "target_transform": config.target_transform,
        "features_to_drop": list(p.features_to_drop),
        "categorical_features": list(p.categorical_features),
        "n_features": config.n_features,
        "kfold": config.k,
        "feature_scoring": config.feature_scoring,
        "key_cols": list(p.key_cols),
        "test_size": float(config.test_size),
        "exact_folds": bool(config.exact_folds),
        "drop_leaky": p.drop_leaky,
        "composite_parts": list(p.composite_parts or ()),
        "sparse_threshold": float(p.sparse_threshold),
        "categorical_fill": p.categorical_fill,
        "non_numeric": p.non_numeric,
        "dedupe": p.dedupe,
    }


def rebuild_context(
    spark: SparkSession, root: str, exp: int, df: DataFrame | None = None,
    base: PrepareConfig | None = None,
) -> TrainingTable:
    """The training table of a stored experiment, so that its test rows are the same again."""
    m = store.read_metadata(spark, root, exp).first()
    rows = df if df is not None else read_table(spark, m["data_path"])
    fields = dict(
        target=m["target"], key_cols=tuple(m["key_cols"]),
        features_to_drop=tuple(m["features_to_drop"]),
        categorical_features=tuple(m["categorical_features"]),
        composite_parts=tuple(m["composite_parts"]) or None,
        **{n: m[n] for n in ("drop_leaky", "sparse_threshold", "categorical_fill", "non_numeric", "dedupe")},
    )
    prep = replace(base, **fields) if base else PrepareConfig(**fields)
    config = AnalysisConfig(
        prep, n_features=m["n_features"], feature_scoring=m["feature_scoring"],
        k=m["kfold"] or 5, random_state=m["random_state"], test_size=m["test_size"],
        exact_folds=m["exact_folds"],
    )
    return build_context(rows, config)[1]


def _described(config: AnalysisConfig) -> dict:
    flat = asdict(config)
    flat.pop("overrides")
    flat.update({f"prepare.{n}": v for n, v in flat.pop("prepare").items()})
    return flat


def _elapsed(seconds: float) -> str:
    hours, rest = divmod(seconds, 3600)
    minutes, left = divmod(rest, 60)
    if hours >= 1:
        return f"{int(hours)}h {int(minutes)}m {left:.2f}s"
    return f"{int(minutes)}m {left:.2f}s" if minutes >= 1 else f"{left:.2f}s"

