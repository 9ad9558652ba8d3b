"""Cross-validated hyperparameter search over one cached training table."""

from __future__ import annotations

import json
import time
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import col
from regatta.models import ensemble
from regatta.models.base import FAMILIES, FittedModel, complete_rows
from regatta.models.extra import ExtraTreesModel, extra_steps
from regatta.models.linear import LinearModel, fit_linear, fit_linear_folds
from regatta.models.mlp import mlp_steps, worker_count
from regatta.models.partials import matrix
from regatta.models.svr import svr_steps
from regatta.models.together import FitTable, Job, fit_together
from regatta.models.trees import BINNED, fit_tree_models
from regatta.operators.metrics import METRICS, fold_metrics, metric_columns, regression_metrics
from regatta.operators.transforms import (
    TargetTransform, check_transform, fit_target_transform,
)
from regatta.plans.space import draw_params


@dataclass
class TrainingTable:
    """A table with features, target, ``is_test`` and ``fold``; cached by the caller."""

    df: DataFrame
    features: list[str]
    target: str
    key_cols: list[str]
    k: int
    transforms: dict = field(default_factory=dict)  # fold -> transform, and "all"
    _source: tuple | None = None
    _linear: dict | None = None

    def source(self) -> tuple[FitTable, list[TargetTransform]]:
        """The training rows as fits read them, written once, and the transforms of its labels."""
        labels = list(dict.fromkeys(self.transforms.values()))
        if self._source is None or self._source[1] != labels:
            targets = [t.forward(col(self.target).cast("double")) for t in labels]
            made = FitTable.of(self.train, self.features, targets, self.key_cols, "fold")
            self._source = made, labels
        return self._source

    @property
    def train(self) -> DataFrame:
        return self.df.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col("is_test"))

    def fit_transforms(self, kind: str) -> None:
        """The target transform is learnt inside every training fold, in shared passes."""
        check_transform(kind)
        if kind == "none":  # nothing to learn, no job
            self.transforms = {f: TargetTransform() for f in [*range(self.k), "all"]}
        else:
            self.transforms = fit_target_transform(self.train, self.target, kind, "fold")
        self._linear = None


def check_model(family: str) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unknown model: {family}")


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")


def higher_is_better(metric: str) -> bool:
    check_metric(metric)
    return metric == "r2"


def seed_of(*parts) -> int:
    """A seed from the run's seed and position, so that equal runs repeat exactly."""
    return zlib.crc32(json.dumps(parts).encode()) & 0x7FFFFFFF


def fit_model(
    df: DataFrame,
    features: list[str],
    target: str,
    family: str,
    params: dict | None = None,
    transform: TargetTransform = TargetTransform(),
    seed: int = 0,
    key_cols: list[str] = (),
) -> FittedModel:
    check_model(family)
    params = dict(params or {})
    if family == "LR":
        return fit_linear(df, features, target, transform)
    label = transform.forward(col(target).cast("double"))
    source = FitTable.of(df, features, [label], key_cols)
    return fit_jobs(source, family, [Job(params, seed, transform)])[0]


def fit_jobs(source: FitTable, family: str, jobs: list[Job], n_jobs: int = 1) -> list[FittedModel]:
    """Models of one family over one table, all but LR. Those of a lot share every pass; lots run
    side by side. A model is the same whatever is fitted with it."""
    if family in BINNED:
        return fit_tree_models(source, family, jobs)
    steps, together = {"ET": (extra_steps, 16), "SVR": (svr_steps, 512), "NN": (mlp_steps, 64)}[family]
    lots: list[tuple[int | None, list[int]]] = []
    by_workers: dict = {}
    for k, job in enumerate(jobs):
        by_workers.setdefault(worker_count(source, job.params) if family == "NN" else None, []).append(k)
    for workers, chosen in by_workers.items():
        lots += [(workers, chosen[at:at + together]) for at in range(0, len(chosen), together)]

    def fit(lot) -> list[FittedModel]:
        workers, chosen = lot
        fits = [
            steps(source, j.label, j.fold, j.transform, j.params, j.seed) for j in (jobs[k] for k in chosen)
        ]
        return fit_together(source, fits, workers)

    try:
        with ThreadPoolExecutor(max_workers=max(1, n_jobs)) as pool:
            found = list(pool.map(fit, lots))
    finally:
        source.close()
    by_job = {k: m for (_, chosen), models in zip(lots, found, strict=True) for k, m in zip(chosen, models, strict=True)}
    return [by_job[k] for k in range(len(jobs))]


def cv_models(
    table: TrainingTable, family: str, params: dict, seed: int, n_jobs: int = 1
) -> dict[int, FittedModel]:
    """One model per fold, trained on the other folds; all folds share their passes."""
    return trial_models(table, family, [params], [seed], n_jobs)[0]


def trial_models(
    table: TrainingTable, family: str, trials: list[dict], seeds: list[int], n_jobs: int = 1
) -> list[dict[int, FittedModel]]:
    """For each trial one model per fold. All trials and folds share one table and their passes."""
    if not table.transforms:
        table.fit_transforms("none")
    folds = {f: table.transforms[f] for f in range(table.k)}
    if family == "LR":  # all fits from one pass
        models = fit_linear_folds(table.train, table.features, table.target, folds)
        return [models for _ in trials]
    source, labels = table.source()
    jobs = [
        Job(dict(p), seed, t, labels.index(t), f)
        for p, seed in zip(trials, seeds, strict=True) for f, t in folds.items()
    ]
    fitted = iter(fit_jobs(source, family, jobs, n_jobs))
    return [{f: next(fitted) for f in folds} for _ in trials]


def score_folds(
    table: TrainingTable, models: dict[int, FittedModel], with_train: bool = False
) -> DataFrame:
    """``label, prediction, fold, split`` of every held-out row, and on request of the rows
    each fold was trained on."""
    label = col(table.target).cast("double").alias("label")
    if all(isinstance(m, LinearModel) for m in models.values()) and not with_train:
        chosen = None  # one pass: every row is scored by its own fold's expression
        for f, m in models.items():
            value = m.transform.inverse(m.expression())
            chosen = (F if chosen is None else chosen).when(F.col("fold") == f, value)
        return table.train.select(
            label, chosen.alias("prediction"), "fold", F.lit("val").alias("split")
        )
    out = None
    for f, m in models.items():
        rows = table.train if with_train else table.train.where(F.col("fold") == f)
        rows = complete_rows(rows, table.features)
        split = F.when(F.col("fold") == f, "val").otherwise("train")
        part = m.predict(rows, "prediction").select(
            label, "prediction", F.lit(f).alias("fold"), split.alias("split")
        )
        out = part if out is None else out.unionByName(part)
    return out


TRIALS_PER_SCORE = 20


def nodes_of(models: dict[int, FittedModel]) -> int:
    """Tree nodes of the models of a trial."""
    return sum(m.ensemble_.n_nodes for m in models.values() if isinstance(m, ExtraTreesModel))


def ignored_by(models: dict[int, FittedModel]) -> list[str]:
    return sorted({p for m in models.values() for p in m.ignored_params})


def _scored_together(trials: list[dict[int, FittedModel]]) -> list[list[dict[int, FittedModel]]]:
    """Trials in their order, in lots whose trees may be sent to every task."""
    lots, held = [], 0
    for models in trials:
        size = nodes_of(models)
        if not lots or len(lots[-1]) == TRIALS_PER_SCORE or held + size > ensemble.SENT_NODES:
            lots.append([])
            held = 0
        lots[-1].append(models)
        held += size
    return lots


def score_trials(table: TrainingTable, trials: list[dict[int, FittedModel]]) -> list[dict]:
    """Mean, population deviation and per-fold values of MSE, MAE and R2 for each trial.

    Every complete held-out row meets the models of its fold once, for many trials in one scan.
    Trials with tree ensembles too large for that are scored on their own.
    """
    spark = table.df.sparkSession
    label = col(table.target).cast("double").alias("label")
    inputs = [col(f).cast("double").alias(f"f{i}") for i, f in enumerate(table.features)]
    out = []
    for part in _scored_together(trials):
        if len(part) == 1 and nodes_of(part[0]) > ensemble.SENT_NODES:
            found = fold_metrics(score_folds(table, part[0])).first().asDict()
            out.append({**found, "ignored_params": ignored_by(part[0])})
            continue
        shared = spark.sparkContext.broadcast(part)
        names = [f"f{i}" for i in range(len(table.features))]
        schema = ", ".join(["label double", "fold int", *(f"p{t} double" for t in range(len(part)))])

        def decide(batches):
            for batch in batches:
                x, folds = matrix(batch, names), batch.column(1).to_numpy()
                found = np.full((len(shared.value), len(x)), np.nan)
                for f in np.unique(folds):
                    rows = np.flatnonzero(folds == f)
                    for t, models in enumerate(shared.value):
                        if f in models:
                            found[t, rows] = models[f].decide(x[rows])
                columns = [batch.column(0), batch.column(1), *(pa.array(p, pa.float64()) for p in found)]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "fold", *(f"p{t}" for t in range(len(found)))])

        scored = complete_rows(table.train.select(label, F.col("fold").cast("int").alias("fold"), *inputs), names)
        scored = scored.mapInArrow(decide, schema)
        aggregates = []
        for t, models in enumerate(part):
            raw, chosen = F.col(f"p{t}"), None
            if len({m.transform for m in models.values()}) == 1:
                chosen = next(iter(models.values())).transform.inverse(raw)
            else:
                for f, m in models.items():
                    chosen = (F if chosen is None else chosen).when(F.col("fold") == f, m.transform.inverse(raw))
            aggregates += [
                c.alias(f"{m}{t}") for c, m in zip(metric_columns(F.col("label"), chosen), METRICS, strict=True)
            ]
        rows = scored.groupBy("fold").agg(*aggregates).orderBy("fold").collect()
        shared.unpersist()
        for t, models in enumerate(part):
            scores: dict = {"ignored_params": ignored_by(models)}
            for m in METRICS:
                splits = [r[f"{m}{t}"] for r in rows]
                known = [v for v in splits if v is not None]
                scores[f"{m}_mean"] = float(np.mean(known)) if known else None
                scores[f"{m}_std"] = float(np.std(known)) if known else None
                scores[f"{m}_splits"] = splits
            out.append(scores)
    return out


def cross_validate(
    table: TrainingTable, family: str, params: dict, seed: int, n_jobs: int = 1
) -> dict:
    """Mean, population deviation and per-fold values of MSE, MAE and R2."""
    if family != "LR":
        return score_trials(table, trial_models(table, family, [params], [seed], n_jobs))[0]
    models = cv_models(table, family, params, seed, n_jobs)  # expressions: no Python needed
    return {**fold_metrics(score_folds(table, models)).first().asDict(), "ignored_params": []}


TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("trial_id", T.IntegerType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("params", T.StringType()),
        *[
            T.StructField(f"{m}_{part}", T.ArrayType(T.DoubleType()) if part == "splits" else T.DoubleType())
            for m in METRICS
            for part in ("mean", "std", "splits")
        ],
        T.StructField("ignored_params", T.ArrayType(T.StringType())),
    ]
)


def run_trials(
    table: TrainingTable, family: str, trials: list[dict], seed: int, n_jobs: int = 4
) -> DataFrame:
    """Evaluate trials, all folds of all of them together; one row each."""
    if family == "LR":  # without parameters: scored once for a table
        if table._linear is None:
            table._linear = cross_validate(table, family, {}, seed)
        scored = [table._linear] * len(trials)
    else:
        seeds = [seed_of(seed, i) for i in range(len(trials))]
        scored = score_trials(table, trial_models(table, family, trials, seeds, n_jobs))
    rows = []
    for i, scores in enumerate(scored):
        values = [scores[f"{m}_{part}"] for m in METRICS for part in ("mean", "std", "splits")]
        rows.append((i, family, json.dumps(trials[i]), *values, scores["ignored_params"]))
    return table.df.sparkSession.createDataFrame(rows, TRIAL_SCHEMA)


def best_trial(trials: DataFrame, metric: str):
    """The best row by the metric's direction; ties go to the lowest trial id."""
    value = F.when(~F.isnan(f"{metric}_mean"), F.col(f"{metric}_mean"))
    order = value.desc_nulls_last() if higher_is_better(metric) else value.asc_nulls_last()
    return trials.orderBy(order, "trial_id").first()


def train_test_metrics(table: TrainingTable, model: FittedModel) -> dict:
    """MSE, MAE and R2 of the final model on both parts, in one pass."""
    scored = model.predict(table.df, "prediction")
    rows = regression_metrics(scored, table.target, "prediction", ["is_test"]).collect()
    out = {}
    for r in rows:
        part = "test" if r["is_test"] else "train"
        out.update({f"{part}_{m}": r[m] for m in METRICS})
    return out


def optimize_and_evaluate(
    table: TrainingTable,
    family: str,
    metric: str,
    iteration: int,
    n_trials: int,
    n_jobs: int = 4,
    seed: int = 42,
    target_transform: str = "none",
    overrides: dict | None = None,
) -> tuple[dict, FittedModel, DataFrame]:
    """Search, refit the best parameters on all training rows, evaluate on both parts."""
    check_model(family)
    check_metric(metric)
    if not table.transforms:
        table.fit_transforms(target_transform)
    spark = table.df.sparkSession
    run_seed = seed_of(seed, family, metric, iteration)
    started = time.time()
    drawn = draw_params(spark, family, 1 if family == "LR" else n_trials, run_seed, overrides)
    trials = run_trials(table, family, drawn, run_seed, n_jobs)
    best = best_trial(trials, metric)
    elapsed = time.time() - started
    params = json.loads(best["params"])
    final, fit_seed = table.transforms["all"], seed_of(run_seed, best["trial_id"])
    if family == "LR":
        model = fit_linear(table.train, table.features, table.target, final)
    else:
        source, labels = table.source()
        model = fit_jobs(source, family, [Job(params, fit_seed, final, labels.index(final))])[0]
    scores = train_test_metrics(table, model)
    row = {
        "model_name": family,
        "iteration": iteration,
        "target": table.target,
        "target_transform": target_transform,
        "n_trials": len(drawn),
        "score": metric,
        "optimization_time": elapsed,
        "best_params": json.dumps({f"{family}__{n}": v for n, v in params.items()}),
        "ignored_params": model.ignored_params,
        "seed": seed,
    }
    for m in METRICS:
        name = m.upper()
        row[f"best_{name}"] = best[f"{m}_mean"]
        row[f"best_{name}_STD"] = best[f"{m}_std"]
        row[f"best_{name}_SPLITS"] = best[f"{m}_splits"]
        row[f"train_{name}"] = scores.get(f"train_{m}")
        row[f"test_{name}"] = scores.get(f"test_{m}")
    return row, model, trials

