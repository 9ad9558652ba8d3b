"""Random forests and boosted trees on a binned table."""

from __future__ import annotations

from regatta.models.base import FittedModel
from regatta.models.binned import BinnedTable
from regatta.models.extra import ExtraTreesModel
from regatta.models.grow import Fit, Limits, Plan, grow
from regatta.models.together import FitTable, Job

BINNED = ("RF", "XGB", "LGB")
FOREST_BINS = 64

MODELS_TOGETHER = 40
"""Models whose fits a row of the table holds, 8 bytes each."""


def plan(family: str, params: dict, seed: int, d: int) -> tuple[Plan, int, list[str]]:
    """The plan of a family's parameters, its bins, and the parameters that decide nothing.

    Penalties are off unless given.
    """
    p = dict(params)
    n_trees = int(p.get("n_estimators", 100))
    if family == "RF":
        limits = Limits(
            max_depth=int(p.get("max_depth", 30)), min_split=int(p.get("min_samples_split", 2)),
            min_leaf=int(p.get("min_samples_leaf", 1)))
        made = Plan(False, n_trees, limits, seed, bootstrap=bool(p.get("bootstrap", True)))
        return made, int(p.get("max_bins", FOREST_BINS)), []
    share, columns = float(p.get("subsample", 1.0)), float(p.get("colsample_bytree", 1.0))
    if family == "XGB":
        limits = Limits(
            max_depth=int(p.get("max_depth", 6)), min_leaf=float(p.get("min_child_weight", 1)),
            min_gain=float(p.get("gamma", 0.0)), l1=float(p.get("alpha", 0.0)), l2=float(p.get("lambda", 0.0)))
        made = Plan(
            True, n_trees, limits, seed, rate=float(p.get("learning_rate", 0.3)), share=share,
            columns=max(1, int(columns * d)) if columns < 1 else None)
        # Both methods bin the values; they differ in when, which a fixed table does not.
        return made, int(p.get("max_bins", 256)), ["tree_method"] if "tree_method" in p else []
    freq = int(p.get("bagging_freq", 1))
    depth = int(p.get("max_depth", -1))
    limits = Limits(
        max_depth=depth if depth > 0 else 1 << 30, max_leaves=int(p.get("num_leaves", 31)),
        min_leaf=int(p.get("min_child_samples", 20)), min_gain=float(p.get("min_split_gain", 0.0)),
        l1=float(p.get("reg_alpha", 0.0)), l2=float(p.get("reg_lambda", 0.0)))
    made = Plan(
        True, n_trees, limits, seed, rate=float(p.get("learning_rate", 0.1)),
        share=share if freq > 0 else 1.0, bagging_freq=max(1, freq),
        columns=max(1, round(columns * d)) if columns < 1 else None,
        dart=p.get("boosting_type", "gbdt") == "dart")
    return made, int(p.get("max_bin", 255)), []


def fit_tree_models(source: FitTable, family: str, jobs: list[Job]) -> list[FittedModel]:
    """Fit many models of a family; those with equal bins share a coded table and every pass.

    Boosts start from the mean label; draws of rows depend on the row key, not on the layout.
    """
    plans = [plan(family, j.params, j.seed, len(source.features)) for j in jobs]
    out: dict[int, FittedModel] = {}
    for bins in sorted({b for _, b, _ in plans}):
        alike = [k for k, (_, b, _) in enumerate(plans) if b == bins]
        for at in range(0, len(alike), MODELS_TOGETHER):
            chosen = alike[at:at + MODELS_TOGETHER]
            draws = list(dict.fromkeys(d for k in chosen for d in plans[k][0].draws()))
            folds = {jobs[k].fold for k in chosen} - {None}
            table = BinnedTable(source, bins, len(chosen), draws, list(folds))
            fits = [Fit(plans[k][0], table, jobs[k].label, jobs[k].fold) for k in chosen]
            for k, ensemble in zip(chosen, grow(table, fits), strict=True):
                out[k] = ExtraTreesModel(
                    family, list(source.features), dict(jobs[k].params), jobs[k].transform, plans[k][2], ensemble)
            source.passes += table.passes
    return [out[k] for k in range(len(jobs))]
