"""Ensembles that are larger than what a task may be sent."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models_plans import models, synthetic, table  # noqa: F401

from regatta.models import ensemble, grow
from regatta.models.ensemble import Ensemble, Tree
from regatta.operators import explain
from regatta.plans import search
from regatta.session import shared_folder

TREES = ("RF", "ET", "XGB", "LGB")


def tree(feature, cut, low, high):
    return Tree(np.array([feature, -1, -1]), np.array([cut, 0.0, 0.0]), np.array([1, 0, 0]),
                np.array([2, 0, 0]), np.array([0.0, low, high]), np.array([4.0, 1.0, 3.0]))


def tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("table-")}


def test_parts_keep_all_trees_in_order():
    whole = Ensemble([tree(k % 2, k, k, -k) for k in range(7)], list(range(7)), 5.0)
    for nodes, parts in ((1, 7), (3, 7), (6, 4), (8, 4), (9, 3), (21, 1), (100, 1)):
        cut = whole.parts(nodes)
        assert len(cut) == parts
        assert [t for p in cut for t in p.trees] == whole.trees
        assert [w for p in cut for w in p.weights] == whole.weights
        assert [p.base for p in cut] == [5.0] + [0.0] * (parts - 1)
    assert [p.base for p in Ensemble([], [], 2.0).parts(1)] == [2.0]


@pytest.mark.parametrize("family", TREES)
def test_parts_predict_and_explain_like_the_whole(spark, table, models, family, monkeypatch):  # noqa: F811
    model = models[family]
    rows = synthetic(spark, 300).withColumn("with.dot", F.lit(None).cast("string"))
    order = [F.col("id")]
    known = model.raw(rows, "p").orderBy(*order).collect()
    shap = ["id", "feature", "shap_value", "base_value"]
    values = explain.shap_tree(model, rows, ["id"]).select(*shap).orderBy("id", "feature").collect()
    monkeypatch.setattr(ensemble, "SENT_NODES", 20)
    monkeypatch.setattr(ensemble, "EXPLAINED_NODES", 20)
    assert len(model.ensemble_.parts(20)) > 2
    before = tables(spark)
    found = model.raw(rows, "p")
    assert len(tables(spark) - before) == 1  # the sums of the last pass; earlier ones are removed
    assert found.columns == [*rows.columns, "p"]
    assert found.orderBy(*order).collect() == known
    parted = explain.shap_tree(model, rows, ["id"]).select(*shap).orderBy("id", "feature").collect()
    assert [(r.id, r.feature) for r in parted] == [(r.id, r.feature) for r in values]
    assert np.allclose([r.shap_value for r in parted], [r.shap_value for r in values])


def test_large_trials_score_like_small_ones(table, models, monkeypatch):  # noqa: F811
    trials = [dict.fromkeys(range(3), models[f]) for f in (*TREES, "SVR", "NN")]
    known = search.score_trials(table, trials)
    sizes = [search.nodes_of(t) for t in trials]
    assert all(sizes[:4]) and sizes[4:] == [0, 0]
    monkeypatch.setattr(ensemble, "SENT_NODES", min(sizes[:4]) - 1)
    assert [len(lot) for lot in search._scored_together(trials)] == [1, 1, 1, 1, 2]
    for a, b in zip(known, search.score_trials(table, trials), strict=True):
        assert a["ignored_params"] == b["ignored_params"]
        assert np.allclose([a["mse_mean"], *a["r2_splits"]], [b["mse_mean"], *b["r2_splits"]])


def test_tables_of_paths_are_bounded(monkeypatch):
    rng = np.random.default_rng(1)
    trees = [tree(k % 3, rng.random(), rng.random(), rng.random()) for k in range(2_000)]
    x = rng.random((40, 3))
    known = Ensemble(trees, [1.0] * len(trees)).shapley(x)
    monkeypatch.setattr(ensemble, "TABLE_CELLS", 3_000)
    some = Ensemble(trees, [1.0] * len(trees))
    with_table = [p.table is not None for p in some.paths()]
    assert any(with_table) and not all(with_table)
    assert np.allclose(some.shapley(x), known)


def test_growth_stops_at_the_limit_of_the_driver(table, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ensemble, "MAX_NODES", 30)
    for family in ("RF", "ET"):
        with pytest.raises(ValueError, match="too many"):
            search.fit_model(table.train, table.features, "y", family,
                             {"n_estimators": 20, "max_depth": 5}, seed=3, key_cols=["id"])
    assert grow.check_nodes is ensemble.check_nodes


def test_a_tree_too_large_for_a_task_raises(spark, monkeypatch):
    monkeypatch.setattr(ensemble, "TREE_NODES", 2)
    with pytest.raises(ValueError, match="too large"):
        ensemble.predict_ensemble(spark.range(1).select(F.col("id").alias("a")), Ensemble([tree(0, 0, 1, 2)], [1.0]), ["a"], "p")
