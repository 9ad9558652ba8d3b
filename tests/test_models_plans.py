import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.models import ensemble
from regatta.models.ensemble import Ensemble, Tree
from regatta.models.linear import fit_linear, product_sums
from regatta.operators import explain, metrics
from regatta.operators.prepare import PrepareConfig
from regatta.operators.split import assign_folds
from regatta.operators.transforms import TargetTransform
from regatta.plans import search
from regatta.plans.analysis import AnalysisConfig, rebuild_context, run_analysis, run_targets
from regatta.plans.comparison import ModelComparison
from regatta.plans.space import SEARCH_SPACE, Domain, domain_table, draw_params
from regatta.sources import store

PARAMS = {
    "LR": {},
    "RF": {"n_estimators": 5, "max_depth": 5},
    "ET": {"n_estimators": 5, "max_depth": 6, "min_samples_leaf": 3, "bootstrap": True},
    "XGB": {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.5, "lambda": 1.0},
    "LGB": {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.5, "boosting_type": "dart"},
    "SVR": {"kernel": "rbf", "C": 10.0, "epsilon": 0.1, "gamma": 0.1, "shrinking": True},
    "NN": {"hidden_layer_sizes": [16], "batch_size": 32, "learning_rate_init": 0.01, "max_iter": 15},
}


def synthetic(spark, n=1500):
    df = spark.range(n).select(
        "id",
        (F.pmod(F.col("id") * 37, F.lit(101)) / 10.0).alias("a"),
        (F.pmod(F.col("id") * 53, F.lit(97)) / 7.0).alias("b"),
        (F.col("id") % 2 == 0).alias("flag"),
    )
    noise = F.pmod(F.col("id") * 71, F.lit(13)) / 13.0
    return df.withColumn("y", 3 * F.col("a") - F.col("b") + F.when(F.col("flag"), 4).otherwise(0) + noise + 20)


@pytest.fixture(scope="module")
def table(spark):
    df = assign_folds(synthetic(spark), ["id"], k=3).cache()
    return search.TrainingTable(df, ["a", "b", "flag"], "y", ["id"], 3)


@pytest.fixture(scope="module")
def models(table):
    return {
        f: search.fit_model(table.train, table.features, "y", f, p, seed=3, key_cols=["id"])
        for f, p in PARAMS.items()
    }


@pytest.mark.parametrize("family", list(PARAMS))
def test_every_family_learns_and_survives_saving(spark, table, models, family, tmp_path):
    model = models[family]
    scores = search.train_test_metrics(table, model)
    assert scores["test_r2"] > (0.8 if family in ("LGB", "XGB", "RF", "ET") else 0.95), scores
    size = store.save_model(spark, model, str(tmp_path), f"{family}_Exp1_mse_1")
    assert size > 0
    listed = store.list_models(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in listed] == [(f"{family}_Exp1_mse_1", family)]
    back = store.load_model(spark, str(tmp_path), f"{family}_Exp1_mse_1")
    both = model.predict(table.test, "p").join(back.predict(table.test.select("id", "a", "b", "flag"), "q"), "id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert back.params == model.params and back.ignored_params == model.ignored_params


@pytest.mark.parametrize("family", ["LR", "RF", "SVR"])
def test_names_with_dots_work_throughout(spark, family):
    df = synthetic(spark, 300).withColumnsRenamed({"a": "a.1", "flag": "is on", "y": "the.y"})
    split = assign_folds(df, ["id"], k=2).cache()
    t = search.TrainingTable(split, ["a.1", "b", "is on"], "the.y", ["id"], 2)
    params = {**PARAMS[family], "kernel": "linear"} if family == "SVR" else PARAMS[family]
    model = search.fit_model(t.train, t.features, "the.y", family, params, seed=1, key_cols=["id"])
    assert search.train_test_metrics(t, model)["test_r2"] > 0.7
    assert search.cross_validate(t, family, params, 1)["r2_mean"] > 0.7
    assert explain.residuals(model, t.test, "the.y", ["id"]).count() == t.test.count()


def test_unusable_parameters_are_named(models):
    assert models["SVR"].ignored_params == ["shrinking"]
    for family in ("RF", "ET", "XGB", "LGB"):
        assert models[family].ignored_params == []


@pytest.mark.parametrize("family", ["LR", "RF", "ET", "XGB", "LGB"])
def test_shapley_values_add_up(table, models, family):
    shap = explain.shap_values(models[family], table.test, ["id"])
    assert shap.count() == 3 * table.test.count()
    both = explain.additivity(shap, ["id"]).join(models[family].predict(table.test, "p"), "id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("explained")))).first()[0] < 1e-9
    assert explain.shap_summary(shap).first()["feature"] == "a"


def test_other_families_cannot_be_explained(table, models):
    for family in ("NN", "SVR"):
        with pytest.raises(ValueError):
            explain.shap_values(models[family], table.test, ["id"])


def test_tree_shapley_equals_the_definition(monkeypatch):
    """Against the sum over all feature subsets, expectations following the cover."""
    from itertools import combinations
    from math import factorial

    tree = Tree(
        np.array([0, 1, 0, -1, -1, -1, 2, -1, -1]),
        np.array([0.5, 0.3, 0.8, 0, 0, 0, 0.6, 0, 0]),
        np.array([1, 3, 5, 0, 0, 0, 7, 0, 0]),
        np.array([2, 4, 6, 0, 0, 0, 8, 0, 0]),
        np.array([0, 0, 0, 1.0, 5.0, -2.0, 0, 3.0, 9.0]),
        np.array([10, 6, 4, 2, 4, 1, 3, 1, 2.0]),
    )

    def expected(x, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        lo, hi = tree.left[node], tree.right[node]
        if f in known:
            return expected(x, known, lo if x[f] <= tree.threshold[node] else hi)
        return sum(tree.cover[c] * expected(x, known, c) for c in (lo, hi)) / tree.cover[node]

    x = np.random.default_rng(0).random((20, 3))
    got = Ensemble([tree], [1.0]).shapley(x)
    for name, value in (("PATTERNS", 0), ("CELLS", 7), ("LEAVES", 2)):  # without tables, in small blocks
        monkeypatch.setattr(ensemble, name, value)
        np.testing.assert_allclose(Ensemble([tree], [1.0]).shapley(x), got, rtol=1e-12)
    for i, row in enumerate(x):
        for j in range(3):
            others, value = [f for f in range(3) if f != j], 0.0
            for size in range(3):
                for s in combinations(others, size):
                    w = factorial(size) * factorial(2 - size) / factorial(3)
                    value += w * (expected(row, {*s, j}) - expected(row, set(s)))
            assert abs(got[i, j] - value) < 1e-12


def test_product_sums_in_sql_and_in_tasks_agree(spark, table):
    from regatta.models import linear

    columns = {n: F.col(n) for n in ("a", "b", "y")}
    center, sql = product_sums(table.train, columns, by="fold")
    limit, linear.JVM_COLUMNS = linear.JVM_COLUMNS, 0
    try:
        _, tasks = product_sums(table.train, columns, by="fold")
    finally:
        linear.JVM_COLUMNS = limit
    assert set(sql) == set(tasks) == {0, 1, 2}
    for g in sql:
        np.testing.assert_allclose(sql[g], tasks[g], rtol=1e-9, atol=1e-6)


def test_merging_on_executors_changes_nothing(spark, table, monkeypatch):
    from regatta.models import extra, linear, partials

    fit = lambda: search.fit_model(
        table.train, table.features, "y", "ET", PARAMS["ET"], seed=3, key_cols=["id"]
    )
    columns = {n: F.col(n) for n in ("a", "b", "y")}
    monkeypatch.setattr(linear, "JVM_COLUMNS", 0)
    rows = table.train.repartition(6)
    _, direct = product_sums(rows, columns, by="fold")
    plain = fit()
    monkeypatch.setattr(partials, "DIRECT", 0)
    monkeypatch.setattr(extra, "SLICE", 3)
    _, merged = product_sums(rows, columns, by="fold")
    for g in direct:
        np.testing.assert_allclose(direct[g], merged[g], rtol=1e-9, atol=1e-6)
    gap = fit().predict(plain.predict(table.test, "p"), "q").agg(F.max(F.abs(F.col("p") - F.col("q"))))
    assert gap.first()[0] < 1e-9


def test_collinear_and_constant_columns(spark):
    df = synthetic(spark, 200).withColumns({"off": ~F.col("flag"), "one": F.lit(1.0)})
    m = fit_linear(df, ["a", "flag", "off", "one"], "y", TargetTransform())
    plain = fit_linear(df, ["a", "flag"], "y", TargetTransform())
    gap = plain.predict(m.predict(df, "p"), "q").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap < 1e-8 and m.coefficients[3] == 0.0
    assert abs(explain.residuals(plain, df, "y").agg(F.avg("residual")).first()[0]) < 1e-9


def test_fold_models_equal_separate_fits(table):
    table.fit_transforms("none")
    together = search.cv_models(table, "LR", {}, 0)
    for f in range(3):
        alone = fit_linear(table.train.where(F.col("fold") != f), table.features, "y", TargetTransform())
        np.testing.assert_allclose(together[f].coefficients, alone.coefficients, rtol=1e-9)


@pytest.mark.parametrize("kind", ["log", "yeo-johnson"])
def test_target_transforms_in_cross_validation(table, kind):
    table.fit_transforms(kind)
    out = search.cross_validate(table, "LR", {}, 1)
    assert len(out["r2_splits"]) == 3 and out["r2_mean"] > 0.9
    model = search.fit_model(table.train, table.features, "y", "LR", {}, table.transforms["all"])
    assert search.train_test_metrics(table, model)["test_r2"] > 0.9
    assert explain.shap_values(model, table.test, ["id"]).first()["target_scale"] == kind
    table.fit_transforms("none")


def test_linear_svr_reaches_the_primal_minimum(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(400)
    y = 2 * x + rng.laplace(size=400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    c, eps = 2.0, 0.3
    m = search.fit_model(df, ["x"], "y", "SVR", {"kernel": "linear", "C": c, "epsilon": eps, "tol": 1e-5}, key_cols=["id"])
    z = (x - m.center[0]) / m.scale[0]

    def objective(w, b):
        return 0.5 * w * w + c * np.clip(np.abs(y - w * z - b) - eps, 0, None).sum()

    w, b = m.weights[0], m.intercept
    around = [objective(w + dw, b + db) for dw in np.linspace(-0.2, 0.2, 81) for db in np.linspace(-0.2, 0.2, 81)]
    assert objective(w, b) <= min(around) * (1 + 1e-4)


def test_extra_trees_do_not_depend_on_partitions(spark, table):
    p = PARAMS["ET"]
    a = search.fit_model(table.train, table.features, "y", "ET", p, seed=3, key_cols=["id"])
    b = search.fit_model(table.train.repartition(7), table.features, "y", "ET", p, seed=3, key_cols=["id"])
    gap = b.predict(a.predict(table.test, "p"), "q").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap < 1e-9


def test_sampled_parameters_stay_in_their_domains(spark):
    assert domain_table(spark).count() == sum(map(len, SEARCH_SPACE.values()))
    for family, domains in SEARCH_SPACE.items():
        drawn = draw_params(spark, family, 40, seed=11)
        assert drawn == draw_params(spark, family, 40, seed=11)
        for d in domains:
            values = [p[d.name] for p in drawn if d.name in p]
            if d.kind == "choice":
                allowed = [list(c) if isinstance(c, tuple) else c for c in d.choices]
                assert all(v in allowed for v in values)
            else:
                assert all(d.low - 1e-12 <= v <= d.high + 1e-12 for v in values)
            if d.when:
                for p in drawn:
                    assert (d.name in p) == (p[d.when[0]] in d.when[1])
            elif family != "LR":
                assert len(values) == 40


def test_best_trial_direction_and_ties(spark):
    trials = spark.createDataFrame(
        [(0, 2.0, 0.1), (1, 1.0, 0.9), (2, 1.0, 0.9), (3, float("nan"), float("nan"))],
        "trial_id int, mse_mean double, r2_mean double",
    )
    assert search.best_trial(trials, "mse")["trial_id"] == 1
    assert search.best_trial(trials, "r2")["trial_id"] == 1
    with pytest.raises(ValueError):
        search.best_trial(trials, "rmse")


SMALL = {"RF": {"n_estimators": Domain("n_estimators", "int", 3, 5), "max_depth": Domain("max_depth", "int", 2, 4)}}


def config(**kw):
    return AnalysisConfig(
        PrepareConfig("y", key_cols=("id",)), n_iter=1, k=3, n_trials=2, overrides=SMALL, **kw
    )


def test_analysis_is_stored_repeatable_and_rebuilt(spark, tmp_path):
    df = synthetic(spark, 400)
    root = str(tmp_path)
    run = run_analysis(spark, df, config(models=("LR", "RF"), metrics=("mse", "r2"), n_features=2, save_models=True), root)
    rows = {r["model_id"]: r for r in run.results.collect()}
    assert set(rows) == {f"{m}_Exp1_{s}_1" for m in ("LR", "RF") for s in ("mse", "r2")}
    assert rows["LR_Exp1_mse_1"]["n_trials"] == 1 and rows["RF_Exp1_mse_1"]["n_trials"] == 2
    assert list(store.read_results(spark, root, 1).columns).count("exp") == 1
    # sums over rows do not depend on the layout (Spark's bagging does)
    again = run_analysis(spark, df.repartition(5), config(n_features=2), None, 1).results.first()
    for name in ("best_MSE", "train_MAE", "test_R2"):
        assert abs(again[name] / rows["LR_Exp1_mse_1"][name] - 1) < 1e-9
    context = rebuild_context(spark, root, 1, df)
    assert context.features == run.table.features
    ids = lambda t: {r["id"] for r in t.test.select("id").collect()}
    assert ids(context) == ids(run.table)
    model = store.load_model(spark, root, "RF_Exp1_r2_1")
    explain.export_diagnostics(
        explain.residuals(model, context.test, "y", ["id"]),
        explain.shap_values(model, context.test, ["id"]), root + "/diagnostics", {"a": "A: first"},
    )
    assert spark.read.parquet(root + "/diagnostics/scatters").select("item").distinct().count() == 2
    assert store.read_log(spark, root + "/logs/exp=1").where("line LIKE 'Elapsed Time%'").count() == 1


def test_targets_run_in_order(spark, tmp_path):
    df = synthetic(spark, 200)
    done = run_targets(spark, df, ["y", "a"], config(models=("LR",)), str(tmp_path))
    assert done == [1, 2]
    assert store.read_results(spark, str(tmp_path), 2).first()["target"] == "a"


def test_wrong_settings_fail_before_any_job(spark):
    df = synthetic(spark, 50)
    for kw in ({"models": ("KNN",)}, {"metrics": ("rmse",)}, {"target_transform": "sqrt"}, {"feature_scoring": "chi2"}):
        with pytest.raises(ValueError):
            run_analysis(spark, df, config(**kw))


def test_comparison_steps_and_ranks(spark):
    c = ModelComparison(
        synthetic(spark, 300), PrepareConfig("y", key_cols=("id",)), [5], 1, ("LR", "RF"),
        {"RF": {"n_estimators": 3, "max_depth": 2}}, SMALL, n_trials=1,
    )
    with pytest.raises(RuntimeError):
        c.select_models()
    c.create_experiments()
    with pytest.raises(RuntimeError):
        c.tune_models()
    c.select_models()
    c.tune_models()
    rows = c.rank_models("MAE").orderBy("stage", "rank").collect()
    assert [(r["stage"], r["model_name"]) for r in rows] == [
        ("selected", "LR"), ("selected", "RF"), ("tuned", "LR"), ("tuned", "RF")
    ]
    wide = c.performances()
    assert {"R2_train_mean", "RMSLE_val_std", "MAPE_val_mean"} <= set(wide.columns)


def test_bars_report_unknown_metrics(spark, table):
    table.fit_transforms("none")
    scored = search.score_folds(table, search.cv_models(table, "LR", {}, 0), with_train=True)
    long = metrics.cv_performance(scored.withColumn("model_name", F.lit("LR")))
    bars, unknown = metrics.cv_bar_table(long, ["R2", "XYZ"], "train")
    assert bars.count() == 1 and unknown == ["XYZ"]
    with pytest.raises(ValueError):
        metrics.cv_bar_table(long, ["R2"], "test")


def test_stored_settings_rebuild_the_same_table(spark, tmp_path):
    """Every setting of the preparation is kept with the experiment."""
    df = synthetic(spark, 300).withColumns({
        "code": F.when(F.col("id") % 9 > 0, F.col("id") % 4), "text": F.lit("x"),
        "gaps": F.when(F.col("id") % 4 > 0, F.col("a")),
    })
    prep = PrepareConfig(
        "y", key_cols=("id",), categorical_features=("code",), categorical_fill="mode", non_numeric="drop",
        sparse_threshold=0.3, dedupe="group", composite_parts=("a", "b"), drop_leaky=True,
    )
    run = run_analysis(
        spark, df.drop("y"), AnalysisConfig(prep, models=("LR",), n_iter=1, k=3), str(tmp_path))
    context = rebuild_context(spark, str(tmp_path), 1, df.drop("y"))
    assert context.features == run.table.features and "gaps" in context.features
    assert context.df.exceptAll(run.table.df).count() == 0 and context.df.count() == run.table.df.count()


def test_invariants_of_fits_without_a_closed_form(spark, table):
    """Hidden layers and deep trees fit better than a line and a stump, on rows not seen."""
    from regatta.workload.queries import STUMP

    table.fit_transforms("none")
    curve = table.df.withColumn("y", F.sin("a") * 8 + F.col("b") * F.when(F.col("flag"), 1).otherwise(-1))
    t = search.TrainingTable(curve, table.features, "y", ["id"], 3)
    t.fit_transforms("none")
    line, stump = (search.cross_validate(t, f, p, 1)["mse_mean"] for f, p in (("LR", {}), ("RF", STUMP)))
    deep = {
        "RF": {"n_estimators": 10, "max_depth": 8}, "XGB": {"n_estimators": 20, "max_depth": 4},
        "LGB": {"n_estimators": 30, "num_leaves": 12, "learning_rate": 0.3},
        "NN": {"hidden_layer_sizes": [32, 16], "batch_size": 16, "learning_rate_init": 0.01, "max_iter": 40},
    }
    for family, p in deep.items():
        assert search.cross_validate(t, family, p, 1)["mse_mean"] < 0.6 * min(line, stump), family
