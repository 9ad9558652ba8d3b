"""The operators as queries over the test tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions import formatting, params
from regatta.models.linear import fit_linear, fit_linear_folds
from regatta.operators import clean, dedupe, encode, explain, metrics, ranking, results, scoring
from regatta.operators import split as sp
from regatta.operators import stats, transforms
from regatta.operators.mutual_info import mutual_info_binned
from regatta.operators.neighbours import mutual_info_neighbours
from regatta.models.svr import SvrModel
from regatta.operators.prepare import PrepareConfig, prepare, split_xy, validate_inputs
from regatta.operators.quantiles import grouped_quantiles
from regatta.operators.transforms import TargetTransform
from regatta.plans import search
from regatta.plans.analysis import AnalysisConfig, rebuild_context, run_analysis
from regatta.plans.comparison import ModelComparison, model_performances, rank_performances
from regatta.plans.space import Domain, draw_params, sample_hidden_layers, sample_trials
from regatta.session import materialize, shared_folder
from regatta.sources import store, tables

QUERIES: dict = {}
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROW_KEYS = [*LINE_KEYS, "l_extendedprice"]  # unique at every scale


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one."""
    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def every(column: str, n: int, value, otherwise):
    """``value`` on the rows whose key is a multiple of n."""
    return F.when(F.col(column) % n == 0, value).otherwise(otherwise)


# -- preparation ---------------------------------------------------------------------


def damaged_lineitem(spark, sf):
    """lineitem with infinities, NaN and error text, as a spreadsheet leaves them."""
    price = F.when(F.col("l_partkey") % 7 == 0, F.lit(float("inf"))).when(
        F.col("l_partkey") % 23 == 0, F.lit(float("nan"))
    ).otherwise(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS, "l_quantity", "l_discount", "l_tax", price.alias("price"),
        every("l_suppkey", 13, F.lit("#NAME?"), F.col("l_returnflag")).alias("flag"),
        "l_linestatus",
    )


@query
def clean_sentinels(spark, sf):
    return clean.clean_sentinels(damaged_lineitem(spark, sf))


@query
def clean_recast_numeric(spark, sf):
    text = every("o_orderkey", 9, F.lit("#NAME?"), F.col("o_custkey").cast("string"))
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("custkey"))
    return clean.clean_sentinels(df, recast=("custkey",))


@query
def missing_profile(spark, sf):
    return clean.missing_profile(clean.clean_sentinels(damaged_lineitem(spark, sf)))


def orders_with_gaps(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
        every("o_orderkey", 5, F.lit(None), F.col("o_orderpriority")).alias("priority"),
        every("o_orderkey", 7, F.lit(None), F.col("o_totalprice")).alias("price"),
    )


@query
def drop_missing_target(spark, sf):
    return clean.drop_missing_target(orders_with_gaps(spark, sf), "price")


@query
def drop_columns(spark, sf):
    return clean.drop_columns(orders_with_gaps(spark, sf), ["o_orderdate", "o_custkey"])


def repeated_orders(spark, sf):
    bucket = F.floor(F.col("price") / 10000)
    return clean.drop_missing_target(orders_with_gaps(spark, sf), "price").select(
        "o_orderkey", "o_orderstatus", "priority", bucket.alias("bucket")
    )


@query
def drop_duplicate_rows(spark, sf):
    return dedupe.drop_duplicate_rows(repeated_orders(spark, sf), ["o_orderkey"])


@query
def drop_duplicate_rows_digest(spark, sf):
    return dedupe.drop_duplicate_rows(repeated_orders(spark, sf), ["o_orderkey"], "digest")


@query
def duplicate_count(spark, sf):
    return dedupe.duplicate_count(repeated_orders(spark, sf), ["o_orderstatus", "priority", "bucket"])


@query
def composite_target(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *ROW_KEYS, "l_quantity", "l_discount",
        every("l_partkey", 6, F.lit(None), F.col("l_tax")).alias("l_tax"),
    )
    out = clean.composite_target(df, "total", ["l_quantity", "l_discount", "l_tax"])
    return out.withColumn("total", F.round("total", 6))


@query
def row_sum_skipna(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *ROW_KEYS, "l_quantity", "l_discount",
        every("l_partkey", 6, F.lit(None), F.col("l_tax")).alias("l_tax"),
    )
    out = clean.composite_target(df, "total", ["l_quantity", "l_discount", "l_tax"], skipna=True)
    return out.withColumn("total", F.round("total", 6))


@query
def drop_leaky(spark, sf):
    leaks = {"p_retailprice": ["p_size", "p_type"]}
    return clean.drop_leaky(table(spark, sf, "part"), "p_retailprice", leaks)


def sparse_part(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_size", "p_retailprice",
        F.lit("fixed").alias("one_value"),
        every("p_partkey", 10, F.lit(None), F.lit(7)).alias("one_value_and_gaps"),
        F.when(F.col("p_partkey") % 10 < 2, None).otherwise(F.col("p_size")).alias("fifth_missing"),
        F.when(F.col("p_partkey") % 10 < 3, None).otherwise(F.col("p_size")).alias("third_missing"),
    )


@query
def column_stats(spark, sf):
    df = sparse_part(spark, sf)
    return stats.column_stats_table(df, df.columns).withColumn(
        "missing_fraction", F.round("missing_fraction", 6)
    )


@query
def prune_columns(spark, sf):
    return stats.prune_columns(sparse_part(spark, sf), exempt=("p_partkey",))


@query
def impute_median(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        every("l_partkey", 7, F.lit(None), F.col("l_extendedprice")).alias("price"),
        every("l_suppkey", 9, F.lit(None), F.col("l_quantity")).alias("quantity"),
    )
    out = encode.impute_median(df, ["price", "quantity"])
    return out.withColumns({"price": F.round("price", 6), "quantity": F.round("quantity", 6)})


@query
def impute_mode(spark, sf):
    df = orders_with_gaps(spark, sf).select("o_orderkey", "o_orderstatus", "priority")
    return encode.impute_mode(df, ["priority"])


@query
def one_hot(spark, sf):
    df = table(spark, sf, "lineitem").select(*ROW_KEYS, "l_returnflag", "l_linestatus")
    return encode.one_hot(df, ["l_returnflag", "l_linestatus"])


PREPARE = PrepareConfig(
    "l_quantity",
    key_cols=tuple(LINE_KEYS),
    features_to_drop=("l_tax",),
    categorical_features=("flag", "l_linestatus"),
)


@query
def prepare_full(spark, sf):
    df = damaged_lineitem(spark, sf).withColumns(
        {
            "one_value": F.lit(1),
            "mostly_gaps": F.when(F.col("l_orderkey") % 4 == 0, F.col("l_discount")),
            "l_quantity": every("l_orderkey", 17, F.lit(None), F.col("l_quantity")),
        }
    )
    out = prepare(df, PREPARE).df
    return out.withColumn("price", F.round("price", 6))


@query
def step_audit(spark, sf):
    config = PrepareConfig(
        "price", key_cols=("o_orderkey",), features_to_drop=("o_custkey", "o_orderdate"),
        categorical_features=("o_orderstatus", "priority"),
    )
    return prepare(orders_with_gaps(spark, sf), config).audit().select("position", "step", "n_rows", "n_cols")


@query
def split_features_target(spark, sf):
    x, y = split_xy(table(spark, sf, "part"), "p_retailprice", ["p_partkey"])
    return x.join(y, "p_partkey")


@query
def preview(spark, sf):
    return clean.preview(table(spark, sf, "customer"), ["c_custkey"])


@query
def rename_columns(spark, sf):
    return clean.rename_columns(
        table(spark, sf, "part"), {"p_brand": "Brand", "p_size": "Size", "absent": "Absent"}
    )


@query
def select_present(spark, sf):
    return clean.select_present(table(spark, sf, "part"), ["p_size", "absent", "p_partkey"])


# -- scores --------------------------------------------------------------------------


def scored_lineitem(spark, sf):
    """A target with known signal: quantity and discount matter, the rest does not."""
    noise = F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 17, F.lit(101)) / 10.0
    y = F.col("l_quantity") * 3 - F.col("l_discount") * 200 + noise
    return table(spark, sf, "lineitem").withColumn("y", y)


FEATURES = ["l_extendedprice", "l_quantity", "l_tax", "l_discount"]


@query
def f_regression(spark, sf):
    out = scoring.f_regression(scored_lineitem(spark, sf), FEATURES, "y")
    return out.withColumn("score", F.round("score", 4))


@query
def f_regression_encoded(spark, sf):
    df = encode.one_hot(
        table(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_tax"), ["l_returnflag"]
    ).withColumn("constant", F.lit(1.0))
    names = ["l_tax", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "constant"]
    out = scoring.f_regression(df, names, "l_quantity")
    return out.withColumn("score", F.round("score", 4))


@query
def select_top_k(spark, sf):
    best = scoring.top_k(scoring.f_regression(scored_lineitem(spark, sf), FEATURES, "y"), 2)
    return best.withColumn("score", F.round("score", 4))


@query
def project_features(spark, sf):
    df = scored_lineitem(spark, sf)
    names = scoring.select_features(df, FEATURES, "y", 2)
    return scoring.project_features(df, LINE_KEYS, "y", names).withColumn("y", F.round("y", 6))


@query
def mutual_info_bins(spark, sf):
    out = mutual_info_binned(scored_lineitem(spark, sf), FEATURES, "y")
    return out.withColumn("score", F.round("score", 6))


@query
def mutual_info_neighbour(spark, sf):
    """The nearest-neighbour estimator, without jitter since these values hardly tie."""
    df = table(spark, sf, "customer").select(
        "c_acctbal",
        (F.col("c_acctbal") / 100 + F.pmod(F.col("c_custkey") * 37, F.lit(101)) * 0.731).alias("signal"),
        (F.col("c_acctbal") * (1 + F.pmod(F.col("c_custkey"), F.lit(7)))).alias("mixed"),
    )
    out = mutual_info_neighbours(df, ["c_acctbal", "mixed"], "signal", jitter=0.0, cell_rows=400)
    return out.withColumn("score", F.round("score", 4))


@query
def mutual_info_neighbour_ties(spark, sf):
    """Few distinct values on both axes, told apart by the estimator's jitter."""
    return mutual_info_neighbours(
        scored_lineitem(spark, sf), ["l_quantity", "l_tax"], "y", cell_rows=20_000
    )


@query
def mutual_info_neighbour_keys(spark, sf):
    """Twenty distinct values against fifty, told apart by a jitter that the row's key gives."""
    df = table(spark, sf, "customer").select(
        "c_custkey", F.pmod(F.col("c_custkey") * 37, F.lit(20)).alias("step"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(20)) * 2 + F.pmod(F.col("c_custkey") * 11, F.lit(7))).alias("signal"),
    )
    out = mutual_info_neighbours(df, ["step"], "signal", cell_rows=300, key_cols=["c_custkey"])
    return out.withColumn("score", F.round("score", 3))


# -- splits --------------------------------------------------------------------------


@query
def train_test_split(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sp.train_test_split(df, ["o_orderkey"], seed=42)


@query
def split_counts(spark, sf):
    df = sp.train_test_split(table(spark, sf, "lineitem"), LINE_KEYS, seed=7)
    return df.groupBy("is_test").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query
def kfold(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return sp.assign_folds(df, ["o_orderkey"], k=5, seed=42)


@query
def kfold_exact(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return sp.assign_folds(df, ["o_orderkey"], k=7, seed=3, exact=True)


@query
def kfold_sizes(spark, sf):
    df = sp.assign_folds(table(spark, sf, "customer"), ["c_custkey"], k=7, seed=11, exact=True)
    return df.groupBy("is_test", "fold").agg(F.count("*").alias("n"))


@query
def repeat_seeds(spark, sf):
    return sp.draw_seeds(table(spark, sf, "customer"), "c_custkey", 10, seed=5)


@query
def repeat_experiments(spark, sf):
    trials = table(spark, sf, "part").select("p_partkey", "p_size")
    return sp.repeat_experiments(trials, [17, 4242, 9001])


# -- transforms ----------------------------------------------------------------------


@query
def robust_scale(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", "c_nationkey",
        F.when(F.col("c_custkey") % 10 == 0, 1.0).otherwise(0.0).alias("mostly_zero"),
    )
    names = ["c_acctbal", "c_nationkey", "mostly_zero"]
    out = transforms.robust_scale(df, names)
    return out.withColumns({n: F.round(n, 6) for n in names})


@query
def target_log(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    t = transforms.fit_target_transform(df, "o_totalprice", "log")["all"]
    forward = t.forward(F.col("o_totalprice"))
    return df.select(
        "o_orderkey", F.round(forward, 6).alias("log_price"),
        F.round(t.inverse(forward), 4).alias("price_back"),
    )


POWERS = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5]


@query
def yeo_johnson_grid(spark, sf):
    df = table(spark, sf, "customer").withColumn("y", F.col("c_acctbal") / 1000)
    out = transforms.yeo_johnson_table(df, "y", POWERS)
    return out.select(
        "power", "n", *[F.round(c, 5).alias(c) for c in ("mean", "variance", "loglik")]
    )


@query
def yeo_johnson_round_trip(spark, sf):
    df = table(spark, sf, "customer").withColumn("y", F.col("c_acctbal") / 1000)
    t = transforms.fit_yeo_johnson(df, "y")["all"]
    back = t.inverse(t.forward(F.col("y")))
    return df.select("c_custkey", F.round(back, 6).alias("y"))


# -- models --------------------------------------------------------------------------


@query
def linreg_fit(spark, sf):
    m = fit_linear(table(spark, sf, "part"), ["p_partkey"], "p_retailprice", TargetTransform())
    df = table(spark, sf, "part")
    predicted = m.predict(df)
    return predicted.select("p_partkey", F.round("prediction", 6).alias("prediction"))


@query
def model_store(spark, sf):
    """A fitted model saved, listed, loaded by its id and used."""
    df, root = table(spark, sf, "part"), scratch(spark)
    m = fit_linear(df, ["p_partkey"], "p_retailprice", TargetTransform())
    store.save_model(spark, m, root, "LR_Exp1_mse_1")
    name = store.list_models(spark, root).first()["model_id"]
    predicted = store.load_model(spark, root, name).predict(df)
    return predicted.select("p_partkey", F.round("prediction", 6).alias("prediction"))


@query
def linreg_two_features(spark, sf):
    df = scored_lineitem(spark, sf)
    m = fit_linear(df, ["l_quantity", "l_discount"], "y", TargetTransform())
    return m.predict(df).select(
        *LINE_KEYS, F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction")
    )


def order_folds(spark, sf):
    df = table(spark, sf, "orders").withColumn(
        "y", F.col("o_totalprice") / 1000 + F.pmod("o_custkey", F.lit(100))
    )
    split = sp.assign_folds(df, ["o_orderkey"], k=5, seed=42)
    return search.TrainingTable(split, ["o_totalprice"], "y", ["o_orderkey"], 5)


@query
def linreg_fold_models(spark, sf):
    t = order_folds(spark, sf)
    names = {f: TargetTransform() for f in [*range(5), "all"]}
    models = fit_linear_folds(t.train, t.features, t.target, names)
    score = None
    for f in range(5):
        score = (F if score is None else score).when(F.col("fold") == f, models[f].expression())
    return t.df.select(
        "o_orderkey", "fold", F.round(score.otherwise(models["all"].expression()), 5).alias("prediction")
    )


@query
def linreg_cv(spark, sf):
    t = order_folds(spark, sf)
    scored = search.score_folds(t, search.cv_models(t, "LR", {}, 0))
    out = metrics.fold_metrics(scored)
    return out.select(
        *[F.round(f"{m}_{p}", 6).alias(f"{m}_{p}") for m in metrics.METRICS for p in ("mean", "std")]
    )


@query
def fold_scores(spark, sf):
    t = order_folds(spark, sf)
    scored = search.score_folds(t, search.cv_models(t, "LR", {}, 0))
    out = metrics.regression_metrics(scored, by=["fold"])
    return out.select("fold", "n", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


def predicted_lineitem(spark, sf):
    """A closed-form prediction with an error that depends on the row."""
    p = F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.pmod("l_partkey", F.lit(50))
    return table(spark, sf, "lineitem").select(
        *ROW_KEYS, "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").alias("label"), p.alias("prediction"),
    )


@query
def regression_metrics(spark, sf):
    out = metrics.regression_metrics(predicted_lineitem(spark, sf), by=["l_returnflag", "l_linestatus"])
    return out.select(
        "l_returnflag", "l_linestatus", "n", *[F.round(m, 5).alias(m) for m in metrics.METRICS]
    )


@query
def extra_metrics(spark, sf):
    out = metrics.extra_metrics(predicted_lineitem(spark, sf), by=["l_returnflag"])
    names = {m: m.lower() for m in metrics.EXTRA_METRICS}
    return out.select("l_returnflag", *[F.round(m, 6).alias(n) for m, n in names.items()])


def performances(spark, sf):
    df = predicted_lineitem(spark, sf).withColumns(
        {
            "split": F.when(F.col("l_linestatus") == "F", "train").otherwise("val"),
            "fold": F.pmod("l_linenumber", F.lit(3)),
            "model_name": F.col("l_returnflag"),
        }
    )
    return metrics.cv_performance(df)


@query
def cv_performance(spark, sf):
    out = performances(spark, sf)
    return out.select(
        "model_name", "metric", "split", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")
    )


@query
def performance_wide(spark, sf):
    wide = metrics.performance_wide(performances(spark, sf), ["MAE", "R2"])
    return wide.select("model_name", *[F.round(c, 5).alias(c.lower()) for c in wide.columns[1:]])


@query
def cv_bar_table(spark, sf):
    bars, _ = metrics.cv_bar_table(performances(spark, sf), ["RMSE", "MAPE", "none"], "val")
    return bars.select(
        "model_name", "metric", "split", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")
    )


def simple_model(spark, sf):
    df = scored_lineitem(spark, sf)
    return df, fit_linear(df, ["l_quantity"], "y", TargetTransform())


@query
def residuals(spark, sf):
    df, m = simple_model(spark, sf)
    out = explain.residuals(m, df, "y", LINE_KEYS)
    return out.withColumns({n: F.round(n, 6) for n in ("label", "prediction", "residual")})


@query
def shap_linear(spark, sf):
    df, m = simple_model(spark, sf)
    out = explain.shap_values(m, df, LINE_KEYS)
    return out.select(
        *LINE_KEYS, "feature", "feature_value", F.round("shap_value", 6).alias("shap_value"),
        F.round("base_value", 6).alias("base_value"),
    )


@query
def shap_summary(spark, sf):
    df = scored_lineitem(spark, sf)
    m = fit_linear(df, ["l_quantity", "l_discount"], "y", TargetTransform())
    out = explain.shap_summary(explain.shap_values(m, df, LINE_KEYS))
    return out.withColumn("mean_abs_shap", F.round("mean_abs_shap", 6))


@query
def shap_scatter(spark, sf):
    df = scored_lineitem(spark, sf)
    m = fit_linear(df, ["l_quantity", "l_discount"], "y", TargetTransform())
    out = explain.shap_scatter(
        explain.shap_values(m, df, LINE_KEYS), "l_discount", {"l_discount": "Discount"}
    )
    return out.withColumn("shap_value", F.round("shap_value", 6))


@query
def diagnostics_store(spark, sf):
    """Residuals and Shapley points exported; the points of all features read back."""
    df, path = scored_lineitem(spark, sf), scratch(spark)
    m = fit_linear(df, ["l_quantity", "l_discount"], "y", TargetTransform())
    explain.export_diagnostics(
        explain.residuals(m, df, "y", LINE_KEYS), explain.shap_values(m, df, LINE_KEYS), path,
        {"l_discount": "Discount / %"},
    )
    points = spark.read.parquet(f"{path}/scatters")
    return points.select(
        "feature", "label", F.col("item").cast("string").alias("item"), "feature_value",
        F.round("shap_value", 6).alias("shap_value"),
    )


# -- results -------------------------------------------------------------------------


def stand_in_results(spark, sf):
    """orders as a results table: priority is the family, totalprice the metrics."""
    family = F.element_at(
        F.create_map(*[F.lit(v) for kv in {
            "1-URGENT": "RF", "2-HIGH": "LGB", "3-MEDIUM": "LR", "4-NOT SPECIFIED": "SVR", "5-LOW": "NN",
        }.items() for v in kv]),
        F.col("o_orderpriority"),
    )
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        formatting.model_id(family, F.lit(1), F.lit("mse"), F.col("o_orderkey")).alias("model_id"),
        family.alias("model_name"),
        F.col("o_orderkey").cast("int").alias("iteration"),
        F.col("o_orderstatus").alias("target"),
        F.lit("none").alias("target_transform"),
        F.pmod("o_custkey", F.lit(50)).cast("int").alias("n_trials"),
        every("o_orderkey", 11, F.lit(float("nan")), price / 500000).alias("test_R2"),
        price.alias("test_MSE"),
        every("o_orderkey", 13, F.lit(None), price / 10).alias("test_MAE"),
        (price / 2).alias("train_MSE"),
        (price / 3).alias("best_MSE"),
        every("o_orderkey", 17, F.lit(None), F.col("o_custkey") * 1.25).alias("optimization_time"),
        F.lit("mse").alias("score"),
        F.to_json(F.create_map(F.lit("alpha"), F.col("o_custkey"))).alias("best_params"),
    )


@query
def rank_results(spark, sf):
    _, ranked = ranking.rank_results(stand_in_results(spark, sf), "test_R2", True)
    return ranked.select("rank", "model_id", F.round("test_MSE", 4).alias("test_mse"))


@query
def rank_results_ranges(spark, sf):
    _, ranked = ranking.rank_results(stand_in_results(spark, sf), "test_MAE", False)
    return ranked.select("rank", "model_id", F.round("test_MSE", 4).alias("test_mse"))


@query
def best_row(spark, sf):
    best = results.best_row(stand_in_results(spark, sf), "test_MAE", False)
    return best.select("model_id", "model_name", "target", "n_trials", "test_MAE")


@query
def best_row_splits(spark, sf):
    return results.split_table(results.best_row(stand_in_results(spark, sf), "test_MSE", False))


@query
def best_row_params(spark, sf):
    return results.best_params(results.best_row(stand_in_results(spark, sf), "test_MSE", True))


@query
def kpis(spark, sf):
    out = results.kpis(stand_in_results(spark, sf), "test_R2", True)
    return out.select(
        "n_models", F.round("metric_mean", 8).alias("metric_mean"),
        F.round("metric_std", 8).alias("metric_std"), F.round("metric_best", 8).alias("metric_best"),
        F.round("total_time", 4).alias("total_time"), "total_time_hms",
    )


@query
def family_median(spark, sf):
    out = results.family_median(stand_in_results(spark, sf), "test_MSE", False)
    return out.withColumn("median", F.round("median", 6))


@query
def family_box(spark, sf):
    out = results.family_box(stand_in_results(spark, sf), "test_R2")
    names = ("low", "q1", "median", "q3", "high")
    return out.select("model_name", "n", *[F.round(n, 10).alias(n) for n in names])


@query
def family_points(spark, sf):
    return results.family_points(stand_in_results(spark, sf), "test_MSE")


@query
def quantiles_by_search(spark, sf):
    """Grouped quantiles with limits so low that every group takes the rank search."""
    out = grouped_quantiles(
        table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.1, 0.5, 0.99],
        exact_limit=100, finish_limit=50,
    )
    return out.select(
        "l_returnflag", "n", *[F.round(F.col("q").getItem(i), 6).alias(f"q{i}") for i in range(3)]
    )


@query
def results_view(spark, sf):
    view = results.results_view(
        stand_in_results(spark, sf), "test_MSE", False, name_filter="^l", target_filter="F",
        show_params=True,
    )
    return view.select(
        "model_id", "model_name", "iteration", "target", "n_trials", "optimization_time", "best_params"
    )


@query
def filter_name(spark, sf):
    return results.filter_name(table(spark, sf, "part"), "RING|^blue", "p_name").select("p_partkey", "p_name")


@query
def filter_target(spark, sf):
    return results.filter_target(table(spark, sf, "part"), "7", "p_size").select("p_partkey", "p_size")


@query
def rank_models(spark, sf):
    df = predicted_lineitem(spark, sf).withColumn("stage", F.col("l_linestatus"))
    per = metrics.extra_metrics(
        df.withColumn("experiment", F.pmod("l_linenumber", F.lit(3)).cast("string")),
        by=["experiment", "stage", "l_returnflag"],
    )
    wide = per.select("experiment", "stage", F.col("l_returnflag").alias("model_name"),
                      F.round("MAE", 6).alias("MAE_val_mean"))
    out = rank_performances(wide, "MAE")
    return out.withColumnRenamed("MAE_val_mean", "mae_val_mean")


@query
def append_results(spark, sf):
    df = table(spark, sf, "lineitem").select(*ROW_KEYS, "l_returnflag")
    first = df.where(F.col("l_linenumber") <= 3)
    second = df.where(F.col("l_linenumber") > 3).drop("l_returnflag")
    return store.append_results(first, second)


@query
def required_metrics(spark, sf):
    out = store.with_required_metrics(stand_in_results(spark, sf).drop("test_R2", "test_MAE"))
    return out.select("model_id", "test_R2", "test_MAE", "test_MSE")


# -- store and text ------------------------------------------------------------------


@query
def results_store(spark, sf):
    """Results written as a partitioned table, one experiment replaced, one read back."""
    root = scratch(spark)
    df = stand_in_results(spark, sf).withColumn("exp", F.pmod("iteration", F.lit(12)))
    store.write_results(df, root)
    store.write_results(df.where("exp = 3").withColumn("score", F.lit("again")), root)
    one = store.read_results(spark, root, 3)
    return one.select("model_id", "exp", "score", "n_trials", F.round("test_MSE", 4).alias("test_mse"))


@query
def list_experiments(spark, sf):
    root = scratch(spark)
    df = stand_in_results(spark, sf).withColumn("exp", F.pmod("iteration", F.lit(12)) + 1)
    store.write_results(df, root)
    following = store.allocate_experiment(spark, root)
    return store.sorted_experiments(store.read_results(spark, root)).withColumn(
        "following", F.lit(following)
    )


@query
def csv_round_trip(spark, sf):
    path = scratch(spark) + "/orders.csv"
    df = table(spark, sf, "orders").withColumn("time", F.lit("20:07:01"))
    df.write.option("header", True).csv(path)
    return tables.read_table(spark, path).drop("o_orderdate")


def awkward_text():
    """Quotes, commas, line breaks, backslashes and NA words, by row."""
    k = F.col("c_custkey") % 6
    return (
        F.when(k == 0, F.concat(F.lit('say "'), "c_name", F.lit('", ok')))
        .when(k == 1, F.concat("c_name", F.lit("\n"), "c_mktsegment"))
        .when(k == 2, F.lit("N/A")).when(k == 3, F.concat(F.lit("a\\"), "c_name"))
        .when(k == 4, F.lit(None)).otherwise(F.col("c_name"))
    )


@query
def csv_dialect(spark, sf):
    """Text that needs quoting, and missing values by word, through a CSV and back."""
    path = scratch(spark) + "/customers.csv"
    amount = every("c_custkey", 5, F.lit("NA"), F.col("c_acctbal").cast("string"))
    df = table(spark, sf, "customer").select(
        "c_custkey", awkward_text().alias("note"), amount.alias("amount")
    )
    store.write_results_csv(df, path)
    return tables.read_table(spark, path)


@query
def f_regression_nulls(spark, sf):
    """F scores over the rows where both the feature and the target are there."""
    df = scored_lineitem(spark, sf).select(
        every("l_partkey", 3, F.lit(None), F.col("l_quantity")).alias("gappy"),
        "l_tax", every("l_suppkey", 7, F.lit(None), F.col("y")).alias("y"),
    )
    out = scoring.f_regression(df, ["gappy", "l_tax"], "y")
    return out.withColumn("score", F.round("score", 4))


@query
def metric_best(spark, sf):
    """The best value of each metric of the dashboard, in its own direction."""
    rows, out = stand_in_results(spark, sf), None
    for key in sorted(ranking.METRIC_INFO):
        name, higher, label = ranking.metric_info(key)
        best = (F.max if higher else F.min)(ranking.without_nan(rows, name))
        part = rows.agg(F.round(best, 6).alias("best")).select(F.lit(label).alias("label"), "best")
        out = part if out is None else out.unionByName(part)
    return out


@query
def log_round_trip(spark, sf):
    """A run's log written and read with its line numbers: one line for each order status."""
    root = scratch(spark)
    counted = table(spark, sf, "orders").groupBy("o_orderstatus").count().orderBy("o_orderstatus")
    lines = [f"{r['o_orderstatus']}: {r['count']} orders" for r in counted.collect()]
    store.write_log(spark, root, 1, lines)
    return store.read_log(spark, f"{root}/logs/exp=1")


@query
def metadata_round_trip(spark, sf):
    """An experiment's record written and read, with defaults for what it leaves out."""
    root, n = scratch(spark), table(spark, sf, "orders").count()
    store.write_metadata(spark, root, 3, {"random_state": n, "target": "y", "test_size": 0.25})
    out = store.read_metadata(spark, root, 3)
    return out.select(
        "experiment_id", "random_state", "target", "n_features", "feature_scoring", "test_size", "exact_folds"
    )


@query
def listed_tables(spark, sf):
    """The files of a folder that Spark wrote, one part for each nation of the customers."""
    folder = scratch(spark)
    names = table(spark, sf, "customer").select("c_name", "c_nationkey")
    names.repartition("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    found = tables.list_tables(spark, f"{folder}/*")
    nation = F.regexp_extract("path", r"/c_nationkey=([0-9]+)/[^/]*$", 1).cast("int")
    return found.groupBy(nation.alias("nation")).agg(F.sum("length").alias("length"))


@query
def rebuilt_split(spark, sf):
    """The test rows of a stored analysis with a test size of its own, built again."""
    df = scored_lineitem(spark, sf).select(*LINE_KEYS, "l_quantity", "l_tax", "y")
    config = AnalysisConfig(
        PrepareConfig("y", key_cols=tuple(LINE_KEYS), features_to_drop=("l_tax",)),
        models=("LR",), metrics=("r2",), n_iter=1, k=3, test_size=0.3,
    )
    root = scratch(spark)
    run_analysis(spark, df, config, root)
    return rebuild_context(spark, root, 1, df).test.select(*LINE_KEYS)


@query
def export_view(spark, sf):
    path = scratch(spark) + "/view.csv"
    view = results.results_view(stand_in_results(spark, sf), "test_MSE", False, name_filter="^l")
    store.export_view(view, path)
    return tables.read_table(spark, path).select("model_id", "iteration", "target", "optimization_time")


@query
def read_by_key(spark, sf):
    catalog = {1: f"{sf}/orders.parquet", 2: f"{sf}/customer.parquet"}
    return tables.read_by_key(spark, "2", catalog)


@query
def rename_map(spark, sf):
    """A label map written as JSON, read back, and used as labels of every customer's nation."""
    path = scratch(spark)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))
    table(spark, sf, "nation").agg(F.to_json(pairs).alias("value")).write.text(path)
    labels = tables.read_rename_map(spark, path)
    labels.pop("0", None)  # keys without a label stay
    key = F.col("c_nationkey").cast("string")
    return table(spark, sf, "customer").select("c_custkey", explain.label_of(labels, key).alias("label"))


@query
def metadata_defaults(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey"),
        every("p_partkey", 2, F.lit(None), F.col("p_size")).cast("int").alias("random_state"),
        every("p_partkey", 3, F.lit(None), F.col("p_size")).cast("int").alias("n_features"),
        every("p_partkey", 5, F.lit(None), F.col("p_type")).alias("feature_scoring"),
        F.lit(None).cast("array<string>").alias("features_to_drop"),
        F.lit(None).cast("array<string>").alias("categorical_features"),
        F.lit(None).cast("array<string>").alias("key_cols"),
    )
    out = store.metadata_defaults(raw)
    return out.select(
        "p_partkey", "random_state", "n_features", "feature_scoring",
        F.size("features_to_drop").alias("n_dropped"),
    )


def log_lines(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )


@query
def log_read(spark, sf):
    """Lines written as text files in order and numbered when read back."""
    path = scratch(spark)
    ordered = log_lines(spark, sf).orderBy("conv_id", "turn", "pos")
    ordered.select(F.regexp_replace("line", r"[\r\n]", " ").alias("value")).write.text(path)
    return store.read_log(spark, path)


@query
def log_tail_filter(spark, sf):
    out = results.filter_log(
        log_lines(spark, sf), "AN", tail=500, order=["conv_id", "turn", "pos"]
    )
    return out.select("conv_id", "turn", "pos", "line")


@query
def log_tail_filter_case(spark, sf):
    out = results.filter_log(
        log_lines(spark, sf), "An", tail=0, case_sensitive=True, order=["conv_id", "turn", "pos"]
    )
    return out.select("conv_id", "turn", "pos", "line")


@query
def format_hms(spark, sf):
    seconds = every("o_orderkey", 9, F.lit("x"), (F.col("o_totalprice") / 7).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", formatting.hms(seconds).alias("hms"))


@query
def format_elapsed(spark, sf):
    seconds = F.round(F.col("o_totalprice") / 100).cast("double") + F.pmod("o_custkey", F.lit(4)) * 0.25
    scaled = F.when(F.col("o_orderkey") % 3 == 0, F.pmod(seconds, F.lit(200.0))).otherwise(seconds)
    return table(spark, sf, "orders").select("o_orderkey", formatting.elapsed(scaled).alias("elapsed"))


@query
def format_number(spark, sf):
    value = every("o_orderkey", 7, F.lit(None), F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", formatting.number(value).alias("text"))


@query
def model_ids(spark, sf):
    name = formatting.model_id(
        F.col("p_type"), F.col("p_size"), F.col("p_brand"), F.col("p_partkey")
    )
    return table(spark, sf, "part").select(
        "p_partkey", name.alias("model_id"), formatting.model_family(name).alias("family")
    )


@query
def safe_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", formatting.safe_name(F.col("text")).alias("name"))


@query
def params_parse(spark, sf):
    """JSON, Python literals, junk and nulls, all read as maps."""
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_id") % 5 == 0, None)
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("junk "), k))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("{'k': "), k, F.lit(", 'on': True}")))
        .otherwise(F.col("props"))
    )
    df = table(spark, sf, "events").select("event_id", params.parse(text).alias("m"))
    return df.select(
        "event_id", F.size("m").alias("n"), F.element_at("m", "k").alias("k"),
        F.element_at("m", "on").alias("flag"), F.element_at("m", "raw").alias("raw"),
    )


@query
def params_text(spark, sf):
    m = params.from_text(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", params.to_text(F.map_concat(m, F.create_map(F.lit("type"), F.col("event_type")))).alias("text")
    )


# -- trials --------------------------------------------------------------------------


@query
def trials_svr(spark, sf):
    out = sample_trials(table(spark, sf, "orders"), "o_orderkey", "SVR", seed=9)
    return out.select(
        "trial_id", F.round("C", 6).alias("c"), "kernel", "shrinking", "max_iter", "degree",
        F.round("gamma", 10).alias("gamma"),
    )


@query
def trials_xgb(spark, sf):
    out = sample_trials(table(spark, sf, "orders"), "o_orderkey", "XGB", seed=2)
    return out.select(
        "trial_id", "tree_method", "n_estimators", "max_depth", "subsample", "gamma",
        F.round("learning_rate", 8).alias("learning_rate"),
    )


@query
def hidden_layers(spark, sf):
    out = sample_hidden_layers(table(spark, sf, "customer"), "c_custkey", seed=4, max_layers=3)
    return out.select(
        "trial_id", "n_layers", F.try_element_at("hidden_layer_sizes", F.lit(1)).alias("first"),
        F.try_element_at("hidden_layer_sizes", F.lit(3)).alias("third"),
    )


@query
def best_trial(spark, sf):
    """Best trial by direction, ties to the lowest id, over orders as a trial table."""
    trials = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("trial_id"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("mse_mean"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("r2_mean"),
    )
    rows = [search.best_trial(trials, m).asDict() for m in ("mse", "r2")]
    return trials.where(F.col("trial_id").isin([r["trial_id"] for r in rows]))


# -- model families ------------------------------------------------------------------


def model_table(spark, sf, k: int = 3, keys=ROW_KEYS) -> search.TrainingTable:
    df = scored_lineitem(spark, sf).select(*ROW_KEYS, "l_quantity", "l_discount", "l_tax", "y")
    split = materialize(sp.assign_folds(df, keys, k=k, seed=42))
    return search.TrainingTable(split, ["l_quantity", "l_discount", "l_tax"], "y", ROW_KEYS, k)


def stump_table(spark, sf, k: int = 3) -> search.TrainingTable:
    """One feature of fifty values, so that every best split has a closed form."""
    df = scored_lineitem(spark, sf).select(*LINE_KEYS, "l_quantity", "y")
    return search.TrainingTable(
        materialize(sp.assign_folds(df, LINE_KEYS, k=k, seed=42)), ["l_quantity"], "y", LINE_KEYS, k
    )


def family_metrics(t: search.TrainingTable, family, params, seed=1):
    m = search.fit_model(t.train, t.features, t.target, family, params, seed=seed, key_cols=t.key_cols)
    out = metrics.regression_metrics(m.predict(t.df), t.target, "prediction", ["is_test"])
    rounded = [F.round(c, 6).alias(c) for c in ("mse", "mae", "r2")]
    return out.select("is_test", "n", *rounded, F.lit(family).alias("model_name"))


STUMP = {"n_estimators": 1, "max_depth": 1, "bootstrap": False}


@query
def rf_fit(spark, sf):
    """An unbagged stump, learned from the training rows."""
    return family_metrics(stump_table(spark, sf), "RF", STUMP)


@query
def xgb_fit(spark, sf):
    """Two boosting rounds on the training rows."""
    p = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.3}
    return family_metrics(stump_table(spark, sf), "XGB", p)


@query
def lgb_fit(spark, sf):
    """Three boosting rounds with the other family's parameter names."""
    p = {"n_estimators": 3, "max_depth": 1, "learning_rate": 0.2, "min_child_samples": 20, "max_bin": 128}
    return family_metrics(stump_table(spark, sf), "LGB", p)


@query
def et_fit(spark, sf):
    """Two binary features: full trees end in the training means of their groups."""
    t = stump_table(spark, sf)
    t.df = t.df.withColumns({"many": F.col("l_quantity") > 25, "odd": F.col("l_quantity") % 2 > 0})
    t = search.TrainingTable(t.df, ["many", "odd"], "y", LINE_KEYS, 3)
    return family_metrics(t, "ET", {"n_estimators": 3, "max_depth": 4, "bootstrap": False})


def predicted_values(spark, sf, target, family, params, x=None):
    """The fitted curve: one rounded prediction for each value of the feature."""
    x = F.col("l_quantity") if x is None else x
    df = table(spark, sf, "lineitem").select(*LINE_KEYS, x.cast("double").alias("x"))
    df = df.withColumn("y", target)
    m = search.fit_model(df, ["x"], "y", family, params, seed=1, key_cols=LINE_KEYS)
    return m.predict(df.select("x").distinct()).select("x", F.round("prediction", 1).alias("prediction"))


def fitted_metrics(spark, sf, family, params):
    t = model_table(spark, sf)
    m = search.fit_model(t.train, t.features, t.target, family, params, seed=1, key_cols=ROW_KEYS)
    out = metrics.regression_metrics(m.predict(t.df), "y", "prediction", ["is_test"])
    return out.withColumn("model_name", F.lit(family))


@query
def svr_fit(spark, sf):
    return fitted_metrics(spark, sf, "SVR", {"kernel": "linear", "C": 1.0, "epsilon": 0.1})


@query
def svr_rbf_fit(spark, sf):
    p = {"kernel": "rbf", "C": 10.0, "epsilon": 0.1, "gamma": 0.05}
    return fitted_metrics(spark, sf, "SVR", p)


@query
def mlp_fit(spark, sf):
    """Without hidden layers a network is a line, and finds the one the targets lie on."""
    p = {"hidden_layer_sizes": [], "batch_size": 64, "learning_rate_init": 0.01, "max_iter": 60, "alpha": 0.0}
    return predicted_values(spark, sf, 3 * F.col("x") + 7, "NN", p)


@query
def tree_shap(spark, sf):
    """A stump pays its whole step to the feature it splits on."""
    t = stump_table(spark, sf)
    m = search.fit_model(t.train, t.features, t.target, "RF", STUMP, seed=1)
    out = explain.shap_values(m, t.test, LINE_KEYS)
    return out.select(
        *LINE_KEYS, "feature", "feature_value", F.round("shap_value", 6).alias("shap_value"),
        F.round("base_value", 6).alias("base_value"), "target_scale",
    )


@query
def tree_shap_additivity(spark, sf):
    """Shapley values and base against the boosted prediction, per test row."""
    t = model_table(spark, sf, keys=LINE_KEYS)
    p = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.5}
    m = search.fit_model(t.train, t.features, t.target, "XGB", p, seed=1)
    kept = [*ROW_KEYS, "prediction"]
    parts = explain.additivity(explain.shap_values(m, m.predict(t.test), kept), kept)
    gap = F.round(F.abs(F.col("prediction") - F.col("explained")), 6)
    return parts.select(*ROW_KEYS, gap.alias("gap"))


@query
def forest_stump(spark, sf):
    """One unbagged tree of depth one: the best split of a column with 50 values."""
    df = scored_lineitem(spark, sf)
    p = {"n_estimators": 1, "max_depth": 1, "bootstrap": False}
    m = search.fit_model(df, ["l_quantity"], "y", "RF", p, seed=1)
    return m.predict(df).select(*LINE_KEYS, F.round("prediction", 6).alias("prediction"))


@query
def boosted_stumps(spark, sf):
    """Two boosting rounds of depth one at half the learning rate."""
    df = scored_lineitem(spark, sf)
    p = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.5, "min_child_weight": 1}
    m = search.fit_model(df, ["l_quantity"], "y", "XGB", p, seed=1)
    return m.predict(df).select(*LINE_KEYS, F.round("prediction", 6).alias("prediction"))


@query
def boosted_three(spark, sf):
    """Three rounds of the other boosted family."""
    df = scored_lineitem(spark, sf)
    p = {"n_estimators": 3, "max_depth": 1, "learning_rate": 0.25, "min_child_samples": 1}
    m = search.fit_model(df, ["l_quantity"], "y", "LGB", p, seed=1)
    return m.predict(df).select(*LINE_KEYS, F.round("prediction", 6).alias("prediction"))


@query
def extra_trees_groups(spark, sf):
    """Binary features: whatever the cuts, full trees end in the group means."""
    df = scored_lineitem(spark, sf).withColumns(
        {
            "many": F.col("l_quantity") > 25, "cheap": F.col("l_extendedprice") < 40000,
            "taxed": F.col("l_tax") > 0.03,
        }
    )
    p = {"n_estimators": 3, "max_depth": 5, "bootstrap": False}
    m = search.fit_model(df, ["many", "cheap", "taxed"], "y", "ET", p, seed=1)
    return m.predict(df).select(*LINE_KEYS, F.round("prediction", 6).alias("prediction"))


@query
def analysis_linear(spark, sf):
    """A whole stored analysis with one feature, checked to the last metric."""
    df = scored_lineitem(spark, sf).select(*LINE_KEYS, "l_quantity", "l_tax", "y")
    config = AnalysisConfig(
        PrepareConfig("y", key_cols=tuple(LINE_KEYS), features_to_drop=("l_tax",)),
        models=("LR",), metrics=("r2",), n_iter=1, k=5,
    )
    root = scratch(spark)
    run_analysis(spark, df, config, root)
    out = store.read_results(spark, root, 1)
    names = [f"{p}_{m}" for p in ("best", "train", "test") for m in ("MSE", "MAE", "R2")]
    return out.select(
        "model_id", "n_trials", *[F.round(n, 6).alias(n) for n in [*names, "best_R2_STD"]]
    )


@query
def cross_validate_forest(spark, sf):
    t = stump_table(spark, sf)
    out = metrics.fold_metrics(search.score_folds(t, search.cv_models(t, "RF", STUMP, 1, 3)))
    return out.select(*[
        F.round(f"{m}_{p}", 6).alias(f"{m}_{p}") for m in ("mse", "mae", "r2") for p in ("mean", "std")
    ])


@query
def compare_models(spark, sf):
    """A line and a stump over the same folds, on the rows they learned from and on the others."""
    t = stump_table(spark, sf)
    candidates = {"LR": ("LR", {}), "RF": ("RF", STUMP)}
    out = model_performances(t, candidates, 1, 3)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def quick_analysis() -> AnalysisConfig:
    small = {
        "n_estimators": Domain("n_estimators", "int", 5, 10, 5),
        "max_depth": Domain("max_depth", "int", 3, 6),
    }
    return AnalysisConfig(
        PrepareConfig(
            "y", key_cols=tuple(LINE_KEYS), features_to_drop=("l_shipdate",),
            categorical_features=("l_returnflag", "l_linestatus"),
        ),
        models=("LR", "RF"), metrics=("r2",), n_iter=1, k=3, n_trials=2, n_features=4,
        overrides={"RF": small},
    )


@query
def analysis_run(spark, sf):
    run = run_analysis(spark, scored_lineitem(spark, sf), quick_analysis(), scratch(spark))
    return run.results.drop("optimization_time", "run_ts")


@query
def class_comparison(spark, sf):
    config = quick_analysis()
    df = scored_lineitem(spark, sf).drop("l_shipdate")
    prep = PrepareConfig(
        "y", key_cols=tuple(LINE_KEYS), categorical_features=("l_returnflag", "l_linestatus")
    )
    c = ModelComparison(
        df, prep, [123], 1, ("LR", "RF"), {"RF": {"n_estimators": 5, "max_depth": 4}},
        config.overrides, n_trials=1,
    )
    c.create_experiments()
    c.select_models()
    c.tune_models()
    return c.rank_models("R2")


@query
def flagship(spark, sf):
    """Prepare, score, keep the best two features, split, least squares, test metrics."""
    df = scored_lineitem(spark, sf).drop("l_shipdate")
    config = PrepareConfig(
        "y", key_cols=tuple(LINE_KEYS), categorical_features=("l_returnflag", "l_linestatus")
    )
    prepared = prepare(df, config)
    names = scoring.select_features(prepared.df, prepared.features, "y", 2)
    rows = scoring.project_features(prepared.df, LINE_KEYS, "y", names)
    split = materialize(sp.train_test_split(rows, LINE_KEYS, seed=42))  # four columns, read thrice
    model = fit_linear(split.where(~F.col("is_test")), names, "y", TargetTransform())
    out = metrics.regression_metrics(model.predict(split), "y", "prediction", ["is_test"])
    return out.select("is_test", "n", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


# -- fits without a closed form: held by invariants in tests -------------------------


@query
def bagged_forest(spark, sf):
    """Ten bagged trees of depth six that split nodes of forty rows or more."""
    return fitted_metrics(spark, sf, "RF", {"n_estimators": 10, "max_depth": 6, "min_samples_split": 40})


@query
def deep_boost(spark, sf):
    """Ten rounds of depth four with penalties, on drawn rows and columns."""
    p = {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3, "colsample_bytree": 0.8, "subsample": 0.8,
         "lambda": 1.0, "alpha": 0.5, "gamma": 0.2}
    return fitted_metrics(spark, sf, "XGB", p)


@query
def leafwise_boost(spark, sf):
    """Ten rounds of fifteen leaves opened best first, with dropped trees."""
    p = {"n_estimators": 10, "num_leaves": 15, "learning_rate": 0.3, "max_bin": 128, "boosting_type": "dart",
         "reg_lambda": 1.0, "min_split_gain": 0.1}
    return fitted_metrics(spark, sf, "LGB", p)


@query
def bagged_extra_trees(spark, sf):
    p = {"n_estimators": 10, "max_depth": 8, "min_samples_leaf": 2, "bootstrap": True}
    return fitted_metrics(spark, sf, "ET", p)


@query
def hidden_layer_network(spark, sf):
    """Two hidden layers, stopped early."""
    p = {"hidden_layer_sizes": [32, 16], "batch_size": 64, "learning_rate_init": 0.005,
         "max_iter": 10, "early_stopping": True}
    return fitted_metrics(spark, sf, "NN", p)


@query
def forest_shap(spark, sf):
    """Shapley values of five trees of depth four, for every test row."""
    t = model_table(spark, sf)
    m = search.fit_model(t.train, t.features, t.target, "RF", {"n_estimators": 5, "max_depth": 4}, seed=1)
    return explain.shap_values(m, t.test, ROW_KEYS)


@query
def forest_folds(spark, sf):
    t = model_table(spark, sf)
    models = search.cv_models(t, "RF", {"n_estimators": 5, "max_depth": 5}, 1, 3)
    return metrics.fold_metrics(search.score_folds(t, models))


@query
def forest_comparison(spark, sf):
    t = model_table(spark, sf)
    candidates = {"LR": ("LR", {}), "RF": ("RF", {"n_estimators": 5, "max_depth": 5})}
    return model_performances(t, candidates, 1, 3)


@query
def searched_kernels(spark, sf):
    """Twelve drawn trials of the kernel machine over three folds, fitted together."""
    t = model_table(spark, sf)
    small = {"max_iter": Domain("max_iter", "int", 30, 60), "C": Domain("C", "float", 1e-3, 10.0, log=True)}
    drawn = [{**p, "landmarks": 32} for p in draw_params(spark, "SVR", 12, 5, small)]
    trials = search.run_trials(t, "SVR", drawn, 5)
    return trials.select("trial_id", "params", "mse_mean", "mae_mean", "r2_mean")


# -- penalties and missing values in closed form -------------------------------------


@query
def penalised_stumps(spark, sf):
    """Two rounds with both penalties on a leaf's value and a least gain."""
    p = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.5, "lambda": 40.0, "alpha": 100.0, "gamma": 1.0}
    return family_metrics(stump_table(spark, sf), "XGB", p)


@query
def penalised_leafwise(spark, sf):
    """The same penalties under the other family's names, two leaves a tree."""
    p = {"n_estimators": 3, "num_leaves": 2, "learning_rate": 0.2, "reg_lambda": 25.0, "reg_alpha": 60.0,
         "min_split_gain": 1.0}
    return family_metrics(stump_table(spark, sf), "LGB", p)


def flagged_lineitem(spark, sf) -> DataFrame:
    """Lines with a flag that every tenth order leaves open."""
    flag = every("l_orderkey", 10, F.lit(None).cast("boolean"), F.col("l_quantity") > 30)
    return scored_lineitem(spark, sf).select(*LINE_KEYS, flag.alias("large"), "l_extendedprice", "y")


@query
def null_booleans(spark, sf):
    """A prepared flag has no gaps: they are filled with its most frequent value."""
    config = PrepareConfig("y", key_cols=tuple(LINE_KEYS))
    out = prepare(flagged_lineitem(spark, sf), config).df
    return out.select(*LINE_KEYS, "large", "l_extendedprice", F.round("y", 6).alias("y"))


@query
def incomplete_rows_in_fits(spark, sf):
    """Line and stump over a flag with gaps learn the means of the complete rows."""
    df = flagged_lineitem(spark, sf)
    line = search.fit_model(df, ["large"], "y", "LR")
    tree = search.fit_model(df, ["large"], "y", "RF", STUMP, key_cols=LINE_KEYS)
    rows = tree.predict(line.predict(df.where("large is not null"), "line"), "tree")
    return rows.select(*LINE_KEYS, F.round("line", 5).alias("line"), F.round("tree", 5).alias("tree"))


@query
def mostly_repeated_rows(spark, sf):
    """Lines by quantity, discount and tax, of which nearly all repeat; the smallest key stays."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return dedupe.drop_duplicate_rows(df, ["l_orderkey"])


# -- refusals, as text for each case -------------------------------------------------


def refusals(df: DataFrame, cases: dict) -> DataFrame:
    """``case, refused`` with the rows that the refused work would have read."""
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, None))
        except ValueError as problem:
            out.append((name, str(problem)))
    said = df.sparkSession.createDataFrame(out, "case string, refused string")
    return said.join(df.agg(F.count("*").alias("n_rows")))


@query
def refused_inputs(spark, sf):
    """Wrong names and settings, each refused before any job."""
    df = table(spark, sf, "orders")
    wrong = {
        "target": PrepareConfig("nothing"),
        "categorical": PrepareConfig("o_totalprice", categorical_features=("nothing",)),
        "key": PrepareConfig("o_totalprice", key_cols=("nothing",)),
        "fill": PrepareConfig("o_totalprice", categorical_fill="mean"),
        "dropped target": PrepareConfig("o_totalprice", features_to_drop=("o_totalprice",)),
        "right": PrepareConfig("o_totalprice", key_cols=("o_orderkey",)),
    }
    return refusals(df, {k: (lambda c=c: validate_inputs(df, c)) for k, c in wrong.items()})


@query
def refused_models(spark, sf):
    """Unknown transforms, models and metrics, and models that have no Shapley values."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    kernel = SvrModel("SVR", ["o_custkey"], {})
    return refusals(df, {
        "transform": lambda: transforms.fit_target_transform(df, "o_totalprice", "sqrt"),
        "model": lambda: search.fit_model(df, ["o_custkey"], "o_totalprice", "KNN"),
        "metric": lambda: search.check_metric("rmse"),
        "explained": lambda: explain.shap_values(kernel, df, ["o_orderkey"]),
        "log": lambda: transforms.fit_target_transform(df.selectExpr("-o_totalprice AS y"), "y", "log"),
        "identity": lambda: transforms.fit_target_transform(df, "o_totalprice", "none"),
    })


@query
def stamped_dates(spark, sf):
    """The three date formats of records, at every order's date."""
    at = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", formatting.today(at).alias("day"), formatting.clock(at).alias("clock"),
        formatting.stamp(at).alias("stamp"))


@query
def logs_of_orders(spark, sf):
    """A log of one line for each order, written by Spark and read back as numbered lines."""
    path = scratch(spark)
    text = F.concat_ws(" ", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("bigint"))
    orders = table(spark, sf, "orders").select("o_orderkey", text.alias("value"))
    orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return store.read_log(spark, path)
