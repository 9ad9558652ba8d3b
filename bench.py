"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from regatta.models.linear import fit_linear  # noqa: E402
from regatta.operators import explain, metrics, scoring  # noqa: E402
from regatta.operators import split as sp  # noqa: E402
from regatta.operators.dedupe import drop_duplicate_rows  # noqa: E402
from regatta.operators.mutual_info import mutual_info_binned  # noqa: E402
from regatta.operators.neighbours import mutual_info_neighbours  # noqa: E402
from regatta.operators.prepare import PrepareConfig, prepare  # noqa: E402
from regatta.operators.transforms import TargetTransform, fit_yeo_johnson  # noqa: E402
from regatta.plans import search  # noqa: E402
from regatta.session import get_session, ship_package  # noqa: E402
from regatta.workload import queries as q  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", cpus)
    ship_package(spark)
    run(q.table(spark, sf, "lineitem").agg(F.sum("l_quantity")))  # start the JVM and workers

    def timed(name: str, fn) -> None:
        started = time.time()
        fn()
        times[name] = round(time.time() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    times: dict[str, float] = {}
    scored = q.scored_lineitem(spark, sf).drop("l_shipdate")
    config = PrepareConfig(
        "y", key_cols=tuple(q.LINE_KEYS), categorical_features=("l_returnflag", "l_linestatus")
    )
    timed("prepare", lambda: run(prepare(scored, config).df))
    rows = sp.assign_folds(
        scored.repartition(cpus).select(*q.ROW_KEYS, "l_quantity", "l_discount", "l_tax", "y"),
        q.ROW_KEYS, 5,
    ).persist()
    rows.count()
    table = search.TrainingTable(rows, ["l_quantity", "l_discount", "l_tax"], "y", q.ROW_KEYS, 5)
    table.fit_transforms("none")
    timed("f_regression", lambda: run(scoring.f_regression(rows, table.features, "y")))
    timed("mutual_info_binned", lambda: run(mutual_info_binned(rows, table.features, "y")))
    timed("yeo_johnson_folds", lambda: fit_yeo_johnson(table.train, "y", "fold"))
    timed("linear_cv_one_pass", lambda: search.cross_validate(table, "LR", {}, 0))

    def separate() -> None:
        for f in range(5):
            part = table.train
            m = fit_linear(part.where(F.col("fold") != f), table.features, "y", TargetTransform())
            run(metrics.regression_metrics(m.predict(part.where(F.col("fold") == f)), "y"))

    timed("linear_cv_five_fits", separate)
    forest = {"n_estimators": 20, "max_depth": 5}
    timed("forest_cv", lambda: search.cross_validate(table, "RF", forest, 1, 5))
    extra = {"n_estimators": 20, "max_depth": 5}
    timed("extra_trees_fit", lambda: search.fit_model(
        table.train, table.features, "y", "ET", extra, seed=1, key_cols=q.ROW_KEYS))
    timed("svr_linear_fit", lambda: search.fit_model(
        table.train, table.features, "y", "SVR", {"kernel": "linear"}, key_cols=q.ROW_KEYS))
    timed("mlp_fit", lambda: search.fit_model(
        table.train, table.features, "y", "NN",
        {"hidden_layer_sizes": [32, 16], "batch_size": 128, "max_iter": 5}, key_cols=q.ROW_KEYS))
    linear = search.fit_model(table.train, table.features, "y", "LR")
    timed("shap_linear", lambda: run(explain.shap_values(linear, rows, q.ROW_KEYS)))
    trees = search.fit_model(table.train, table.features, "y", "RF", forest, seed=1)
    timed("shap_tree", lambda: run(explain.shap_values(trees, table.test, q.ROW_KEYS)))
    boosted = {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3}
    timed("boosted_fit", lambda: search.fit_model(
        table.train, table.features, "y", "XGB", boosted, seed=1, key_cols=q.ROW_KEYS))
    timed("svr_rbf_fit", lambda: search.fit_model(
        table.train, table.features, "y", "SVR", {"kernel": "rbf", "gamma": 0.05}, key_cols=q.ROW_KEYS))
    timed("mutual_info_neighbours", lambda: run(mutual_info_neighbours(rows, ["l_quantity"], "y")))
    repeated = rows.select("l_quantity", "l_discount", "l_tax")
    timed("dedupe_repeated", lambda: run(drop_duplicate_rows(repeated)))
    rows.unpersist()
    for name in ("flagship", "rank_results", "family_box", "kfold_exact", "analysis_linear"):
        timed(name, lambda name=name: run(q.QUERIES[name](spark, sf)))
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
