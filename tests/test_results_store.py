import json
import pathlib

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from regatta.functions import formatting, params
from regatta.operators import ranking, results
from regatta.plans import search
from regatta.sources import store, tables

SCHEMA = (
    "model_id string, model_name string, target string, test_R2 double, test_MSE double, "
    "optimization_time double, best_params string"
)
ROWS = [
    ("LR_Exp1_mse_1", "LR", "a", 0.5, 4.0, 3723.9, '{"x": 1}'),
    ("LGB_Exp1_mse_1", "LGB", "a", 0.9, 1.0, None, "{'depth': 3, 'boot': True, 'size': (32, 16)}"),
    ("RF_Exp1_mse_1", "RF", "b", float("nan"), 2.0, 1.2, "junk"),
    ("RF_Exp1_mse_2", "RF", None, 0.9, None, 63.0, None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_rank_puts_missing_last_and_breaks_ties_by_id(table):
    best, ranked = ranking.rank_results(table, "test_R2", True)
    assert best["model_id"] == "LGB_Exp1_mse_1"
    order = [r["model_id"] for r in ranked.orderBy("rank").collect()]
    assert order == ["LGB_Exp1_mse_1", "RF_Exp1_mse_2", "LR_Exp1_mse_1", "RF_Exp1_mse_1"]
    assert ranked.columns[0] == "rank"
    assert ranking.rank_results(table, "absent", True)[0] is None


@pytest.mark.parametrize("higher", [True, False])
def test_range_ranks_equal_window_ranks_with_heavy_ties(spark, higher):
    df = spark.range(5000).select(
        F.concat(F.lit("m"), "id").alias("model_id"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.col("id") * 31, F.lit(997)) * 1.0).alias("m"),
    )
    _, a = ranking.rank_results(df, "m", higher)
    order = F.desc_nulls_last("m") if higher else F.asc_nulls_last("m")
    rank = F.row_number().over(Window.orderBy(order, "model_id")).cast("bigint").alias("rank")
    assert a.exceptAll(df.select(rank, "*")).count() == 0


def test_ranks_of_equal_rows_do_not_depend_on_layout(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("m"), (F.col("id") * 7).alias("other"))
    a, b = (ranking.rank_results(df.repartition(n), "m", True)[1] for n in (1, 7))
    assert a.exceptAll(b).count() == 0 and a.count() == 300


def test_models_under_a_root_of_that_name(spark, tmp_path):
    root = f"{tmp_path}/models/run1"
    df = spark.range(20).select("id", (F.col("id") * 2.0).alias("y"))
    for name in ("LR_a", "RF_b"):
        model = search.fit_model(df, ["id"], "y", name[:2], {"n_estimators": 1} if name[0] == "R" else {})
        store.save_model(spark, model, root, name)
    found = [tuple(r) for r in store.list_models(spark, root).collect()]
    assert found == [("LR_a", "LR"), ("RF_b", "RF")]


def test_csv_dialect(spark, tmp_path):
    rows = [(1, 'say "hi", ok', 1.5), (2, "two\nlines", None), (3, "N/A", 2.0), (4, "a\\b", 3.0)]
    df = spark.createDataFrame(rows, "k long, t string, v double")
    store.export_view(df, f"{tmp_path}/out.csv")
    plain = pd.concat(pd.read_csv(p) for p in pathlib.Path(f"{tmp_path}/out.csv").glob("part-*"))
    back = tables.read_table(spark, f"{tmp_path}/out.csv").orderBy("k")
    assert dict(back.dtypes) == {"k": "bigint", "t": "string", "v": "double"}
    assert [r.t for r in back.collect()] == ['say "hi", ok', "two\nlines", None, "a\\b"]
    assert plain.sort_values("k")["t"].fillna("-").tolist() == ['say "hi", ok', "two\nlines", "-", "a\\b"]
    (tmp_path / "na.csv").write_text("a,b\n1,x\nNA,N/A\nnan,\n2.5,null\n")
    read = tables.read_table(spark, f"{tmp_path}/na.csv")
    assert [tuple(r) for r in read.collect()] == [(1.0, "x"), (None, None), (None, None), (2.5, None)]


def test_kpis_skip_missing(table):
    row = results.kpis(table, "test_R2", True).first()
    assert row["n_models"] == 4 and abs(row["metric_mean"] - 2.3 / 3) < 1e-12
    assert row["metric_best"] == 0.9 and row["total_time_hms"] == "1:03:08"


def test_name_filter_is_a_case_insensitive_pattern(table):
    assert {r["model_name"] for r in results.filter_name(table, "^l").collect()} == {"LGB", "LR"}
    assert results.filter_target(table, "a").count() == 2


def test_results_view(table):
    view = results.results_view(table, "test_MSE", False, show_params=True)
    rows = view.collect()
    assert [r["optimization_time"] for r in rows] == ["—", "0:00:01", "1:02:03", "0:01:03"]
    assert view.columns == ["model_id", "model_name", "target", "test_R2", "test_MSE", "optimization_time", "best_params"]


def test_split_table_shows_dashes(table):
    rows = {r["split"]: r for r in results.split_table(results.best_row(table, "test_MSE", False)).collect()}
    assert rows["Test"]["mse"] == "1.0000" and rows["Train"]["mse"] == "—"


def test_log_tail_comes_before_the_filter(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Error a", "ok", "error B", "fine"])], "line_no int, line string")
    assert [r["line"] for r in results.filter_log(df, "error", tail=2).collect()] == ["error B"]
    assert results.filter_log(df, "Error", tail=0, case_sensitive=True).count() == 1
    assert results.filter_log(df, "", tail=0).count() == 4


@pytest.mark.parametrize(
    "seconds,text", [(3723.5, "1h 2m 3.50s"), (63.0, "1m 3.00s"), (1.2, "1.20s")]
)
def test_elapsed(spark, seconds, text):
    assert spark.range(1).select(formatting.elapsed(F.lit(seconds))).first()[0] == text


@pytest.mark.parametrize(
    "value,text",
    [("3723.9", "1:02:03"), ("x", "—"), (None, "—"), ("NaN", "—"), ("-5", "-1:59:55"), ("90000", "25:00:00")],
)
def test_hms(spark, value, text):
    assert spark.range(1).select(formatting.hms(F.lit(value).cast("string"))).first()[0] == text


def test_number_and_safe_name(spark):
    row = spark.range(1).select(
        formatting.number(F.lit(1234.5)).alias("a"), formatting.number(F.lit(float("nan"))).alias("b"),
        formatting.safe_name(F.lit(" Zeit: Größe/1 (x).y ")).alias("c"),
    ).first()
    assert tuple(row) == ("1,234.5000", "—", "Zeit__Größe_1__x_.y")


def test_lenient_params(table):
    out = {r["model_id"]: r["m"] for r in table.select("model_id", params.parse(F.col("best_params")).alias("m")).collect()}
    assert out["LR_Exp1_mse_1"] == {"x": "1"}
    assert out["LGB_Exp1_mse_1"] == {"depth": "3", "boot": "true", "size": "[32,16]"}
    assert out["RF_Exp1_mse_1"] == {"raw": "junk"} and out["RF_Exp1_mse_2"] == {}


def test_store_round_trip(spark, table, tmp_path):
    root = str(tmp_path / "store")
    assert store.list_experiments(spark, root) == [] and store.allocate_experiment(spark, root) == 1
    for exp in (2, 10, 1):
        store.write_results(table.withColumn("exp", F.lit(exp)).drop("test_R2"), root)
    assert store.list_experiments(spark, root) == ["Exp1", "Exp2", "Exp10"]
    assert store.allocate_experiment(spark, root) == 11
    one = store.read_results(spark, root, 2)
    assert one.count() == 4 and one.where("test_R2 IS NULL AND test_MAE IS NULL").count() == 4
    store.write_results_csv(one.withColumn("l", F.array(F.lit(1.5))), root + "/csv")
    assert spark.read.option("header", True).csv(root + "/csv").first()["l"] == "[1.5]"


def test_metadata_defaults(spark, tmp_path):
    root = str(tmp_path)
    store.write_metadata(spark, root, 4, {"target": "y", "kfold": 3})
    row = store.read_metadata(spark, root, 4).first()
    assert row["experiment_id"] == "experiment_4" and row["random_state"] == 42
    assert row["features_to_drop"] == [] and row["n_features"] == 0
    assert row["feature_scoring"] == "f_regression" and len(row["date"]) == 19


def test_log_lines_keep_file_order(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_bytes(b"\n".join(b"line %d" % i for i in range(5000)) + b"\n\xff\xfe bad bytes\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = store.read_log(spark, str(path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in rows[:5000]] == [f"line {i}" for i in range(5000)]
    assert [r["line_no"] for r in rows] == list(range(1, 5002))
    assert rows[5000]["line"] == " bad bytes"
    other = tmp_path / "marks.txt"
    other.write_bytes("a \N{REPLACEMENT CHARACTER} b".encode() + b"\xff c")
    assert store.read_log(spark, str(other)).first()["line"] == "a \N{REPLACEMENT CHARACTER} b c"


def test_experiment_numbers_are_claimed_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: store.allocate_experiment(spark, str(tmp_path)), range(12)))
    assert sorted(numbers) == list(range(1, 13))


def test_csv_types_and_catalog(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "id,day,time,at,x,n,on,s\n1,2024-01-01,20:07:01,2024-01-01T20:07:01,1.5,3,True,a\n"
        "2,2024-01-02,14:37:17,2024-01-02T14:37:17,,4,False,\n"
    )
    df = tables.read_table(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "day": "date", "time": "string", "at": "timestamp_ntz", "x": "double",
        "n": "bigint", "on": "boolean", "s": "string",
    }
    assert df.where("x IS NULL").count() == 1
    assert tables.read_by_key(spark, "1", {1: str(path)}).count() == 2
    with pytest.raises(ValueError):
        tables.read_by_key(spark, 3, {1: str(path)})
    assert tables.list_tables(spark, str(tmp_path)).count() == 1


def test_rename_map(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"z_1": "Z one", "a": "A"}, indent=2))
    assert tables.read_rename_map(spark, str(path)) == {"z_1": "Z one", "a": "A"}
