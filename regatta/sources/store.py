"""The experiment store: results, metadata, logs and models under one root folder."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regatta.functions import formatting, params
from regatta.models.base import TREE_FAMILIES, FittedModel, load_state
from regatta.models.ensemble import Ensemble
from regatta.models.extra import ExtraTreesModel
from regatta.models.linear import LinearModel
from regatta.models.mlp import MlpModel
from regatta.models.svr import SvrModel
from regatta.sources.tables import CSV_OPTIONS

_D, _A = "double", "array<double>"
RESULT_COLUMNS = {
    "model_id": "string", "model_name": "string", "iteration": "int", "target": "string",
    "target_transform": "string", "n_trials": "int", "score": "string",
    "best_MSE": _D, "best_MSE_STD": _D, "best_MSE_SPLITS": _A,
    "best_MAE": _D, "best_MAE_STD": _D, "best_MAE_SPLITS": _A,
    "best_R2": _D, "best_R2_STD": _D, "best_R2_SPLITS": _A,
    "train_MSE": _D, "train_MAE": _D, "train_R2": _D,
    "test_MSE": _D, "test_MAE": _D, "test_R2": _D,
    "optimization_time": _D, "best_params": "string",
    "ignored_params": "array<string>", "exp": "int", "seed": "bigint", "run_ts": "timestamp",
}
RESULT_SCHEMA = ", ".join(f"{n} {t}" for n, t in RESULT_COLUMNS.items())
REQUIRED_METRICS = ("test_MSE", "test_MAE", "test_R2", "optimization_time")

METADATA_SCHEMA = (
    "experiment_id string, date string, data_path string, random_state int, target string, "
    "target_transform string, features_to_drop array<string>, "
    "categorical_features array<string>, n_features int, kfold int, feature_scoring string, "
    "key_cols array<string>, test_size double, exact_folds boolean, drop_leaky boolean, "
    "composite_parts array<string>, sparse_threshold double, categorical_fill string, "
    "non_numeric string, dedupe string, exp int"
)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


# -- results -------------------------------------------------------------------------


def append_results(*tables: DataFrame) -> DataFrame:
    """Rows of several results tables as one, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def results_frame(spark: SparkSession, rows: list[dict], exp: int) -> DataFrame:
    """Results rows of one run with ids and experiment number, built in one step."""
    known = [n for n in RESULT_COLUMNS if n not in ("model_id", "exp", "run_ts")]
    schema = ", ".join(f"{n} {RESULT_COLUMNS[n]}" for n in known)
    frame = spark.createDataFrame([tuple(r.get(n) for n in known) for r in rows], schema)
    identifier = formatting.model_id(
        F.col("model_name"), F.lit(exp), F.col("score"), F.col("iteration")
    )
    return frame.withColumns(
        {"model_id": identifier, "exp": F.lit(exp), "run_ts": F.current_timestamp()}
    ).select(*RESULT_COLUMNS)


def write_results(results: DataFrame, root: str) -> None:
    """One partition per experiment; writing an experiment again replaces it."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("exp")
        .parquet(f"{root}/results")
    )


def write_results_csv(results: DataFrame, path: str) -> None:
    """CSV variant; lists become JSON text since CSV cannot hold them."""
    listed = {n: F.to_json(n) for n, t in results.dtypes if t.startswith(("array", "map"))}
    out = results.withColumns(listed) if listed else results
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_results(spark: SparkSession, root: str, exp: int | None = None) -> DataFrame:
    """Results of one experiment (a partition) or all; missing metric columns come as null."""
    df = spark.read.parquet(f"{root}/results")
    if exp is not None:
        df = df.where(F.col("exp") == exp)
    return with_required_metrics(df)


def with_required_metrics(df: DataFrame) -> DataFrame:
    absent = [c for c in REQUIRED_METRICS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df


def decode_params(results: DataFrame) -> DataFrame:
    """``best_params`` text as a map, lenient about how it was written."""
    return results.withColumn("best_params", params.parse(F.col("best_params")))


def list_experiments(spark: SparkSession, root: str) -> list[str]:
    """``Exp*`` names in numeric order; nothing there gives an empty list."""
    if not _exists(spark, f"{root}/results"):
        return []
    return [f"Exp{r['exp']}" for r in sorted_experiments(spark.read.parquet(f"{root}/results")).collect()]


def sorted_experiments(results: DataFrame) -> DataFrame:
    return results.select(F.col("exp").cast("int").alias("exp")).distinct().orderBy("exp")


def allocate_experiment(spark: SparkSession, root: str) -> int:
    """The next free experiment number, claimed by a file that only one run can create.

    Runs that start at the same time get different numbers; one that fails leaves its number
    unused.
    """
    number = 1
    if _exists(spark, f"{root}/results"):
        table = spark.read.parquet(f"{root}/results")
        number += table.agg(F.coalesce(F.max("exp"), F.lit(0))).first()[0]
    while not _claimed(spark, f"{root}/claims", f"exp={number}"):
        number += 1
    return number


def _claimed(spark: SparkSession, folder: str, name: str) -> bool:
    """Create a file, unless there is one already."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    if files.getScheme() == "file":  # whose create is not one step
        return jvm.java.io.File(path.toUri().getPath()).createNewFile()
    if files.exists(path):
        return False
    try:
        files.create(path, False).close()
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    return True


def export_view(view: DataFrame, path: str) -> None:
    """A filtered results view as one CSV file, with quotes doubled as other readers expect."""
    view.coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


# -- metadata ------------------------------------------------------------------------


def write_metadata(spark: SparkSession, root: str, exp: int, fields: dict) -> None:
    names = [f.split()[0] for f in METADATA_SCHEMA.split(", ")]
    row = {"experiment_id": f"experiment_{exp}", "exp": exp, **fields}
    frame = spark.createDataFrame([tuple(row.get(n) for n in names)], METADATA_SCHEMA)
    frame = frame.withColumn("date", formatting.stamp())
    frame.coalesce(1).write.mode("overwrite").json(f"{root}/metadata/exp={exp}")


def read_metadata(spark: SparkSession, root: str, exp: int) -> DataFrame:
    """One row; absent fields get their defaults."""
    raw = spark.read.schema(METADATA_SCHEMA.replace(", exp int", "")).json(
        f"{root}/metadata/exp={exp}"
    )
    return metadata_defaults(raw)


def metadata_defaults(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    split = {  # absent in older files
        "test_size": F.lit(0.2), "exact_folds": F.lit(False), "drop_leaky": F.lit(False),
        "sparse_threshold": F.lit(0.2), "categorical_fill": F.lit("median"),
        "non_numeric": F.lit("error"), "dedupe": F.lit("digest"), "composite_parts": empty,
    }
    raw = raw.withColumns({
        n: F.coalesce(n, v) if n in raw.columns else v for n, v in split.items()
    })
    return raw.withColumns(
        {
            "random_state": F.coalesce("random_state", F.lit(42)),
            "features_to_drop": F.coalesce("features_to_drop", empty),
            "categorical_features": F.coalesce("categorical_features", empty),
            "n_features": F.coalesce("n_features", F.lit(0)),
            "feature_scoring": F.coalesce("feature_scoring", F.lit("f_regression")),
            "key_cols": F.coalesce("key_cols", empty),
        }
    )


# -- logs ----------------------------------------------------------------------------


def write_log(spark: SparkSession, root: str, exp: int, lines: list[str]) -> None:
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    frame.coalesce(1).write.mode("overwrite").text(f"{root}/logs/exp={exp}")


def _without_bad_bytes(text: Column) -> Column:
    """Text without the bytes that are no UTF-8; marks that stand for such bytes elsewhere stay."""
    mark, kept = "\N{REPLACEMENT CHARACTER}", "\x00mark\x00"
    valid = F.make_valid_utf8(F.replace(text, F.lit(mark), F.lit(kept)))
    return F.replace(F.replace(valid, F.lit(mark), F.lit("")), F.lit(kept), F.lit(mark))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` in file order, bad bytes left out.

    A text file is read in blocks by many tasks. Lines are numbered within their block, and
    the blocks' line counts (one row per block) give the offsets.
    """
    lines = spark.read.text(path).select(
        _without_bad_bytes(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )
    within = Window.partitionBy("f", "b").orderBy("i")
    numbered = lines.withColumn("n", F.row_number().over(within))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy("f", "b").agg(F.max("n").alias("size"))
    offsets = blocks.select(
        "f", "b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    return numbered.join(offsets, ["f", "b"]).select(
        (F.col("start") + F.col("n")).alias("line_no"), "line"
    )


def write_trials(trials: DataFrame, root: str, model_id: str) -> None:
    """The trials of one search, under the id of the model that came of it."""
    trials.write.mode("overwrite").parquet(f"{root}/trials/model_id={model_id}")


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """All stored trials with their ``model_id``."""
    return spark.read.parquet(f"{root}/trials")


# -- models --------------------------------------------------------------------------


def save_model(spark: SparkSession, model: FittedModel, root: str, model_id: str) -> int:
    """Write a fitted model under its id; returns its size in bytes."""
    path = f"{root}/models/{model_id}"
    model.save(spark, f"{path}/state")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0]


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """``model_id, model_family`` of the saved models."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        f"{root}/models"
    )
    # a model's files lie in <id>/state; the root may hold any names
    deeper = F.regexp_replace("path", r"/state/[^/]*$", "")
    name = F.element_at(F.split(deeper, "/"), -1)
    return (
        files.select(name.alias("model_id"))
        .distinct()
        .withColumn("model_family", formatting.model_family(F.col("model_id")))
        .orderBy("model_id")
    )


def load_model(spark: SparkSession, root: str, model_id: str) -> FittedModel:
    """A saved model; its family is the text before the first underscore of its id."""
    path = f"{root}/models/{model_id}"
    family = model_id.split("_")[0]
    header, arrays = load_state(spark, f"{path}/state")
    common = (
        family, header["features"], header["params"], header["transform"],
        header["ignored_params"],
    )
    if family in TREE_FAMILIES:
        return ExtraTreesModel(*common, Ensemble.from_arrays(arrays))
    if family == "LR":
        return LinearModel(*common, float(arrays["intercept"]), arrays["coefficients"].tolist())
    kinds = {"SVR": SvrModel, "NN": MlpModel}
    if family not in kinds:
        raise ValueError(f"unknown model: {family}")
    model = kinds[family](*common)
    for name, value in arrays.items():
        setattr(model, name, float(value) if value.ndim == 0 else value)
    return model
