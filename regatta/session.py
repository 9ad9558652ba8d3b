"""Session helper and the shared folder used to cut lineage."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_session(app: str = "regatta", cores: str | int = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cpus = 8 if cores == "*" else int(cores)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``).

    A local session without one gets a folder of its own; a cluster without one is
    an error, since a machine-local folder would not survive the loss of a node.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="regatta-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A written Parquet table cuts lineage like ``checkpoint()`` does, survives executor
    loss, and later readers still get column pruning and filter pushdown.
    """
    return read_table_at(df.sparkSession, write_table(df), df.schema)


def write_table(df: DataFrame) -> str:
    """Write ``df`` to a new table of the shared folder; its path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_table_at(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``write_table`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """A table that fewer tasks read than there are cores, dealt evenly and written once.

    For inputs without shuffles that several passes read; larger ones stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return materialize(df.repartition(cores)) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per session."""
    context = spark.sparkContext
    if getattr(context, "_regatta_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="regatta-package-")) / "regatta.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(here.rglob("*.py")):
            archive.write(source, source.relative_to(here.parent))
    context.addPyFile(str(target))
    context._regatta_shipped = True
