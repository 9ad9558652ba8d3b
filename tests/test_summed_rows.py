"""Trees on rows of equal codes that are summed before the first pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.models import binned
from regatta.models.binned import BinnedTable, Draw
from regatta.models.together import FitTable, Job
from regatta.models.trees import fit_tree_models

CASES = [
    ("RF", {"n_estimators": 4, "max_depth": 4, "min_samples_split": 30}, None),
    ("RF", {"n_estimators": 3, "max_depth": 3}, 1),
    ("XGB", {"n_estimators": 12, "max_depth": 3, "subsample": 0.7, "lambda": 1.0}, 0),
    ("LGB", {"n_estimators": 6, "num_leaves": 7, "boosting_type": "dart"}, 2),
]


@pytest.fixture(scope="module")
def source(spark):
    """Rows of which many are alike, with fractional values, a constant label and one row that is alone."""
    k = F.col("id")
    df = spark.range(0, 6000, 1, 5).select(
        "id", (k % 7 / 3).alias("a"), (k * k % 11).cast("double").alias("b"), (k % 3).cast("int").alias("fold"),
        (k % 7 * 2 + F.when(k * k % 11 > 4, 5.0).otherwise(0.0) + k * 37 % 101 / 50).alias("y"))
    return FitTable.of(df, ["a", "b"], [F.col("y"), F.col("y") * 2], ["id"], "fold")


def test_rows_of_equal_codes_are_one_row(source):
    draws = [Draw(), Draw("poisson", 1, 3)]
    table = BinnedTable(source, 64, 1, draws, [0, 1, 2])
    found = np.frombuffer(b"".join(bytes(r["row"]) for r in table.rows.collect()), table.row)
    alike = source.rows.groupBy("f0", "f1", "fold").agg(F.count("*").alias("n"), F.sum("y0"), F.sum("y1"))
    assert len(found) == alike.count() < 6000 / 10
    assert found["n"][:, 0].sum() == 6000
    rows = source.rows.toPandas()
    assert np.allclose(found["y"][:, 0].sum(axis=0), rows[["y0", "y1"]].sum())
    assert found["n"][:, 1].sum() == draws[1].weights(rows["h"].to_numpy()).sum()


@pytest.mark.parametrize("family, params, fold", CASES)
def test_same_trees_as_from_all_rows(source, monkeypatch, family, params, fold):
    jobs = [Job(params, 5, label=1, fold=fold), Job({**params, "n_estimators": 2}, 6, label=0)]
    found = fit_tree_models(source, family, jobs)
    monkeypatch.setattr(binned, "SUMMED_BYTES", 0)
    for a, b in zip(found, fit_tree_models(source, family, jobs), strict=True):
        a, b = a.ensemble_.arrays(), b.ensemble_.arrays()
        for name in a:
            assert np.allclose(a[name], b[name]), name


def test_table_of_all_rows_if_sums_are_many(source, monkeypatch):
    monkeypatch.setattr(binned, "SUMMED_BYTES", 8 * 7 * 6 * 4 * 2)  # sums of both labels and the copies take more
    table = BinnedTable(source, 64, 1, [Draw()], [0, 1, 2])
    assert table.draws is None and table.rows.count() == 6000


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id bigint, a double, fold int, y double")
    table = BinnedTable(FitTable.of(empty, ["a"], [F.col("y")], ["id"], "fold"), 64, 1, [Draw()], [0])
    assert table.rows.count() == 0
