import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.operators.quantiles import exact_quantiles, grouped_quantiles, values_at_ranks

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def column(kind: str, n: int = 4001) -> np.ndarray:
    rng = np.random.default_rng(3)
    if kind == "normal":
        return rng.standard_normal(n)
    if kind == "heavy":
        return np.exp(rng.standard_normal(n) * 20)
    if kind == "ties":
        return np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 40, n).astype(float))
    return np.where(rng.random(n) < 0.5, 1e300, -1e-300)


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "two"])
def test_rank_search_equals_the_sorted_column(spark, kind):
    v = column(kind)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 7, "v double").repartition(5)
    want = np.quantile(v, LEVELS)
    for limits in ({}, {"exact_limit": 1, "finish_limit": 37}):
        got = exact_quantiles(df, {"v": F.col("v")}, LEVELS, **limits)["v"]
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_ranks_of_large_integers_stay_exact(spark):
    df = spark.range(0, 3000).select((F.col("id") * 3 + (1 << 61)).alias("v"))
    ranks = [0, 1, 1499, 2999]
    got = values_at_ranks(df, [(F.col("v"), 3000, r) for r in ranks], finish_limit=11)
    assert got == [(1 << 61) + 3 * r for r in ranks]


def test_empty_column_has_no_quantiles(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.5])["v"] is None


def test_hot_group_takes_the_search(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.sqrt("id").alias("v"),
    )
    plain = {r["g"]: (r["n"], r["q"]) for r in grouped_quantiles(df, "g", "v", [0.5]).collect()}
    split = {
        r["g"]: (r["n"], r["q"])
        for r in grouped_quantiles(df, "g", "v", [0.5], exact_limit=200, finish_limit=20).collect()
    }
    assert plain == split and len(plain) == 51


def test_many_columns_and_levels_in_few_jobs(spark):
    """Twelve columns at three levels, over several rounds of narrowing."""
    rng = np.random.default_rng(8)
    values = {f"c{k}": np.round(rng.standard_normal(6000) * 10 ** (k % 5), k % 3) for k in range(12)}
    columns = ", ".join(f"{n} double" for n in values)
    df = spark.createDataFrame(list(map(tuple, np.column_stack(list(values.values())).tolist())), columns)
    df = df.repartition(3).persist()
    df.count()
    context = spark.sparkContext
    context.setJobGroup("quantiles", "quantiles")
    got = exact_quantiles(df, {n: F.col(n) for n in values}, [0.25, 0.5, 0.9], exact_limit=1, finish_limit=40)
    jobs = len(context.statusTracker().getJobIdsForGroup("quantiles"))
    context.setJobGroup("", "")
    for n, v in values.items():
        np.testing.assert_allclose(got[n], np.quantile(v, [0.25, 0.5, 0.9]), rtol=1e-12)
    assert jobs <= 10, jobs
    df.unpersist()


@pytest.mark.parametrize("summary", [8, 64])
def test_coarse_sketches_change_nothing(spark, monkeypatch, summary):
    from regatta.operators import quantiles

    v = np.concatenate([column("heavy"), column("ties"), np.full(900, -7.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    ranks = [0, 17, len(v) // 2, len(v) - 1]
    rows, series = df.select("v"), quantiles._columns(1)
    got = quantiles._search(rows, series, [(0, len(v), r) for r in ranks], 5, summary)
    assert got == np.sort(v)[ranks].tolist()
