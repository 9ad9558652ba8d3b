import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.operators import metrics, scoring, transforms
from regatta.operators import neighbours
from regatta.operators.mutual_info import mutual_info_binned
from regatta.operators.neighbours import closer_rank, k_nearest, mutual_info_neighbours


def test_robust_scale_divides_by_one_on_zero_range(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0), (10.0, 1.0)], "a double, b double")
    out = transforms.robust_scale(df, ["a", "b"]).orderBy("a").collect()
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert transforms.robust_fit(df, ["a"])["a"] == (3.0, 4.0 - 2.0)


def test_log_target_needs_values_above_minus_one(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,)], "y double")
    with pytest.raises(ValueError, match="above -1"):
        transforms.fit_target_transform(df, "y", "log")
    with pytest.raises(ValueError, match="unknown target"):
        transforms.fit_target_transform(df, "y", "sqrt")


@pytest.mark.parametrize("power", [-1.0, 0.0, 0.7, 1.0, 2.0, 3.1])
def test_yeo_johnson_inverse(spark, power):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-4, 6, 41)], "y double")
    back = transforms.yeo_johnson_inverse(transforms.yeo_johnson(F.col("y"), power), power)
    assert df.agg(F.max(F.abs(back - F.col("y")))).first()[0] < 1e-9


def log_likelihood(y, p):
    up = np.log1p(np.abs(y)) if p == 0 else ((np.abs(y) + 1) ** p - 1) / p
    q = 2 - p
    down = -np.log1p(np.abs(y)) if q == 0 else -((np.abs(y) + 1) ** q - 1) / q
    t = np.where(y >= 0, up, down)
    return -len(y) / 2 * np.log(t.var()) + (p - 1) * (np.sign(y) * np.log1p(np.abs(y))).sum()


def test_yeo_johnson_power_is_the_maximum_per_fold_complement(spark):
    rng = np.random.default_rng(0)
    y = np.exp(rng.standard_normal(600)) - 0.5
    fold = np.arange(600) % 3
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(y, fold)], "y double, fold int")
    found = transforms.fit_target_transform(df, "y", "yeo-johnson", "fold")
    assert set(found) == {0, 1, 2, "all"}
    for name, t in found.items():
        used = y if name == "all" else y[fold != name]
        best = log_likelihood(used, t.power)
        assert all(best >= log_likelihood(used, t.power + d) for d in (-0.002, 0.002))
        shown = df.select(t.forward(F.col("y")).alias("t"), "fold")
        shown = shown if name == "all" else shown.where(F.col("fold") != name)
        m, s = shown.agg(F.avg("t"), F.stddev_pop("t")).first()
        assert abs(m) < 1e-9 and abs(s - 1) < 1e-9


def test_r2_with_constant_target(spark):
    df = spark.createDataFrame(
        [("exact", 3.0, 3.0), ("exact", 3.0, 3.0), ("off", 3.0, 3.0), ("off", 3.0, 4.0)],
        "g string, label double, prediction double",
    )
    out = {r["g"]: r["r2"] for r in metrics.regression_metrics(df, by=["g"]).collect()}
    assert out == {"exact": 1.0, "off": 0.0}


def test_f_score_edges_and_ties(spark):
    rows = [(float(i), 2.0 * i + 1, 5.0, float(i * i % 7), float(i * i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "y double, twice double, fixed double, p double, q double")
    scores = scoring.f_regression(df, ["fixed", "q", "p", "twice"], "y")
    by = {r["feature"]: r["score"] for r in scores.collect()}
    assert by["fixed"] == 0.0 and by["twice"] > 1e15 and by["p"] == by["q"]
    assert by["twice"] <= sys.float_info.max
    assert [r["feature"] for r in scoring.top_k(scores, 3).collect()] == ["twice", "q", "p"]
    assert scoring.select_features(df, ["q", "p"], "y", 0) == ["q", "p"]
    with pytest.raises(ValueError):
        scoring.feature_scores(df, ["p"], "y", "chi2")


def test_binned_information_of_equal_and_independent_columns(spark):
    df = spark.range(10_000).select(
        F.col("id").cast("double").alias("y"), F.col("id").alias("same"),
        F.pmod(F.col("id") * 7919, F.lit(10_007)).alias("other"),
    )
    by = {r["feature"]: r["score"] for r in mutual_info_binned(df, ["same", "other"], "y").collect()}
    assert abs(by["same"] - math.log(10)) < 1e-3 and by["other"] < 0.02


def brute(x, y, k=3):
    x, y, n = x / x.std(), y / y.std(), len(x)
    d = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1][:, None]
    nx, ny = (abs(x[:, None] - x) < r).sum(1), (abs(y[:, None] - y) < r).sum(1)
    psi = -np.euler_gamma + np.concatenate([[0, 0], np.cumsum(1 / np.arange(1, n))])
    return max(0.0, psi[n] + psi[k] - psi[nx].mean() - psi[ny].mean())


@pytest.mark.parametrize("cell_rows", [10_000, 90])
def test_neighbour_information_equals_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(900) ** 3
    y = x + rng.standard_normal(900)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    out = mutual_info_neighbours(df.repartition(3), ["x"], "y", jitter=0.0, cell_rows=cell_rows)
    assert abs(out.first()["score"] - brute(x, y)) < 1e-9


def test_neighbours_with_a_third_of_rows_equal(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.pmod(F.col("id") * 37, F.lit(101)) * 1.0).alias("x"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.pmod(F.col("id") * 37, F.lit(101)) * 2.0).alias("y"),
    )
    one = mutual_info_neighbours(df, ["x"], "y", cell_rows=10_000).first()["score"]
    many = mutual_info_neighbours(df, ["x"], "y", cell_rows=150).first()["score"]
    assert abs(one - many) < 1e-9 and one > 1


def test_scores_do_not_depend_on_the_layout(spark):
    df = spark.range(1200).select(
        "id", F.pmod(F.col("id") * 37, F.lit(9)).alias("x"), F.pmod(F.col("id") * 11, F.lit(5)).alias("y"))
    for keys in (["id"], []):
        scores = [
            mutual_info_neighbours(d, ["x"], "y", cell_rows=c, key_cols=keys).first()["score"]
            for d, c in ((df, 10_000), (df.repartition(5), 200))
        ]
        assert abs(scores[0] - scores[1]) < 1e-9
    # rows that are equal throughout are numbered
    pairs = df.select("x", "y")
    scores = [
        mutual_info_neighbours(d, ["x"], "y", cell_rows=c).first()["score"]
        for d, c in ((pairs, 10_000), (pairs.repartition(3), 200))
    ]
    assert abs(scores[0] - scores[1]) < 1e-9


def test_k_nearest_across_point_sets():
    rng = np.random.default_rng(2)
    p, q = rng.random((700, 2)), rng.random((300, 2))
    full = np.maximum(abs(q[:, None, 0] - p[:, 0]), abs(q[:, None, 1] - p[:, 1]))
    want = np.sort(full, 1)[:, :3]
    reach = want[:, 2] + 1e-9
    np.testing.assert_array_equal(k_nearest(p[:, 0], p[:, 1], q[:, 0], q[:, 1], 3, reach), want)


def test_points_in_one_place_ask_no_other_block(monkeypatch):
    asked, near = [], neighbours._Blocks.near

    def counted(self, *args):
        found = near(self, *args)
        asked.append(len(found[0]))
        return found

    monkeypatch.setattr(neighbours._Blocks, "near", counted)
    one = np.ones(5000)
    assert not k_nearest(one, one, one, one, 3, same=True).any() and sum(asked) == 0
    x, y = np.random.default_rng(3).random((2, 5000))  # a few blocks of 24 points at most, not 64 x all around
    k_nearest(x, y, x, y, 3, same=True)
    assert sum(asked) < 5 * 5000


def test_intervals_on_an_axis_in_and_across_ranges(spark):
    rng = np.random.default_rng(8)
    x, r = np.round(rng.random(400), 2), rng.random(400) ** 4
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, r))]
    radii = spark.createDataFrame(rows, "id bigint, x double, r double").repartition(3)
    n = np.maximum((abs(x[:, None] - x) < r[:, None]).sum(1), 1)
    want = neighbours.digamma(n.astype(float), np.log).sum()
    for parts in (1, 2, 40):
        edges = neighbours.axis_edges(x[::3], parts)
        assert len(edges) < max(parts, 1)
        assert abs(neighbours._sum_digamma(radii, "x", edges) - want) < 1e-9


def test_closer_rank_decides_by_distance():
    points = np.sort(np.random.default_rng(4).random(500)) * 1e3
    center = points[100:200]
    r = np.abs(points[110:210] - center)
    upper = closer_rank(points, center, r, center + r, True)
    lower = closer_rank(points, center, r, center - r, False)
    want = (np.abs(points[None, :] - center[:, None]) < r[:, None]).sum(1)
    np.testing.assert_array_equal(upper - lower, want)


@pytest.mark.parametrize("power", [60.0, -90.0])
def test_yeo_johnson_power_beyond_the_first_grid(spark, power):
    z = np.random.default_rng(5).normal(0.5, 0.1, 2000)
    y = (1 + power * z if power > 0 else z) ** (1 / power) - 1
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    got = transforms.fit_yeo_johnson(df, "y")["all"].power

    def likelihood(p):
        t = ((1 + y) ** p - 1) / p
        return -len(y) / 2 * np.log(t.var()) + (p - 1) * np.log1p(y).sum()

    best = max(np.arange(-400, 400, 0.25) + 0.125, key=likelihood)
    assert best * power > 0 and abs(best) > 30 and abs(got - best) < 0.25
    assert likelihood(got) >= max(likelihood(got - 0.05), likelihood(got + 0.05))
