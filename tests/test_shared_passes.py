"""Trees from histograms against plain ones, and fits that share their passes."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.models import binned, grow, svr, together
from regatta.models.together import FitTable, Job
from regatta.plans import search
from regatta.plans.space import draw_params

NAMES = ["a", "b", "c"]


def numbers(n=240, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 7, n) / 4, rng.integers(0, 3, n)]).astype(float)
    y = 3 * x[:, 0] - 5 * x[:, 1] * x[:, 2] + rng.standard_normal(n) * 4 + 30
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = numbers()
    data = [(i, *map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double, fold int").repartition(3).cache()


def source(rows, key_cols=("id",)):
    return FitTable.of(rows, NAMES, [F.col("y")], key_cols, "fold")


def plain_tree(x, r, depth, leaves, least, split, gain, l1, l2):
    """Node values of a tree grown best first, by trying every cut."""
    def shrunk(s):
        return np.sign(s) * max(abs(s) - l1, 0)

    def score(s, n):
        return shrunk(s) ** 2 / (n + l2)

    def best(part, level):
        if level >= depth or len(part) < max(split, 2 * least):
            return None
        found = None
        for j in range(x.shape[1]):
            values = np.unique(x[part, j])
            for lo, hi in zip(values[:-1], values[1:], strict=True):
                left = part[x[part, j] <= (lo + hi) / 2]
                right = part[x[part, j] > (lo + hi) / 2]
                if min(len(left), len(right)) < least:
                    continue
                g = score(r[left].sum(), len(left)) + score(r[right].sum(), len(right)) - score(r[part].sum(), len(part))
                if g > gain and g > 1e-9 and (found is None or g > found[0] + 1e-9):
                    found = (g, left, right)
        return found

    out, queue, n, tick = np.zeros(len(r)), [], 1, 0
    everything = np.arange(len(r))
    done = []

    def push(part, level):
        nonlocal tick
        split_ = best(part, level)
        if split_ is None:
            done.append(part)
        else:
            tick += 1
            heapq.heappush(queue, (-split_[0], tick, part, split_, level))

    push(everything, 0)
    while queue and n < leaves:
        _, _, _, (_, left, right), level = heapq.heappop(queue)
        n += 1
        push(left, level + 1)
        push(right, level + 1)
    for part in [*done, *(q[2] for q in queue)]:
        out[part] = shrunk(r[part].sum()) / (len(part) + l2)
    return out


def plain_boost(x, y, rounds, rate, **limits):
    f = np.full(len(y), y.mean())
    for _ in range(rounds):
        f = f + rate * plain_tree(x, y - f, **limits)
    return f


OFF = {"depth": 99, "leaves": 1e9, "least": 1, "split": 2, "gain": 0.0, "l1": 0.0, "l2": 0.0}
CASES = [
    ("XGB", {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.4, "lambda": 2.5, "alpha": 3.0, "gamma": 8.0,
             "min_child_weight": 5}, OFF | {"depth": 3, "least": 5, "gain": 8.0, "l1": 3.0, "l2": 2.5}, 4, 0.4),
    ("LGB", {"n_estimators": 3, "num_leaves": 6, "learning_rate": 0.5, "reg_lambda": 1.0, "reg_alpha": 0.5,
             "min_split_gain": 1.0, "min_child_samples": 4},
     OFF | {"leaves": 6, "least": 4, "gain": 1.0, "l1": 0.5, "l2": 1.0}, 3, 0.5),
    ("LGB", {"n_estimators": 2, "num_leaves": 9, "max_depth": 3, "min_child_samples": 1}, OFF | {"leaves": 9, "depth": 3}, 2, 0.1),
    ("RF", {"n_estimators": 1, "bootstrap": False, "min_samples_split": 40, "min_samples_leaf": 6},
     OFF | {"split": 40, "least": 6}, 1, 1.0),
    ("RF", {"n_estimators": 1, "bootstrap": False, "max_depth": 4}, OFF | {"depth": 4}, 1, 1.0),
]


@pytest.mark.parametrize("small, family, params, limits, rounds, rate", [
    *((False, *case) for case in CASES), *((True, *case) for case in CASES[1:4:2])])
def test_trees_equal_plain_ones(rows, monkeypatch, small, family, params, limits, rounds, rate):
    if small:  # everything in slices, over many passes, without kept parents
        monkeypatch.setattr(binned, "CELLS_PER_PASS", 100)
        monkeypatch.setattr(binned, "SLICE", 2)
        monkeypatch.setattr(grow, "KEPT_CELLS", 0)
        monkeypatch.setattr(grow, "RECENT", 1)
    x, y = numbers()
    model = search.fit_jobs(source(rows), family, [Job(params)])[0]
    np.testing.assert_allclose(model.decide(x), plain_boost(x, y, rounds, rate, **limits), rtol=1e-9)
    assert model.ignored_params == []
    out = model.predict(rows, "p").orderBy("id").collect()
    np.testing.assert_allclose([r.p for r in out], model.decide(x), rtol=1e-12)


def test_parent_minus_child_saves_rows_not_trees(rows, monkeypatch):
    p = {"n_estimators": 3, "max_depth": 4}
    with_parents = search.fit_jobs(source(rows), "XGB", [Job(p)])[0]
    monkeypatch.setattr(grow, "KEPT_CELLS", 0)
    without = search.fit_jobs(source(rows), "XGB", [Job(p)])[0]
    x, _ = numbers()
    np.testing.assert_allclose(with_parents.decide(x), without.decide(x), rtol=1e-9)


JOBS = {
    "RF": {"n_estimators": 4, "max_depth": 4, "min_samples_split": 9},
    "XGB": {"n_estimators": 6, "max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.7},
    "LGB": {"n_estimators": 14, "num_leaves": 5, "boosting_type": "dart", "subsample": 0.6, "bagging_freq": 3},
    "ET": {"n_estimators": 3, "max_depth": 4, "bootstrap": True},
    "SVR": {"kernel": "rbf", "gamma": 0.1, "C": 5.0, "landmarks": 20},
    "NN": {"hidden_layer_sizes": [6], "max_iter": 4, "batch_size": 16, "rows_per_worker": 90, "early_stopping": True},
}


@pytest.mark.parametrize("family", list(JOBS))
def test_together_or_alone_on_any_layout(rows, family):
    x, _ = numbers()
    jobs = [Job(JOBS[family], 1, fold=0), Job(JOBS[family], 1, fold=1), Job(JOBS[family], 2)]
    t = source(rows)
    models = search.fit_jobs(t, family, jobs)
    shared, alone = t.passes, 0
    other = source(rows.repartition(1))
    for job, model in zip(jobs, models, strict=True):
        before = other.passes
        single = search.fit_jobs(other, family, [job])[0]
        alone += other.passes - before
        np.testing.assert_allclose(single.decide(x), model.decide(x), rtol=1e-6)
    assert shared <= alone / 2
    different = [m.decide(x) for m in models]
    assert not np.allclose(different[0], different[1]) and not np.allclose(different[0], different[2])


def test_a_fold_is_left_out(rows):
    x, _ = numbers()
    keep = rows.where("fold <> 1")
    for family in ("ET", "SVR", "RF"):
        p = JOBS[family]
        left_out = search.fit_jobs(source(rows), family, [Job(p, 3, fold=1)])[0]
        filtered = search.fit_jobs(source(keep), family, [Job(p, 3)])[0]
        np.testing.assert_allclose(left_out.decide(x), filtered.decide(x), rtol=1e-6)


def test_dropout_weights(rows):
    """Stored fits follow the changing weights: storing after every tree changes nothing."""
    x, y = numbers()
    p = {"n_estimators": 30, "num_leaves": 4, "boosting_type": "dart", "learning_rate": 0.3}
    plain = search.fit_jobs(source(rows), "LGB", [Job(p, 5)])[0]
    assert len(plain.ensemble_.trees) == 30 and len({round(w, 9) for w in plain.ensemble_.weights}) > 1
    error = np.mean((plain.decide(x) - y) ** 2)
    assert error < 0.5 * np.var(y)
    gbdt = search.fit_jobs(source(rows), "LGB", [Job(p | {"boosting_type": "gbdt"}, 5)])[0]
    assert set(gbdt.ensemble_.weights) == {0.3}


def test_columns_are_drawn_for_each_tree(rows):
    p = {"n_estimators": 12, "max_depth": 3, "colsample_bytree": 0.4}
    model = search.fit_jobs(source(rows), "XGB", [Job(p, 2)])[0]
    used = [set(t.feature[t.feature >= 0].tolist()) for t in model.ensemble_.trees]
    assert all(len(u) <= 1 for u in used) and len(set().union(*used)) > 1


def test_fifty_trials_of_five_folds(spark):
    """All trials and folds of a kernel machine in at most a hundred passes."""
    x, y = numbers(400, 9)
    data = [(i, *map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y double, fold int")
    table = search.TrainingTable(df.withColumn("is_test", F.lit(False)), NAMES, "y", ["id"], 5)
    drawn = [{**p, "landmarks": 30} for p in draw_params(spark, "SVR", 50, 3)]
    trials = search.run_trials(table, "SVR", drawn, 1).orderBy("trial_id").collect()
    assert len(trials) == 50 and table.source()[0].passes <= 100
    one = search.cross_validate(table, "SVR", drawn[7], search.seed_of(1, 7))
    assert trials[7]["mse_splits"] == pytest.approx(one["mse_splits"], rel=1e-9)
    assert len(trials[7]["r2_splits"]) == 5


def test_incomplete_rows_are_left_out_of_every_fit(spark):
    x, y = numbers()
    data = [(i, *map(float, r), float(t), None, 0) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    schema = "id int, a double, b double, c double, y double, flag boolean, fold int"
    df = spark.createDataFrame(data, schema).withColumn("flag", F.when(F.col("id") % 7 > 0, F.col("id") % 2 > 0))
    bad = df.withColumn("a", F.when(F.col("id") % 11 > 0, F.col("a")))
    good = bad.where("flag is not null and a is not null")
    for family in ("LR", "RF", "ET", "XGB", "SVR", "NN"):
        p = JOBS.get(family, {})
        got, want = (
            search.fit_model(d, [*NAMES, "flag"], "y", family, p, seed=1, key_cols=["id"]) for d in (bad, good))
        gap = want.predict(got.predict(good, "p"), "q").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
        assert gap < 1e-6, family


def test_cuts(spark):
    df = spark.range(5000).selectExpr("id % 4 + 0.5 as few", "cast(id as double) as many", "1.0 as one", "id % 300 * 1.0 as some")
    few, many, one, some = binned.feature_cuts(df, ["few", "many", "one", "some"], 64)
    assert few.tolist() == [1.0, 2.0, 3.0] and len(one) == 0
    assert len(many) <= 63 and len(some) <= 63 and np.all(np.diff(many) > 0)
    assert np.max(np.diff([0, *many, 5000])) < 2 * 5000 / 64


def test_passes_are_split_by_size(rows, monkeypatch):
    x, _ = numbers()
    jobs = [Job(JOBS["SVR"], s) for s in (1, 2, 3)]
    whole = source(rows)
    models = search.fit_jobs(whole, "SVR", jobs)
    monkeypatch.setattr(together, "BYTES_PER_PASS", 1)
    split = source(rows)
    for a, b in zip(models, search.fit_jobs(split, "SVR", jobs), strict=True):
        np.testing.assert_allclose(a.decide(x), b.decide(x), rtol=1e-9)
    assert split.passes > 2 * whole.passes


def test_kernel_sums_are_made_in_blocks_of_rows(monkeypatch):
    """Maps of a whole batch leave the caches of a core; the sums are the same block by block."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5000, 3)), rng.normal(size=5000)
    model = svr.SvrModel("SVR", ["a", "b", "c"], {"kernel": "rbf", "gamma": 0.3})
    model.center, model.scale, model.landmarks = np.zeros(3), np.ones(3), x[:8]
    model.root, model.weights = rng.normal(size=(8, 8)), rng.normal(size=8)
    step, sizes, mapped = svr._Sums(model, 0.1, 1.0), [], svr.SvrModel.mapped
    monkeypatch.setattr(svr.SvrModel, "mapped", lambda m, rows: sizes.append(len(rows)) or mapped(m, rows))
    state = step.start()
    step.add(state, x, y, None)
    assert sum(sizes) == 5000 and max(sizes) <= 1024
    phi = np.hstack([mapped(model, x), np.ones((5000, 1))])
    gap = y - phi[:, :-1] @ model.weights
    w = sum(0.25 / np.maximum(np.abs(s * gap - 0.1), 1.0) for s in (1, -1))
    assert np.allclose(state[1], (phi * w[:, None]).T @ phi)
    assert np.isclose(state[0][0], np.clip(np.abs(gap) - 0.1, 0, None).sum())


def test_passes_read_packed_rows(rows, monkeypatch):
    """Every row lies once in a record of its own fold, bit for bit, also in small records and runs."""
    monkeypatch.setattr(together, "RECORD_BYTES", 200)
    monkeypatch.setattr(together, "RUN_ROWS", 16)
    t = source(rows.withColumn("fold", F.when(F.col("id") % 9 > 0, F.col("fold"))))
    found = t.packed().collect()
    assert len(found) >= 240 / 5 and {r["fold"] for r in found} == {-1, 0, 1, 2}
    got = sorted(
        (r["fold"], *v[:-1].tolist(), int(v[-1:].view(np.int64)[0]))
        for r in found for v in np.frombuffer(bytes(r["block"])).reshape(-1, 5))
    assert got == sorted((-1 if r["fold"] is None else r["fold"], r.f0, r.f1, r.f2, r.y0, r.h) for r in t.rows.collect())
    x, _ = numbers()
    small = search.fit_jobs(t, "SVR", [Job(JOBS["SVR"], 1, fold=2)])[0]
    assert t._packed is None
    monkeypatch.undo()
    np.testing.assert_allclose(
        small.decide(x), search.fit_jobs(t, "SVR", [Job(JOBS["SVR"], 1, fold=2)])[0].decide(x), rtol=1e-9)


def test_landmarks_sort_few_rows(monkeypatch):
    """Only rows whose draw is small enough are sorted, and the same ones are found, ties included."""
    rng = np.random.default_rng(5)
    step, sizes, least = svr._Landmarks(20, 3, 2), [], svr._Landmarks._least
    h, x = rng.integers(0, 3000, 6000), rng.integers(0, 9, (6000, 2)).astype(float)
    monkeypatch.setattr(svr._Landmarks, "_least", lambda s, r: sizes.append(len(r)) or least(s, r))
    state = step.start()
    for at in range(0, 6000, 1000):
        step.add(state, x[at:at + 1000], None, h[at:at + 1000])
    assert max(sizes) <= 100
    everything = np.column_stack([svr.row_uniform(h, 0, 3), x])
    np.testing.assert_array_equal(state[0], least(step, everything))


def test_kernel_values():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(30, 3)) * 4, rng.normal(size=(7, 3)) * 4
    apart = ((a[:, None] - b[None]) ** 2).sum(2)
    np.testing.assert_allclose(svr.kernel(a, b, {"gamma": 0.3}), np.exp(-0.3 * apart), rtol=1e-12)
    for degree in range(7):
        p = {"kernel": "poly", "gamma": 0.2, "coef0": 0.5, "degree": degree}
        np.testing.assert_allclose(svr.kernel(a, b, p), (0.2 * a @ b.T + 0.5) ** degree, rtol=1e-11)


def test_predictions_are_made_in_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 3))
    model = svr.SvrModel("SVR", ["a", "b", "c"], {"kernel": "rbf", "gamma": 0.3})
    model.center, model.scale, model.landmarks = np.ones(3), np.full(3, 2.0), x[:256]
    model.root, model.weights, model.intercept = rng.normal(size=(256, 9)), rng.normal(size=9), 2.0
    want = model.mapped(x) @ model.weights + 2.0
    sizes, kernel = [], svr.kernel
    monkeypatch.setattr(svr, "kernel", lambda a, b, p: sizes.append(len(a)) or kernel(a, b, p))
    np.testing.assert_allclose(model.decide(x), want, rtol=1e-9, atol=1e-9)
    assert sum(sizes) == 5000 and max(sizes) <= 1024
    assert model.decide(x[:0]).shape == (0,)
