import pytest
from pyspark.sql import functions as F

from regatta.operators import split as sp


def test_split_is_stable_under_partitioning_and_complete(spark, lineitem):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    a = sp.train_test_split(lineitem, keys, seed=5).select(*keys, "is_test")
    b = sp.train_test_split(lineitem.repartition(13), keys, seed=5).select(*keys, "is_test")
    assert a.exceptAll(b).count() == 0 and a.count() == lineitem.count()


def test_seeds_give_unrelated_splits(spark):
    df = spark.range(200_000)
    both = sp.train_test_split(df, ["id"], seed=1).withColumnRenamed("is_test", "a")
    both = sp.train_test_split(both, ["id"], seed=2)
    shares = {(r["a"], r["is_test"]): r["count"] / 200_000 for r in both.groupBy("a", "is_test").count().collect()}
    assert abs(shares[(True, True)] - 0.04) < 0.004
    assert abs(shares[(False, False)] - 0.64) < 0.01


def test_text_and_missing_keys_work(spark):
    df = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("name"))
    by_name = sp.assign_folds(df, ["name"], k=4)
    assert by_name.where("is_test").count() in range(320, 480)
    assert by_name.where("NOT is_test AND fold IS NULL").count() == 0
    by_content = sp.assign_folds(df, [], k=4)
    assert by_content.select("fold").distinct().count() == 5


def test_exact_folds_have_the_exact_sizes(spark):
    df = spark.range(17)
    out = sp.assign_folds(df, ["id"], k=5, exact=True)
    sizes = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert sizes == {None: 4, 0: 3, 1: 3, 2: 3, 3: 2, 4: 2}  # ceil(17 * 0.2) test, 13 over 5
    assert out.where("is_test AND fold IS NOT NULL").count() == 0
    again = sp.train_test_split(df, ["id"], exact=True)
    assert {r["id"] for r in again.where("is_test").collect()} == {r["id"] for r in out.where("is_test").collect()}


def test_huge_and_negative_keys(spark):
    df = spark.range(1000).select((F.col("id") * 9007199254740993 - (1 << 62)).alias("k"))
    out = sp.assign_folds(df, ["k"], k=3, exact=True)
    assert out.where("is_test").count() == 200


def test_repeat_seeds(spark):
    seeds = sp.repeat_seeds(spark, 20, seed=1)
    assert len(set(seeds)) == 20 and all(0 <= s < 10_000 for s in seeds)
    assert seeds == sp.repeat_seeds(spark, 20, seed=1)
    assert sp.repeat_seeds(spark, 2, [7, 8]) == [7, 8]
    with pytest.raises(ValueError):
        sp.repeat_seeds(spark, 3, [7, 8])


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        sp.assign_folds(spark.range(5), ["id"], k=1)
    with pytest.raises(ValueError):
        sp.train_test_split(spark.range(5), ["id"], test_size=1.5)
    with pytest.raises(ValueError):
        sp.assign_folds(spark.range(4), ["id"], k=5, exact=True)
