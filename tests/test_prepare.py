import pytest
from pyspark.sql import functions as F

from regatta.operators import clean, dedupe, encode, stats
from regatta.operators.prepare import PrepareConfig, prepare


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sentinels_become_null(spark):
    df = frame(
        spark,
        [(1, float("inf"), "#NAME?"), (2, float("-inf"), "a"), (3, float("nan"), None), (4, 1.5, "b")],
        "k int, x double, s string",
    )
    out = clean.clean_sentinels(df).orderBy("k").collect()
    assert [r["x"] for r in out] == [None, None, None, 1.5]
    assert [r["s"] for r in out] == [None, "a", None, "b"]


def test_sparse_threshold_is_strict(spark):
    rows = [(i, None if i < 20 else i, None if i < 21 else i) for i in range(100)]
    df = frame(spark, rows, "k int, at int, above int")
    found = stats.column_stats(df)
    assert stats.prune_sparse_columns(found) == ["above"]


def test_constant_with_gaps_is_dropped_and_all_null_is_not_constant(spark):
    rows = [(i, None if i % 10 == 0 else 7, None) for i in range(50)]
    df = frame(spark, rows, "k int, c int, n int")
    found = stats.column_stats(df)
    assert stats.prune_constant_columns(found) == ["c"]
    assert stats.prune_sparse_columns(found) == ["n"]


def test_mode_tie_takes_the_smallest(spark):
    df = frame(spark, [("b",), ("b",), ("a",), ("a",), (None,)], "c string")
    assert {r["c"] for r in encode.impute_mode(df, ["c"]).where("c IS NULL OR c <> 'b'").collect()} == {"a"}
    assert stats.mode_of(stats.value_counts(df, ["c"], 10)["c"]) == "a"


def test_numeric_categories_get_the_median_before_encoding(spark):
    rows = [(i, float(i), g) for i, g in enumerate([1, 1, 2, 2, None, 3, 3, 3, 1, 2])]
    df = frame(spark, rows, "k int, y double, g int")
    out = prepare(df, PrepareConfig("y", key_cols=("k",), categorical_features=("g",)))
    assert out.features == ["g_1", "g_2", "g_3"]
    assert out.df.where("k = 4").first()["g_2"] is True
    by_mode = prepare(
        df, PrepareConfig("y", key_cols=("k",), categorical_features=("g",), categorical_fill="mode")
    )
    assert by_mode.df.where("k = 4").first()["g_1"] is True


def test_median_between_codes_makes_its_own_category(spark):
    rows = [(i, float(i), g) for i, g in enumerate([1, 1, 1, 2, 2, 2, None])]
    df = frame(spark, rows, "k int, y double, g int")
    out = prepare(df, PrepareConfig("y", key_cols=("k",), categorical_features=("g",)))
    assert out.features == ["g_1", "g_1.5", "g_2"]


def test_duplicates_differ_only_in_dropped_column(spark):
    rows = [(1, "a", 1.0, 9), (2, "a", 1.0, 8), (3, "b", 2.0, 7), (4, "b", 3.0, 7)]
    df = frame(spark, rows, "k int, c string, y double, note int")
    config = PrepareConfig("y", ("k",), features_to_drop=("note",), categorical_features=("c",))
    out = prepare(df, config)
    assert sorted(r["k"] for r in out.df.collect()) == [1, 3, 4]
    assert out.n_rows == 3


@pytest.mark.parametrize("strategy", ["group", "digest"])
def test_dedupe_survives_a_hot_row_and_nulls(spark, strategy):
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    out = dedupe.drop_duplicate_rows(hot, ["id"], strategy)
    assert out.count() == 2001
    assert out.where("v IS NULL").first()["id"] == 0
    assert dedupe.duplicate_count(hot, ["v"]).first()[0] == 999


def test_dedupe_with_several_keys_and_without(spark):
    df = frame(spark, [(2, 1, "x"), (1, 9, "x"), (1, 2, "x")], "a int, b int, v string")
    assert dedupe.drop_duplicate_rows(df, ["a", "b"]).collect()[0][:2] == (1, 2)
    assert dedupe.drop_duplicate_rows(df.select("v"), []).count() == 1


def survey(spark):
    rows = [(i, float(i % 5), float(i % 3) if i % 4 else None, float(i % 7), float(i % 2)) for i in range(40)]
    return frame(
        spark, rows, "k int, DASS_Depr_Sum double, DASS_Stress_Sum double, DASS_Anxiety_Sum double, Age double"
    )


def test_composite_target_is_added(spark):
    out = prepare(survey(spark), PrepareConfig("DASS_Sum", key_cols=("k",)))
    row = out.df.where("k = 5").first()
    assert row["DASS_Sum"] == 0 + 2 + 5
    assert "DASS_Depr_Sum" in out.features
    assert out.n_rows < 40
    leaky = prepare(survey(spark), PrepareConfig("DASS_Sum", key_cols=("k",), drop_leaky=True))
    assert leaky.features == ["Age"]


def test_row_sum_counts_missing_as_zero(spark):
    parts = ["DASS_Depr_Sum", "DASS_Stress_Sum", "DASS_Anxiety_Sum"]
    out = clean.composite_target(survey(spark), "DASS_Sum", parts, skipna=True)
    assert out.count() == 40
    assert out.where("k = 4").first()["DASS_Sum"] == 4 + 0 + 4


def test_bad_inputs_are_rejected_before_any_job(spark):
    df = frame(spark, [(1, 1.0, "a")], "k int, y double, t string")
    for config in (
        PrepareConfig("absent"), PrepareConfig("y", categorical_features=("absent",)),
        PrepareConfig("y", features_to_drop=("absent",)), PrepareConfig("DASS_Sum"),
    ):
        with pytest.raises(ValueError):
            prepare(df, config)
    two = frame(spark, [(1, 1.0, "a"), (2, 2.0, "b")], "k int, y double, t string")
    with pytest.raises(ValueError, match="neither numeric"):
        prepare(two, PrepareConfig("y", key_cols=("k",)))
    assert prepare(two, PrepareConfig("y", key_cols=("k",), non_numeric="drop")).features == []


def test_constant_target_is_a_clear_error(spark):
    df = frame(spark, [(1, 5.0, 1), (2, 5.0, 2)], "k int, y double, x int")
    with pytest.raises(ValueError, match="single value"):
        prepare(df, PrepareConfig("y", key_cols=("k",)))


def test_removed_categorical_is_reported(spark):
    rows = [(i, float(i), "same", "a" if i % 2 else "b") for i in range(10)]
    df = frame(spark, rows, "k int, y double, c string, d string")
    out = prepare(df, PrepareConfig("y", key_cols=("k",), categorical_features=("c", "d")))
    assert out.features == ["d_a", "d_b"]
    assert "already removed: c" in out.audit().where("step = 'one_hot'").first()["note"]


def test_too_many_categories_fail_loudly(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 100"):
        encode.one_hot(df, ["c"], max_categories=100)


def test_names_with_dots_and_booleans(spark):
    rows = [(i, float(i), bool(i % 2), "x" if i % 3 else "y") for i in range(12)]
    df = frame(spark, rows, "k int, `the.y` double, `is.on` boolean, `a b` string")
    out = prepare(df, PrepareConfig("the.y", key_cols=("k",), categorical_features=("is.on", "a b")))
    assert out.features == ["is.on_False", "is.on_True", "a b_x", "a b_y"]
    assert out.df.count() == 12


def test_null_booleans_are_filled(spark):
    rows = [(i, float(i), [True, False, None, True, True][i % 5]) for i in range(50)]
    out = prepare(frame(spark, [*rows[:-1], (49, 49.0, True)], "k int, y double, f boolean"),
                  PrepareConfig("y", key_cols=("k",), sparse_threshold=0.3))
    assert out.df.where("f is null").count() == 0 and out.df.where("k = 2").first()["f"] is True


def test_bitmap_of_repeated_rows(spark, monkeypatch):
    """With few words distinct rows share bits with repeated ones and are compared by value."""
    rows = [(i, i % 700, f"v{i % 700}" if i % 3 else None) for i in range(1500)]
    df = frame(spark, rows, "word int, a int, bits string").repartition(4)
    want = {}
    for k, a, b in rows:
        want[a, b] = min(k, want.get((a, b), k))
    for words in (1, 8, 1 << 20):
        monkeypatch.setattr(dedupe, "WORDS", words)
        got = dedupe.drop_duplicate_rows(df, ["word"])
        assert got.columns == ["word", "a", "bits"]
        assert {(r.a, r.bits): r.word for r in got.collect()} == want
        assert dedupe.drop_duplicate_rows(df.select("a", "bits")).count() == len(want)


def test_modes(spark):
    df = frame(spark, [(2.0, "b", True), (10.0, "b", False), (10.0, "a", None), (2.0, "a", None), (None, None, None)],
               "x double, s string, f boolean")
    assert stats.modes(df, ["x", "s", "f"]) == {"x": 2.0, "s": "a", "f": False}
    assert stats.modes(df.where("x is null"), ["x", "f"]) == {"x": None, "f": None}
