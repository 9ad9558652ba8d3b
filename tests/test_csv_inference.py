"""Types of CSV columns: values that cannot be numbers are told by their form, without failing casts."""

from pyspark.sql import functions as F

from regatta.sources import records, tables

VALUES = [
    "1", " 1 ", "+1", "-1", "1.5", "1.", ".5", "-.5e3", "1e5", "1E-5", "1e5d", "1d", "1f", "0x1p3", "0x1.8P-3f",
    "nan", "NaN", "inf", "-Infinity", "+inf", "1\t", "\x7f1\x7f", "\x011", "", "-", "+", "e5", ".", "1-2",
    "1996-01-02", "20:07:01", "99999999999999999999", "1_000", "1,0", "abc", "F", "d", "1l", "  infinity ",
    "0x10", "1e", "--1", "1 2", "1\n", "\x1f-3\x1f", "NAN", "1.5D", "Customer#000000001",
]


def test_every_value_that_casts_has_the_form(spark):
    c = F.col("c")
    df = spark.createDataFrame([(v,) for v in VALUES], "c string")
    rows = df.select(
        "c", c.try_cast("bigint").alias("i"), c.rlike(tables._WHOLE).alias("w"),
        c.try_cast("double").alias("d"), c.rlike(tables._NUMBER).alias("n")).collect()
    assert [r["c"] for r in rows if r["i"] is not None and not r["w"]] == []
    assert [r["c"] for r in rows if r["d"] is not None and not r["n"]] == []
    no_number = ["1996-01-02", "20:07:01", "abc", "F", "d", "", "Customer#000000001"]
    assert not any(r["w"] or r["n"] for r in rows if r["c"] in no_number)


def test_fields_are_parsed_once(spark, tmp_path):
    """What reads the fields reads a written table; the parser is in no later plan."""
    path = str(tmp_path / "some.csv")
    spark.range(20).select("id", F.lit("x").alias("t")).write.option("header", True).csv(path)
    plan = tables.read_table(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_csv" not in plan.lower() and "csvtostructs" not in plan.lower()


def test_records_cut_like_line_by_line(spark):
    """Blocks that start inside a field, quotes in pairs, an open end, and batches of any size."""
    import pyarrow as pa

    lines = ['a,"x', 'y"', 'b,"p""q"', "", 'c,"d', "e", 'f"', '"g', "h"]
    data = [("f1", 0, v, False) for v in lines] + [("f1", 9, v, True) for v in ["i", 'j"', "k", '"l']]
    data += [("f2", 0, v, False) for v in ["m", '"n"']]
    names = ["file", "block", "line", "inside"]
    want = [
        ("f1", 0, 1, 'a,"x\ny"', False, False), ("f1", 0, 2, 'b,"p""q"', False, False), ("f1", 0, 3, "", False, False),
        ("f1", 0, 4, 'c,"d\ne\nf"', False, False), ("f1", 0, 5, '"g\nh', False, True),
        ("f1", 9, 0, 'i\nj"', True, False), ("f1", 9, 1, "k", False, False), ("f1", 9, 2, '"l', False, True),
        ("f2", 0, 1, "m", False, False), ("f2", 0, 2, '"n"', False, False),
    ]
    for size in (1, 2, 5, 100):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data[at:at + size], strict=True)], names=names)
            for at in range(0, len(data), size)]
        got = [tuple(r.values()) for b in records._cut(iter(batches)) for r in b.to_pylist()]
        assert got == want, size
