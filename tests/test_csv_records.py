"""CSV of any size: records cut at block borders."""

import csv
import random

import pytest

from regatta.sources import records, tables


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator=end).writerows(rows)


def content(n=400, seed=1):
    draw = random.Random(seed)
    pieces = ["plain", 'with "quotes"', "a,b", "two\nlines", "many\n\n\nlines\n", '"', '""\n"', "é ü", "", "x" * 300, "cr\r\nlf"]
    rows = [["k", "text, really", "v"]]
    rows += [[str(k), draw.choice(pieces) + draw.choice(pieces), str(draw.randrange(100) / 4)] for k in range(n)]
    rows[57][1] = "a record\n" * 900  # over many blocks
    return rows


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_breaks_at_block_borders(spark, tmp_path, small_blocks, end):
    rows = content()
    path = f"{tmp_path}/t.csv"
    written(path, rows, end)
    assert records._lines(spark, path).rdd.getNumPartitions() > 10
    got = tables.read_table(spark, path)
    assert got.columns == rows[0] and dict(got.dtypes) == {"k": "bigint", "text, really": "string", "v": "double"}
    want = {int(k): (t if t not in tables.NA_WORDS else None, float(v)) for k, t, v in rows[1:]}
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_blocks_know_whether_they_start_inside(spark, tmp_path, small_blocks):
    path = f"{tmp_path}/q.csv"
    written(path, [["a"], *[["line\n" * 500] for _ in range(3)]])
    starts = records.blocks(records._lines(spark, path)).orderBy("block").collect()
    assert not starts[0].inside and sum(r.inside for r in starts) > len(starts) / 2


def test_many_files_and_blank_lines(spark, tmp_path, small_blocks):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    rows = content(90)
    for part in range(3):
        written(folder / f"p{part}.csv", [rows[0], *rows[1 + 30 * part:31 + 30 * part]])
    (folder / "p3.csv").write_text('k,"text, really",v\n\n900,x,1.0\n\n')
    got = tables.read_table(spark, str(folder))
    assert sorted(r.k for r in got.collect()) == [*range(90), 900]
    (folder / "p4.csv").write_text("other,header\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(folder))


def test_only_a_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    got = tables.read_table(spark, f"{tmp_path}/e.csv", "a int, b string")
    assert got.count() == 0 and got.columns == ["a", "b"]
    (tmp_path / "n.csv").write_text("")
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/n.csv")
