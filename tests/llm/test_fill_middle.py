"""Fill-in-middle forms against a plain version over regular expressions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regatta.llm import common, fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "a", "one two, three", "ÉT été x\n\ty", "<P> inside", "a <S", "S> b <M", "<<P", "é" * 50,
    "𝒳 emoji 👍🏽 und Größe", "\x00\x1f  z", "word " * 3000, "x" * 70_000, "same text", "same text", "<",
]


def run(docs):
    return fill_middle.transform(docs).withColumn(
        "back", fill_middle.restored(F.col("form"), F.col("output")))


def test_equals_plain_version(spark):
    rows = [(k, t) for k in range(12) for t in TEXTS] + [(None, "no id at all, but a text"), (3, "a"), (3, "a")]
    rows += [(10**12 + k, "ein Wort nach dem anderen") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = run(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(
        map(str, ((i, *plain(i, t)) for i, t in rows)))
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_columns(spark):
    docs = spark.sql("select 5L as doc_id, 'a b c' as text, 'x' as form, 1 as N, 'k' as `a.b`, '7' as id, 8 as _0")
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "a.b", "id", "_0", "n", "form", "output", "prefix_chars", "middle_chars"]
    row = got.first()
    assert (row["a.b"], row["id"], row["_0"], row["n"]) == ("k", "7", 8, 5)
    assert (row.form, row.output) == (plain(5, "a b c")[1], plain(5, "a b c")[4])


def test_empty_table_and_options(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run(docs).count() == 0
    docs = spark.range(200).selectExpr("id as doc_id", "concat('some text ', id) as text")
    forms = fill_middle.transform(docs, plain_percent=0, suffix_first_percent=100).select("form").distinct()
    assert [r.form for r in forms.collect()] == ["spm"]
    forms = fill_middle.transform(docs, plain_percent=100).select("form").distinct()
    assert [r.form for r in forms.collect()] == ["plain"]


@given(st.lists(st.text(alphabet="ab Ä\n<€𝒳9", max_size=40), min_size=1, max_size=6))
def test_units_of_texts(texts):
    widths, first = fill_middle.unit_widths(*common.buffers(pa.array(texts, pa.string())))
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert widths[a:b].tolist() == [len(u) for u in UNIT.findall(text)]


@pytest.mark.parametrize("fan", [2, 3, 16])
@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 1000])
def test_skip_list(n, fan):
    chars = np.random.default_rng(n).integers(1, 9, n)
    units = fill_middle.SkipList(chars, fan)
    assert [units.code_point(k) for k in range(n + 1)] == [0, *np.cumsum(chars).tolist()]
    assert all(int(u.sum()) == n and int(p.sum()) == int(chars.sum()) for u, p in units.lanes)
    with pytest.raises(IndexError):
        units.code_point(n + 1)
