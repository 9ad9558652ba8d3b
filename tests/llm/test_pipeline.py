"""The pipeline's stages against brute-force versions of each."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regatta.llm import queries, toxicity
from tests_support import plain_contaminated, plain_keepers, plain_redacted


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage of a small corpus reads and writes."""
    folder, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([
        (10**6, None, "en", "x", 0), (10**6 + 1, "", "en", "x", 0), (None, "no id at all", "en", None, 12),
        (10**6 + 2, "twice the same", "en", "x", 14), (10**6 + 2, "twice the same", "en", "x", 14),
    ], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        found = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, found))
        docs = found
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def test_names_and_columns(stages):
    assert list(stages) == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]
    for name, (docs, found) in stages.items():
        if name != "packing":
            assert found.dtypes == docs.dtypes


def test_toxicity(spark, sf, stages):
    docs, found = stages["toxicity"]
    known = queries.toxicity_classifier(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = toxicity.score(docs, known, to="s")
    assert rows(found) == rows(scored.where(F.col("s") < 0.7).drop("s"))


def test_near_copies(stages):
    docs, found = stages["near_copies"]
    assert rows(found) == sorted(plain_keepers(docs.collect()), key=str)


def test_decontamination(spark, sf, stages):
    docs, found = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(found) == sorted((tuple(r) for r in docs.collect() if not plain_contaminated(r.text, items)), key=str)
    assert found.count() < docs.count()


def test_secrets(stages):
    docs, found = stages["secrets"]
    want = {r.doc_id: r for r in docs.collect()}
    for r in found.collect():
        assert plain_redacted(want[r.doc_id].text, r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert found.count() == docs.count()


def test_packing(stages):
    docs, found = stages["packing"]
    totals = {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    whole = {r.doc_id: r.doc_tokens for r in found.collect()}
    assert totals == whole and totals.keys() == {r.doc_id for r in docs.collect()}


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_columns_of_any_name_stay(spark, sf):
    names = ["_score", "score", "n_words", "hit_words", "hit_items", "hex", "markov", "_own_id", "_own_tie", "row"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    marked = docs.select("*", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, marked, sf)
        assert found.dtypes == marked.dtypes, name
        got = found.collect()
        assert got, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name


def test_a_stage_bounds_the_rows_of_batches(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    try:
        for value, want in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (7, 7)):
            spark.conf.set(name, value)
            corpus_pipeline.pack(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, was)
