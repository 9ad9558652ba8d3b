"""From raw documents to packed training windows, stage by stage.

Every stage but the last keeps all columns of the documents, whatever their names. A null text
counts as empty in each and stays null; repeated rows are judged alike, and the second stage keeps
one of them; an empty table stays empty. Texts are read as a whole, however long. Column names with
dots are refused: Spark does not hand such columns to Arrow functions. Each stage bounds the rows
of the session's Arrow batches, as its result is computed after it returns; results do not change.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.llm import ngram_join, packing, queries, secret_scan, toxicity, wu_manber
from regatta.llm.carried import free_name, moved_aside, quoted
from regatta.session import ship_package

BATCH_ROWS = 1000
"""Documents that pass between Spark and a Python worker at a time: whole texts, held by both."""


def _prepared(spark: SparkSession) -> None:
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; the classifier learns from the labels."""
    _prepared(spark)
    known = queries.toxicity_classifier(docs, queries.table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return toxicity.score(docs, known, to=score).where(F.col(score) < 0.7).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    _prepared(spark)
    return ngram_join.one_of_each(docs, ngram_join.link_components(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    _prepared(spark)
    aside, places = moved_aside(docs, "n_words", "hit_words", "hit_items")
    found = wu_manber.find_passages(aside, queries.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select(*map(quoted, places)).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew."""
    _prepared(spark)
    model = secret_scan.MarkovRatio(secret_scan.labelled_samples(docs))
    aside, places = moved_aside(docs, *secret_scan.KINDS)
    found = secret_scan.scan(aside, model, cut=True)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), secret_scan.ordered(*secret_scan.KINDS)))
    clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*map(quoted, places)).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows."""
    _prepared(spark)
    return packing.pack(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: A learned classifier and a tokenizer file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the one before it wrote."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = queries.folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
