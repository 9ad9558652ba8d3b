"""Input tables and rename maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import chunks, col
from regatta.session import materialize
from regatta.sources.records import csv_records

#: Quotes are doubled inside quoted fields, which may hold line breaks.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
#: The words that count as missing in a field.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# What a cast to bigint or double can take at most: a failing cast costs an exception for each value.
_PAD = r"[\x00-\x20\x7f]*"
_WHOLE = rf"^{_PAD}[+-]?[0-9]+{_PAD}$"
_NUMBER = (
    rf"^{_PAD}[+-]?(?:(?i:nan|inf(?:inity)?)|[0-9.][0-9a-fA-FxX.]*(?:[eEpP][+-]?[0-9]+)?[fFdD]?){_PAD}$"
)
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV's fields as text, with NA words as null. Each file's first record is its header.

    Records are parsed once and the fields written: what reads them names each many times, and the
    parser would run anew for every one.
    """
    records = csv_records(spark, path)
    first = records.groupBy("file").agg(F.min(F.struct("block", "number", "text")).alias("first"))
    headers = materialize(first.select("file", "first.block", "first.number", "first.text"))
    heads = [r["text"] for r in headers.select("text").distinct().limit(2).collect()]
    if not heads:
        raise ValueError(f"{path} has no header")
    if len(heads) > 1:
        raise ValueError(f"the files of {path} have different headers")
    names = spark.read.options(**{**CSV_OPTIONS, "header": "false"}, multiLine=True).csv(
        spark.sparkContext.parallelize(heads, 1)).first()
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    body = records.join(F.broadcast(headers.select("file", "block", "number")), ["file", "block", "number"], "left_anti")
    fields = body.select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    parsed = materialize(fields)
    values = [F.col("r").getField(f"c{i}") for i in range(len(names))]
    return parsed.select(*[F.when(~v.isin(*NA_WORDS), v).alias(n) for v, n in zip(values, names, strict=True)])


def infer_csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Types of a CSV's columns from all of its values, in one aggregate.

    Unlike the reader's own inference a bare ``20:07:01`` stays text.
    """
    return _inferred(_csv_text(spark, path))


def _inferred(raw: DataFrame) -> T.StructType:
    fields: list[T.StructField] = []
    for group in chunks(raw.columns, 50):
        aggs = []
        for i, n in enumerate(group):
            c = col(n)
            aggs += [
                F.count(c).alias(f"n{i}"),
                F.count_if(c.rlike(_WHOLE) & c.try_cast("bigint").isNotNull()).alias(f"i{i}"),
                F.count_if(c.rlike(_NUMBER) & c.try_cast("double").isNotNull()).alias(f"d{i}"),
                F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}"),
                F.count_if(c.rlike(_DATE) & c.try_cast("date").isNotNull()).alias(f"t{i}"),
                F.count_if(c.rlike(_STAMP) & c.try_cast("timestamp_ntz").isNotNull()).alias(f"s{i}"),
            ]
        row = raw.agg(*aggs).first()
        for i, n in enumerate(group):
            size, dtype = row[f"n{i}"], T.StringType()
            if size:
                for letter, candidate in (
                    ("b", T.BooleanType()), ("i", T.LongType()), ("d", T.DoubleType()),
                    ("t", T.DateType()), ("s", T.TimestampNTZType()),
                ):
                    if row[f"{letter}{i}"] == size:
                        dtype = candidate
                        break
            fields.append(T.StructField(n, dtype))
    return T.StructType(fields)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet, or CSV with a header; a CSV without a schema gets an inferred one.

    Quoted fields may hold commas, doubled quotes and line breaks; NA words are null, as is a
    field that does not fit its column's type.
    """
    if path.rstrip("/").endswith(".csv"):
        raw = _csv_text(spark, path)
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        schema = schema or _inferred(raw)
        if len(schema) != len(raw.columns):
            raise ValueError(f"{path} has {len(raw.columns)} columns, the schema {len(schema)}")
        return raw.select(*[
            col(n).try_cast(f.dataType).alias(f.name) for n, f in zip(raw.columns, schema)
        ])
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder: ``path, length, modificationTime``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .load(folder)
        .select("path", "length", "modificationTime")
        .orderBy("path")
    )


def read_by_key(spark: SparkSession, key, catalog: dict, schema=None) -> DataFrame:
    """A table by its number or name in a catalog; an unknown key is an error."""
    known = {str(k): v for k, v in catalog.items()}
    if str(key) not in known:
        raise ValueError(f"unknown table {key}; choose between {', '.join(known)}")
    return read_table(spark, known[str(key)], schema)


def read_rename_map(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object column -> label, as a dictionary."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.from_json("value", "map<string,string>").alias("m")).first()
    if found is None or found["m"] is None:
        raise ValueError(f"{path} is not a JSON object")
    return dict(found["m"])
