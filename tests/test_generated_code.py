"""Generated methods of more than 8000 bytes are never compiled by the JVM and run many times slower."""

import re

import pytest

from regatta.workload import queries

COMPILED = 8000


def largest_method(df) -> int:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)), default=0)


@pytest.mark.parametrize("table", [queries.model_table, queries.stump_table])
def test_split_rows_are_read_by_compiled_code(spark, sf, table):
    t = table(spark, sf)
    assert largest_method(t.train) < COMPILED
    assert largest_method(t.train.where("fold = 1")) < COMPILED
