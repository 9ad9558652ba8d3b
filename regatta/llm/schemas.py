"""Arrow schemas of DDL strings."""

from __future__ import annotations

import pyarrow as pa

_KINDS = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as ``a int, b string``."""
    return pa.schema([
        (name, _KINDS[kind]) for name, kind in (x.strip().split(" ", 1) for x in ddl.split(","))
    ])
