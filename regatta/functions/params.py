"""Hyperparameter maps as JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_TYPE = "map<string,string>"


def to_text(params: Column) -> Column:
    return F.to_json(params)


def from_text(text: Column) -> Column:
    return F.from_json(text, MAP_TYPE)


def _literal_to_json(text: Column) -> Column:
    """Rewrite a Python-style literal (quotes, True/False/None, tuples) as JSON."""
    out = F.regexp_replace(text, "'", '"')
    out = F.regexp_replace(out, r"\bTrue\b", "true")
    out = F.regexp_replace(out, r"\bFalse\b", "false")
    out = F.regexp_replace(out, r"\bNone\b", "null")
    out = F.regexp_replace(out, r"\(", "[")
    out = F.regexp_replace(out, r",?\s*\)", "]")
    return out


def _is_json(text: Column) -> Column:
    """Whether a text is a JSON list, number or boolean."""
    scalar = F.trim(text).rlike(r"^(true|false|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)$")
    items = F.from_json(text, "array<string>")
    return scalar | (F.trim(text).startswith("[") & items.isNotNull())


def parse(text: Column) -> Column:
    """Lenient read: null gives an empty map, then JSON, then a Python literal, else raw.

    JSON that is no object (a list, a number) is read as ``value``.
    """
    empty = F.from_json(F.lit("{}"), MAP_TYPE)
    return F.when(text.isNull(), empty).otherwise(
        F.coalesce(
            from_text(text),
            from_text(_literal_to_json(text)),
            F.when(_is_json(text), F.create_map(F.lit("value"), text)),
            F.when(
                _is_json(_literal_to_json(text)),
                F.create_map(F.lit("value"), _literal_to_json(text)),
            ),
            F.create_map(F.lit("raw"), text),
        )
    )
