"""Fill-in-middle forms of texts, cut at unit ranks through an indexable skip list.

A unit is a run of ASCII letters or one other code point. Cuts are drawn as ranks of units; the
skip list of a text turns a rank into a code point by going down its express lanes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import col
from regatta.llm import common

FAN = 16
"""Links of a lane that one link of the lane above spans."""

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

PLAIN_PERCENT = 10
"""Texts in a hundred that stay as they are."""
SUFFIX_FIRST_PERCENT = 20
"""Of the others, those in a hundred whose suffix comes first."""

RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("output", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class SkipList:
    """The units of one text under express lanes whose links carry both of their widths.

    A link of the lowest lane is one unit; a link of each lane above spans ``FAN`` links below.
    Its widths are the units and the code points that it passes.
    """

    def __init__(self, chars: np.ndarray, fan: int = FAN):
        self.fan, self.lanes = fan, [(np.ones(len(chars), np.int64), chars.astype(np.int64))]
        while len(self.lanes[-1][0]) > fan:
            units, points = self.lanes[-1]
            first = np.arange(0, len(units), fan)
            self.lanes.append((np.add.reduceat(units, first), np.add.reduceat(points, first)))

    def code_point(self, rank: int) -> int:
        """Code points before the unit of this rank; the number of units gives their total."""
        at = passed = point = 0
        for units, points in reversed(self.lanes):
            at *= self.fan
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                point += int(points[at])
                at += 1
        if passed != rank:
            raise IndexError(f"rank {rank} beyond {passed} units")
        return point


def unit_widths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each unit of consecutive UTF-8 texts, and the n + 1 first units of the texts."""
    lead = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    joined = np.zeros(len(data), bool)
    joined[1:] = letter[1:] & letter[:-1]
    joined[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    start = np.flatnonzero(lead & ~joined)
    before = np.concatenate([[0], np.cumsum(lead)])
    return np.diff(before[np.append(start, len(data))]), np.searchsorted(start, offsets)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id counts as empty text."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def formed(text: str, widths: np.ndarray, drawn: list[int], plain: int, suffix_first: int) -> tuple:
    """Form, output and the code points of prefix and middle of one text."""
    one, two, rare, turn = drawn
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or rare % 100 >= 100 - plain:
        return "plain", text, None, None
    n, units = len(widths), SkipList(widths)
    a, b = sorted(units.code_point(h % (n + 1)) for h in (one, two))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if turn % 100 < suffix_first:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
    plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """Every row with ``n`` units, ``form``, ``output``, ``prefix_chars`` and ``middle_chars``.

    All columns are kept, but those that have a name of the result. The form depends on the id
    and the text alone, so equal rows get equal results on any layout. A null text is empty; an
    empty text and one that holds a sentinel are plain, with null widths. A null id draws like
    empty text. A text is looked at as a whole, however long: a task holds about a mebibyte of
    texts or one longer text at a time. An empty table gives an empty table.
    """
    taken = {f.name.lower() for f in RESULT}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    schema = T.StructType([
        *(T.StructField(f"_{k}", f.dataType) for k, f in enumerate(kept)),
        *(T.StructField(f"_{len(kept) + k}", f.dataType) for k, f in enumerate(RESULT)),
    ])
    rows = docs.select(
        col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"),
        *(col(f.name).alias(f"_{k}") for k, f in enumerate(kept)),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text"):
                widths, first = unit_widths(*common.buffers(part.column(1)))
                limits = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                made = [
                    formed(text, widths[a:b], draws(doc_id, seed), plain_percent, suffix_first_percent)
                    for doc_id, text, (a, b) in zip(
                        part.column(0).to_pylist(), part.column(1).to_pylist(), limits, strict=True)
                ]
                columns = [
                    pa.array([b - a for a, b in limits], pa.int64()),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.string()),
                    pa.array([m[2] for m in made], pa.int64()),
                    pa.array([m[3] for m in made], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *columns], names=schema.names)

    names = [*(f.name for f in kept), *RESULT.names]
    return rows.mapInArrow(run, schema).toDF(*names)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from; exact, since no part of it holds a sentinel."""
    parts = F.split(output, "<[PSM]>")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
