"""Benchmark passages in documents: Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item. A block is two words. The shift
table says how far the end of the search window may move for each block, the suffix buckets hold
the patterns that end in a block, and a direct comparison confirms each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from regatta.llm import common
from regatta.llm.schemas import arrow_schema
from regatta.session import materialize

WINDOW = 10
"""Words of a pattern; a shorter item is one pattern."""
BLOCK_WORDS = 500_000
"""Benchmark words that tasks hold at once; a larger benchmark is searched in several passes."""
LANE = 64
"""Places that one lane of the search walks through."""


def words_of(texts: list[str | None]) -> tuple[bytes, common.Words]:
    data, offsets = common.buffers(pa.array(texts, pa.string()))
    return data.tobytes(), common.Words(data, offsets, common.NOT_ALNUM)


def spelled(data: bytes, words: common.Words, first: int, width: int) -> bytes:
    """Consecutive words with A-Z lower-cased, with one space between them."""
    places = zip(words.start[first:first + width], words.end[first:first + width], strict=True)
    return b" ".join(data[a:b] for a, b in places).lower()


class Patterns:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, width: int, hashes: np.ndarray, spelled_out: list[bytes]):
        self.width, self.block = width, min(2, width)
        blocks = self.blocks(hashes.reshape(-1)).reshape(len(hashes), width)
        bits = max(12, int(32 * hashes.size).bit_length())
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, width - self.block + 1, np.int32)
        for last in range(self.block - 1, width):
            slots = (blocks[:, last] >> self.down).astype(np.int64)
            np.minimum.at(self.shift, slots, width - 1 - last)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix = blocks[order, -1]
        self.hashes = hashes[order]
        self.spelled = [spelled_out[i] for i in order.tolist()]
        self.names = order

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        """For each word a hash of the block that it ends."""
        if self.block == 1:
            return common.mixed(hashes)
        out = np.zeros(len(hashes), np.uint64)
        out[1:] = common.joined(hashes, 2)
        return out

    def search(self, words: common.Words, data: bytes) -> Iterator[tuple[int, int]]:
        """(pattern, first word) of every occurrence."""
        ends = words.first[1:]
        open_at = words.first[:-1] + self.width - 1
        counts = np.maximum(0, -((open_at - ends) // LANE))
        lane = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(open_at, counts) + lane * LANE
        stop = np.minimum(at + LANE, np.repeat(ends, counts))
        blocks = self.blocks(words.hash)
        slots = (blocks >> self.down).astype(np.int64)
        found = []
        while len(at):
            step = self.shift[slots[at]]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return
        at = np.concatenate(found)
        low = np.searchsorted(self.suffix, blocks[at], "left")
        size = np.searchsorted(self.suffix, blocks[at], "right") - low
        pattern = np.repeat(low, size) + np.arange(size.sum())
        pattern -= np.repeat(np.cumsum(size) - size, size)
        first = np.repeat(at, size) - self.width + 1
        for k in range(self.width):
            same = words.hash[first + k] == self.hashes[pattern, k]
            first, pattern = first[same], pattern[same]
        for one, place in zip(pattern.tolist(), first.tolist(), strict=True):
            if self.spelled[one] == spelled(data, words, place, self.width):
                yield int(self.names[one]), place


class Benchmark:
    """The patterns of some items by length, and the items of each pattern."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        data, words = words_of([text for _, text in items])
        found: dict[bytes, tuple[int, set[int]]] = {}
        for k, (item, _) in enumerate(items):
            first, last = int(words.first[k]), int(words.first[k + 1])
            width = min(window, last - first)
            for place in range(first, last - width + 1) if width else ():
                text = spelled(data, words, place, width)
                found.setdefault(text, (place, set()))[1].add(item)
        by_width: dict[int, list[tuple[bytes, int, set[int]]]] = {}
        for text, (place, names) in found.items():
            by_width.setdefault(text.count(b" ") + 1, []).append((text, place, names))
        self.parts = []
        for width, rows in sorted(by_width.items()):
            hashes = np.array([words.hash[p:p + width] for _, p, _ in rows], np.uint64)
            patterns = Patterns(width, hashes, [text for text, _, _ in rows])
            self.parts.append((patterns, [sorted(names) for _, _, names in rows]))

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """For each text: the number of words, the places of hit words, the items found."""
        bytes_, offsets = common.buffers(texts)
        words = common.Words(bytes_, offsets, common.NOT_ALNUM)
        data = bytes_.tobytes()
        marks = np.zeros(len(words.hash) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for patterns, names in self.parts:
            for pattern, place in patterns.search(words, data):
                marks[place] += 1
                marks[place + patterns.width] -= 1
                doc = int(np.searchsorted(words.first, place, "right")) - 1
                items.setdefault(doc, set()).update(names[pattern])
        hit = np.cumsum(marks[:-1]) > 0
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            yield int(b - a), np.flatnonzero(hit[a:b]), items.get(k, set())


_FOUND = "n_words long, hit_words array<long>, hit_items array<long>"


def _scan(docs: DataFrame, items: list[tuple[int, str]], text_col: str, window: int) -> DataFrame:
    """``docs`` with what the items hit, joined with what earlier passes found."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    keep = [c for c in docs.columns if c not in ("n_words", "hit_words", "hit_items")]
    again = "hit_words" in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(sent.value, window)
        schema = arrow_schema(_FOUND)
        for batch in batches:
            for part in common.chunks(batch, text_col):
                names = part.schema.names
                rows = list(benchmark.hits(part.column(names.index(text_col))))
                places, found = [r[1] for r in rows], [r[2] for r in rows]
                if again:
                    old = part.column(names.index("hit_words")).to_pylist()
                    places = [
                        np.union1d(p, o).astype(np.int64) for p, o in zip(places, old, strict=True)
                    ]
                    old = part.column(names.index("hit_items")).to_pylist()
                    found = [f.union(o) for f, o in zip(found, old, strict=True)]
                made = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(places, pa.list_(pa.int64())),
                    pa.array([sorted(f) for f in found], pa.list_(pa.int64())),
                ]
                kept = [part.column(names.index(c)) for c in keep]
                fields = [part.schema.field(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *made], schema=pa.schema([*fields, *schema])
                )

    shape = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    shape = shape.add("n_words", LongType())
    for name in ("hit_words", "hit_items"):
        shape = shape.add(name, ArrayType(LongType()))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(scan, shape)


def find_passages(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, the places of hit words and the ids of the items found.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.
    The documents are read once, without a shuffle, if the items hold at most ``block_words``
    words; more items are searched part by part, and a pass writes what the next one reads.
    A null or empty text has no words; items without an id, text or words take no part; an item
    of fewer words than the window is one pattern. Repeated items count once. Columns of
    ``docs`` are kept, but for those named like the results, which are replaced.
    """
    docs = docs.drop("n_words", "hit_words", "hit_items")
    known = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    known = known.where("id is not null and text is not null").distinct()
    size = F.greatest(F.lit(1), F.size(F.split("text", " ")))
    known = known.withColumn("size", size).sort("id", "text")
    total = known.agg(F.sum("size")).first()[0] or 0
    passes = -(-total // block_words) or 1
    for k in range(passes):
        part = F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k
        mine = known if passes == 1 else known.where(part)
        block = [(r.id, r.text) for r in mine.select("id", "text").collect()]
        docs = _scan(docs, block, text_col, window)
        if k + 1 < passes:
            docs = materialize(docs)
    return docs


def hit_digest(items: str = "hit_items") -> Column:
    """The item ids sorted as strings and comma-joined, as lowercase hex of their sha256."""
    names = F.sort_array(F.transform(F.col(items), lambda x: x.cast("string")))
    return F.sha2(F.array_join(names, ","), 256)

