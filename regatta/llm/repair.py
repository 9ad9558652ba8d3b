"""Token ids in grammar-compressed shards (Re-Pair).

A shard is a range of documents in ascending id order. Its blocks of whole documents are each
compressed by replacing id pairs with nonterminals, round by round, as long as a rule pays. A block stores the
rules, the expansion length of each nonterminal and the shortened sequence, so that any part of
a document can be read without expanding the rest.

The format is a Parquet table, one row for each block, which Spark's committer makes safe against
lost or repeated tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regatta.llm import common
from regatta.llm.tokenizing import encoder

BLOCK_IDS = 1 << 20
"""Ids in a block; the last document of a block may exceed it."""
MIN_USES = 4
"""A rule is stored as two symbols and a length no wider than a symbol, and each use of it saves a
symbol: pairs get a rule from four uses on, which always pays."""
FORMAT = (
    "shard int, block int, n_ids long, n_docs int, n_rules long, n_symbols long, first_rule long, "
    "bits int, length_bits int, doc_ids binary, doc_nulls binary, doc_starts binary, "
    "doc_symbols binary, rules binary, lengths binary, sequence binary"
)


class _Chain:
    """A sequence whose symbols keep their places while pairs of them become one.

    ``live`` marks the places whose pair may still be frequent. No pair ever gets more frequent
    unless a new symbol is in it, so only pairs found frequent and those beside a replacement are
    looked at again.
    """

    def __init__(self, ids: np.ndarray, end: int):
        n = len(ids)
        self.end = end
        self.symbol = ids.astype(np.int64)
        self.rounds = 0
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)  # one place more, behind the last symbol
        self.live = np.ones(n, bool)
        self.live[-1:] = False
        self.there = np.ones(n, bool)
        self.weight = np.zeros(n + 1, np.int64)  # that of place -1 is never set

    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that can become a frequent pair, ascending, with the weights and slots of the pairs.

        Weights order pairs by their uses and differ between pairs. Pairs are counted in slots by
        hash; one pair owns a slot, and others there wait for a round with other slots. Places of
        pairs found rare are no longer live.
        """
        at = np.flatnonzero(self.live)
        left, right = self.symbol[at], self.symbol[self.after[at]]
        free = (left != self.end) & (right != self.end)
        if not free.all():
            self.live[at[~free]] = False
            at, left, right = at[free], left[free], right[free]
        key = left << 32 | right
        bits = min(30, max(8, len(at).bit_length() - 1))
        self.rounds += 1
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * self.rounds + 1)) % (1 << 64) | 1)
        slot = (key.view(np.uint64) * factor >> np.uint64(64 - bits)).view(np.int64)
        owner = np.empty(1 << bits, np.int64)
        owner[slot] = key
        mine = owner[slot] == key
        use = mine.copy()
        use[self._odd_in_runs(at, left, np.flatnonzero(left == right))] = False
        times = np.bincount(slot[use], minlength=1 << bits)[slot]
        often = times >= MIN_USES
        self.live[at[mine & ~often]] = False
        use &= often
        slot = slot[use]
        return at[use], times[use] << 32 | slot, slot

    def _odd_in_runs(self, at: np.ndarray, left: np.ndarray, same: np.ndarray) -> np.ndarray:
        """In a run of one symbol every other place can become the pair; which of ``same`` cannot."""
        if not len(same):
            return same
        places, symbols = at[same], left[same]
        opens = np.flatnonzero(np.append(True, (self.after[places[:-1]] != places[1:]) | (symbols[1:] != symbols[:-1])))
        within = np.arange(len(same)) - np.repeat(opens, np.diff(np.append(opens, len(same))))
        return same[within % 2 == 1]

    def chosen(self, at: np.ndarray, weight: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places to replace, no two overlapping, each with the number of its pair.

        A pair that loses so many places to heavier ones that a rule would not pay waits for
        another round; the heaviest pair loses none.
        """
        self.weight[at] = weight
        taken = (weight >= self.weight[self.before[at]]) & (weight >= self.weight[self.after[at]])
        self.weight[at] = 0
        at, slot = at[taken], slot[taken]
        pays = np.bincount(slot) >= MIN_USES
        number = np.cumsum(pays) - 1
        kept = pays[slot]
        return at[kept], number[slot[kept]]

    def replace(self, at: np.ndarray, new: np.ndarray) -> None:
        gone = self.after[at]
        following = self.after[gone]
        self.symbol[at] = new
        self.after[at] = following
        self.before[following] = at
        self.there[gone] = False
        self.live[gone] = False
        self.live[at] = following < len(self.symbol)
        ahead = self.before[at]
        self.live[ahead[ahead >= 0]] = True


def compress(ids: np.ndarray, end: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """First nonterminal, rules (pairs), expansion lengths and the shortened sequence.

    Until no pair has uses enough to pay for a rule, a round replaces all frequent pairs together;
    where they overlap, the more frequent wins. No rule holds ``end``, so each document starts at a
    symbol.
    """
    first_rule = int(ids.max(initial=0)) + 1
    chain = _Chain(ids, end)
    rules, sizes = np.zeros((0, 2), np.int64), np.ones(first_rule, np.int64)
    while chain.live.any():
        found = chain.frequent()
        if not len(found[0]):
            continue
        at, number = chain.chosen(*found)
        pairs = np.zeros((int(number.max()) + 1, 2), np.int64)
        pairs[number, 0], pairs[number, 1] = chain.symbol[at], chain.symbol[chain.after[at]]
        chain.replace(at, len(sizes) + number)
        sizes = np.append(sizes, sizes[pairs[:, 0]] + sizes[pairs[:, 1]])
        rules = np.concatenate([rules, pairs])
    sequence = chain.symbol[chain.there].astype(np.uint32)
    return first_rule, rules.astype(np.uint32), sizes[first_rule:].astype(np.uint32), sequence


class Grammar:
    """The rules of a block and the lengths of what they stand for."""

    def __init__(self, first_rule: int, rules: np.ndarray, lengths: np.ndarray):
        self.first_rule, self.rules = first_rule, rules.reshape(-1, 2)
        self.lengths = lengths.astype(np.int64)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        of_rule = symbols >= self.first_rule
        out[of_rule] = self.lengths[symbols[of_rule] - self.first_rule]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of these symbols; the symbols of all rules of a depth are written together."""
        sizes = self.sizes(symbols)
        place = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        while len(symbols):
            of_rule = symbols >= self.first_rule
            out[place[~of_rule]] = symbols[~of_rule]
            pairs, place = self.rules[symbols[of_rule] - self.first_rule], place[of_rule]
            left, right = pairs[:, 0], pairs[:, 1]
            symbols = np.concatenate([left, right])
            place = np.concatenate([place, place + self.sizes(left)])
        return out


def _array(blob: bytes, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of all numbers, then one plane for each further bit."""
    planes = [np.packbits((values >> k & 1).astype(bool)).tobytes() for k in range(16, bits)]
    return b"".join([values.astype("<u2").tobytes(), *planes])


def _unpacked(blob: bytes, n: int, bits: int) -> np.ndarray:
    out = np.frombuffer(blob, "<u2", n).astype(np.uint32)
    size = -(-n // 8)
    for k in range(16, bits):
        plane = np.frombuffer(blob, np.uint8, size, 2 * n + (k - 16) * size)
        out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
    return out


def block_of(row: dict) -> tuple[Grammar, np.ndarray]:
    """Grammar and sequence of a stored block."""
    rules = _unpacked(row["rules"], 2 * row["n_rules"], row["bits"])
    lengths = _unpacked(row["lengths"], row["n_rules"], row["length_bits"])
    grammar = Grammar(row["first_rule"], rules, lengths)
    return grammar, _unpacked(row["sequence"], row["n_symbols"], row["bits"])


def read_part(row: dict, document: int, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids ``start`` up to ``start + length`` of one document of a stored block.

    Only the symbols that cover them are expanded; the expansion lengths say which these are.
    """
    grammar, sequence = block_of(row)
    a, b = _array(row["doc_symbols"], np.int64)[document:document + 2]
    symbols = sequence[a:b]
    sizes = grammar.sizes(symbols)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if length is None else min(total, start + length)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first = int(np.searchsorted(ends, start, "right"))
    last = int(np.searchsorted(ends, stop, "left")) + 1
    skip = start - int(ends[first] - sizes[first])
    return grammar.expand(symbols[first:last])[skip:skip + stop - start]


def _block_row(shard: int, block: int, doc_ids: list, docs: list[np.ndarray], end: int) -> dict:
    ids = np.concatenate(docs)
    first_rule, rules, lengths, sequence = compress(ids, end)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    symbols = np.concatenate([[0], np.flatnonzero(sequence == end) + 1]).astype(np.int64)
    if len(symbols) != len(starts):  # ``end`` also occurs inside a text
        sizes = Grammar(first_rule, rules, lengths).sizes(sequence)
        symbols = np.searchsorted(np.concatenate([[0], np.cumsum(sizes)]), starts)
    bits = (first_rule + len(rules)).bit_length()
    length_bits = int(lengths.max(initial=0)).bit_length()
    return {
        "shard": shard, "block": block, "n_ids": len(ids), "n_docs": len(docs),
        "n_rules": len(rules), "n_symbols": len(sequence), "first_rule": first_rule,
        "bits": bits, "length_bits": length_bits,
        "doc_ids": np.array([d or 0 for d in doc_ids], np.int64).tobytes(),
        "doc_nulls": np.array([d is None for d in doc_ids], bool).tobytes(),
        "doc_starts": starts.tobytes(), "doc_symbols": symbols.astype(np.int64).tobytes(),
        "rules": _packed(rules.ravel(), bits), "lengths": _packed(lengths, length_bits),
        "sequence": _packed(sequence, bits),
    }


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode ``docs`` and write them to ``folder`` in ascending id order.

    The rows are dealt by ranges of (id, text hash); a shard is one such range. Null ids come
    first, equal ids are ordered by text hash; a null text holds only ``end``; an empty table
    gives an empty folder of shards. Other columns are not read.
    """
    from regatta.llm.schemas import arrow_schema

    schema = arrow_schema(FORMAT)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, doc_ids, ids, waiting = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            made = _block_row(shard, block, doc_ids, ids, end)
            return pa.RecordBatch.from_pylist([made], schema=schema)

        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in common.chunks(batch, "text"):
                found = zip(part.column(0).to_pylist(), encode(part.column(1), end), strict=True)
                for doc_id, one in found:
                    doc_ids.append(doc_id)
                    ids.append(one)
                    waiting += len(one)
                    if waiting >= BLOCK_IDS:
                        yield row()
                        block, doc_ids, ids, waiting = block + 1, [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    dealt.select("id", "text").mapInArrow(shards, FORMAT).write.mode("overwrite").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each stored document: its place among all, its length and checksum of ids.

    ``start`` counts the ids of all documents before it: sums over whole shards, then over the
    blocks of a shard, then over the documents of a block.
    """
    from regatta.llm.schemas import arrow_schema

    out = "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(out)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar, sequence = block_of(row)
                ids = grammar.expand(sequence).astype("<u4")
                starts = _array(row["doc_starts"], np.int64)
                sums = [
                    zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)
                ]
                n = row["n_docs"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["shard"], np.int32)),
                    pa.array(np.full(n, row["block"], np.int32)),
                    pa.array(_array(row["doc_ids"], np.int64), mask=_array(row["doc_nulls"], bool)),
                    pa.array(starts[:-1]), pa.array(np.diff(starts)),
                    pa.array(np.array(sums, np.int64)),
                ], schema=schema)

    blocks = spark.read.schema(FORMAT).parquet(folder)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_at"))
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    places = sizes.join(shards, "shard").select(
        "shard", "block",
        (F.col("shard_at") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("block_at"),
    )
    return blocks.mapInArrow(documents, out).join(places, ["shard", "block"]).select(
        "doc_id", (F.col("block_at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
