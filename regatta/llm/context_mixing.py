"""Texts scored by online logistic mixing of hashed-context bit predictors.

A text is its words, lower-cased and joined by one space, and an end byte. Bytes are coded by a
binary tree (Huffman's, of the corpus), so a text is a row of bits. For each context, such as
the two bytes before, a predictor knows from the corpus how often a tree node went either way.
Their log odds are mixed with weights that a gate selects and that follow the text as it goes;
an adaptive map refines the mixed probability. The scores are whole log probabilities: each bit
is predicted from what comes before it alone.

A text is walked through in segments that all start from the same weights. Weights and map are
brought up to date after every few bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm import common
from regatta.llm.schemas import arrow_schema
from regatta.session import materialize

ROWS = (1 << 8, 1 << 14, 1 << 17, 1 << 17)
"""Hashed contexts of each predictor: one, two and four bytes before, the word so far."""
COLUMNS = 64
"""Frequent bytes, and frequent tree nodes, that a context tells apart; the last is for the rest."""
CELLS = COLUMNS * sum(ROWS)
"""Counts that training keeps, whatever the size of the corpus."""
END = 10
SEGMENT, STEP = 1024, 16
"""Bytes of a segment, and after how many of them weights are brought up to date."""
GATES = 4
RATE, MAP_RATE, FIRST_WEIGHTS, SMOOTH = 0.03, 0.02, (0.05, 0.1, 0.4, 0.5), 0.2
MAP_CELLS = 24
_SCALE = 16.0
"""Log odds are kept in sixteenths, from -8 to 8."""
CHUNK_BYTES = 1 << 18
"""Text that a task scores in one go; more lanes take more memory, and leave the processor's cache."""
COUNT_BYTES = 1 << 16
"""Text that a task counts in one go; its arrays stay in the processor's cache."""
BLOCK_TOKENS = 1 << 19
BUCKET_WORDS = 1 << 20
"""Distinct words of a bucket, about."""
_SLICE = 1 << 18

SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, "
    "n_bytes long"
)
SENT = "block long, bucket int, kind int, payload binary"


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, common.Words]:
    """The byte strings that are scored, one after the other, their limits, and their words."""
    data, offsets = common.buffers(column)
    return *_joined(data, offsets), common.Words(data, offsets)


_WRITTEN = np.arange(256, dtype=np.uint8)
_WRITTEN[65:91] += 32
_WRITTEN[common.WHITE] = 32


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings that are scored and their limits."""
    data = np.insert(data, offsets[1:], 32)  # a separator after each text
    last = offsets[1:] + np.arange(len(offsets) - 1)
    gap = common.WHITE[data]
    kept = ~gap
    kept[1:] |= ~gap[:-1]
    sizes = np.add.reduceat(kept, np.concatenate([[0], last[:-1] + 1]), dtype=np.int64) if len(last) else last
    empty = sizes == 0
    kept[last[empty]] = True
    sizes[empty] = 1
    limits = np.concatenate([[0], np.cumsum(sizes)])
    out = _WRITTEN[data[kept]]
    out[limits[1:] - 1] = END
    return out, limits


def context_rows(text: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
    """For each byte the row of each predictor's context."""
    n, first = len(text), limits[:-1]
    near = np.zeros((4, n), np.uint32)
    for k in range(1, 5):
        near[k - 1, k:] = text[:-k]
        for j in range(k):
            near[k - 1, first[first + j < limits[1:]] + j] = 0
    two = near[0] | near[1] << np.uint32(8)
    four = two | near[2] << np.uint32(16) | near[3] << np.uint32(24)
    opens = near[0] == 32
    opens[first] = True
    word = common.prefix_hashes(text, np.flatnonzero(opens))
    factor = np.uint32(2654435761)
    return [
        near[0].astype(np.int64), ((two * factor) >> np.uint32(18)).astype(np.int64),
        ((four * factor) >> np.uint32(15)).astype(np.int64), (word >> np.uint64(47)).astype(np.int64),
    ]


class Code:
    """A binary tree over all byte values: inner nodes and turns on the way to each byte."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (n + m, 256 + len(children)))
            children.append((a, b))
        paths: dict[int, list[tuple[int, int]]] = {heap[0][1]: []}
        for node in range(255 + len(children), 255, -1):
            for turn, child in enumerate(children[node - 256]):
                paths[child] = [*paths[node], (node - 256, turn)]
        self.sizes = np.array([len(paths[k]) for k in range(256)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = [x for k in range(256) for x in paths[k]]
        self.nodes = np.array([x[0] for x in flat], np.int64)
        self.turns = np.array([x[1] for x in flat], np.float32)
        self.gates = np.minimum(np.concatenate([np.arange(s) for s in self.sizes]), GATES - 1)
        self.children = children
        self.columns = self._ranked(np.arange(len(children))[::-1])
        self.classes = self._ranked(np.argsort(-counts, kind="stable"))
        weight = counts + 1.0
        self.share = weight / np.bincount(self.classes, weight)[self.classes]
        self.columns_of_events = self.columns[self.nodes]

    @staticmethod
    def _ranked(order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.minimum(np.arange(len(order)), COLUMNS - 1)
        return out

    def node_counts(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From counts of bytes (rows x 256): how often each node was left for turn 0 and 1."""
        total = np.zeros((len(counts), 256 + len(self.children)), np.float32)
        total[:, :256] = counts
        for k, (a, b) in enumerate(self.children):
            total[:, 256 + k] = total[:, a] + total[:, b]
        first, second = np.array(self.children).T
        return total[:, first], total[:, second]

    def odds(self, counts: np.ndarray) -> np.ndarray:
        """Scaled log odds by column from counts by class (rows x columns); 0 in the last."""
        low, high = self.node_counts(counts[:, self.classes] * self.share)
        found = np.rint(_SCALE * np.log((high + SMOOTH) / (low + SMOOTH)))
        out = np.zeros((len(counts), COLUMNS), np.int8)
        own = self.columns < COLUMNS - 1
        out[:, self.columns[own]] = np.clip(found[:, own], -127, 127)
        return out


@dataclass
class Model:
    code: Code
    tables: list[np.ndarray]
    """For each predictor the log odds of turn 1, by context row and node column."""

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, common.Words]:
        """log10 probability of each text, bytes scored, and the words."""
        text, limits, words = joined_bytes(column)
        bits = self._bits(text, limits)
        return -bits * np.log10(2), np.diff(limits), words

    def _bits(self, text: np.ndarray, limits: np.ndarray) -> np.ndarray:
        sizes = np.diff(limits)
        place = np.arange(len(text)) - np.repeat(limits[:-1], sizes)
        opens = np.flatnonzero(place % SEGMENT == 0)
        lane = np.cumsum(place % SEGMENT == 0) - 1
        step = (place % SEGMENT // STEP).astype(np.int16)
        del place
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(SEGMENT // STEP + 1))
        rows = [np.take(row * COLUMNS, order) for row in context_rows(text, limits)]
        text, lane = text[order], lane[order]
        sizes_of, starts_of = self.code.sizes[text], self.code.starts[text]
        state = _Lanes(len(opens))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                break
            size = sizes_of[a:b]
            ends = np.cumsum(size)
            event = np.arange(ends[-1])
            event += np.repeat(starts_of[a:b] - ends + size, size)
            column = np.take(self.code.columns_of_events, event, mode="clip")
            odds = np.empty((len(rows), len(column)), np.float32)
            byte = np.repeat(np.arange(b - a), size)
            for one, row, table in zip(odds, rows, self.tables, strict=True):
                cell = np.take(row[a:b], byte, mode="clip")
                cell += column
                one[:] = np.take(table, cell, mode="clip")
            odds *= np.float32(1 / _SCALE)
            lanes = np.take(lane[a:b], byte, mode="clip")
            key = lanes * GATES
            key += np.take(self.code.gates, event, mode="clip")
            state.learn(lanes, key, odds, np.take(self.code.turns, event, mode="clip"))
        document = np.searchsorted(limits, opens, "right") - 1
        return np.bincount(document, state.nats, len(sizes)) / np.log(2)


class _Lanes:
    """The mixers of segments that are walked through side by side."""

    def __init__(self, n: int):
        self.weights = np.repeat(np.array(FIRST_WEIGHTS, np.float32)[:, None], n * GATES, axis=1)
        start = 1 / (1 + np.exp(-(np.arange(MAP_CELLS) - MAP_CELLS / 2) / 2))
        self.map = np.tile(start.astype(np.float32), n)
        self.nats = np.zeros(n)
        self.n = n

    def learn(self, lane: np.ndarray, key: np.ndarray, odds: np.ndarray, turn: np.ndarray) -> None:
        """Code some bits with the present weights, then follow them."""
        mixed = np.take(self.weights[0], key, mode="clip")
        mixed *= odds[0]
        for weights, one in zip(self.weights[1:], odds[1:], strict=True):
            part = np.take(weights, key, mode="clip")
            part *= one
            mixed += part
        np.clip(mixed, -15, 15, out=mixed)
        p = np.negative(mixed)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        mixed *= 2
        mixed += np.float32(MAP_CELLS / 2 + 0.5)
        cell = np.clip(mixed, 0, MAP_CELLS - 1, out=mixed).astype(np.int64)
        cell += lane * MAP_CELLS
        mapped = np.take(self.map, cell, mode="clip")
        said = p + mapped  # the refined probability, then the logarithm of the bit's own
        said /= 2
        np.clip(said, 1e-5, 1 - 1e-5, out=said)
        np.subtract(turn, said, out=said)
        np.abs(said, out=said)
        np.subtract(1, said, out=said)
        np.log(said, out=said)
        self.nats -= np.bincount(lane, said, self.n)
        error = np.subtract(turn, p, out=p)
        for weights, one in zip(self.weights, odds, strict=True):
            one *= error
            weights += np.float32(RATE) * np.bincount(key, one, self.n * GATES).astype(np.float32)
        moved = np.bincount(cell, turn - mapped, self.n * MAP_CELLS)
        self.map += np.float32(MAP_RATE) * moved.astype(np.float32)


def _byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte occurs, A-Z counted as a-z."""
    shape = "byte int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            counts += np.bincount(data, minlength=256)
            counts[END] += len(offsets) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(256, dtype=np.int32)), pa.array(counts)], schema=arrow_schema(shape)
        )

    counts = np.zeros(256, np.int64)
    found = docs.select("text").mapInArrow(count, shape)
    for row in found.groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[row["byte"]] = row["n"]
    counts[97:123] += counts[65:91]
    counts[65:91] = 0
    return counts


COUNTS = "slice int, cells binary, counts binary"


def _cells(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """How often each class of bytes followed each context row, over the rows to learn from.

    A row has the counts that a task found in a slice of cells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, one = np.zeros(CELLS, np.int32), np.int32(1)
        seen = 0

        def found() -> Iterator[pa.RecordBatch]:
            for k in range(0, CELLS, _SLICE):
                part = counts[k:k + _SLICE]
                cells = np.flatnonzero(part)
                if len(cells):
                    payload = [[_planes(x)] for x in (np.diff(cells, prepend=0), part[cells])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k // _SLICE], pa.int32()), *(pa.array(x, pa.binary()) for x in payload)
                    ], schema=arrow_schema(COUNTS))
            counts[:] = 0

        for batch in batches:
            for part in common.chunks(batch, "text", COUNT_BYTES):
                text, limits = _joined(*common.buffers(part.column(0)))
                known, base = classes[text], 0
                for size, rows in zip(ROWS, context_rows(text, limits), strict=True):
                    np.add.at(counts[base:base + size * COLUMNS], rows * COLUMNS + known, one)
                    base += size * COLUMNS
                seen += len(text)
                if seen >= 1 << 30:
                    yield from found()
                    seen = 0
        yield from found()

    return docs.select("text").mapInArrow(count, COUNTS)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, first the lowest byte of each, then the next."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def train(docs: DataFrame) -> Model:
    """Predictors from all rows of (text); an empty table gives even odds everywhere.

    Counts are summed and the odds are worked out slice by slice on executors, and only the odds,
    a byte for each cell, reach the driver.
    """
    code = Code(_byte_counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast(code)
    shape = "slice int, odds binary"

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, part = np.zeros(_SLICE, np.int64), None
        for batch in batches:
            for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dense[np.cumsum(_numbers(cells), dtype=np.int64)] += _numbers(counts)
        found = sent.value.odds(dense.astype(np.float32).reshape(-1, COLUMNS)).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([found], pa.binary())], schema=arrow_schema(shape)
        )

    flat = np.zeros(-(-CELLS // _SLICE) * _SLICE, np.int8)
    for row in _cells(docs, code.classes).groupBy("slice").applyInArrow(odds, shape).collect():
        flat[row["slice"] * _SLICE:(row["slice"] + 1) * _SLICE] = np.frombuffer(row["odds"], np.int8)
    limits = COLUMNS * np.concatenate([[0], np.cumsum(ROWS)])
    return Model(code, [flat[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)])


def _arrays(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], "<u8")
    return b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)])


def _read(payload: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(payload, "<u8", len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(payload, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


_ABOUT = "<i8", "?", "?", "<i8", "<f8", "<i8", "<u4"


class _Block:
    """Scored documents and their words, on their way to the buckets."""

    def __init__(self) -> None:
        self.ids, self.held, self.sizes, self.scores, self.bytes, self.words = [], [], [], [], [], []
        self.size = 0

    def rows(self, block: int, bits: int) -> pa.RecordBatch:
        words = np.concatenate(self.words)
        keys, which = np.unique(words, return_inverse=True)
        sizes, held = np.array(self.sizes, np.int64), np.array(self.held, bool)
        learned = np.bincount(which, weights=np.repeat(~held, sizes), minlength=len(keys)).astype("<u4")
        limits = np.array([k << (64 - bits) for k in range(1, 1 << bits)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
        about = _arrays(
            np.array([i or 0 for i in self.ids], "<i8"), np.array([i is None for i in self.ids], bool),
            held, sizes.astype("<i8"), np.array(self.scores, "<f8"), np.array(self.bytes, "<i8"),
            which.astype("<u4"),
        )
        rows = [(block, -1, 0, about)]
        for k in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[k], at[k + 1])
            planes = np.ascontiguousarray(keys[part].astype("<u8").view(np.uint8).reshape(-1, 8).T)
            rows.append((block, k, 1, _arrays(planes.reshape(-1), learned[part])))
        schema = arrow_schema(SENT)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )


def _counted(table: pa.Table) -> pa.Table:
    """For each block how often its words of a bucket were learned from, and the number of words."""
    schema = arrow_schema(SENT)
    if table.num_rows == 0 or table["kind"][0].as_py() == 0:
        return table.cast(schema)
    parts = [_read(p, "u1", "<u4") for p in table["payload"].to_pylist()]
    keys = np.concatenate([
        np.ascontiguousarray(p[0].reshape(8, -1).T).reshape(-1).view("<u8") for p in parts
    ])
    every, which = np.unique(keys, return_inverse=True)
    counts = np.bincount(which, np.concatenate([p[1] for p in parts]), len(every)).astype("<i8")
    at = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])
    bucket = table["bucket"][0].as_py()
    rows = [(-1, bucket, 3, _arrays(np.array([np.count_nonzero(counts)], "<i8")))]
    for block, a, b in zip(table["block"].to_pylist(), at[:-1], at[1:], strict=True):
        rows.append((block, bucket, 2, _arrays(counts[which[a:b]])))
    return pa.table(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _gather(table: pa.Table) -> pa.Table:
    """The documents of a block, with sums of log10(c + 0.1) over their tokens but the end."""
    schema = arrow_schema(SCORES)
    rows = sorted(zip(*(table[c].to_pylist() for c in ("bucket", "payload")), strict=True), key=lambda r: r[0])
    ids, nulls, held, sizes, scores, n_bytes, which = _read(rows[0][1], *_ABOUT)
    counts = np.concatenate([np.zeros(0, "<i8"), *(_read(p, "<i8")[0] for _, p in rows[1:])])
    c = counts[which]
    document = np.repeat(np.arange(len(sizes)), sizes)
    known = np.bincount(document, c > 0, len(sizes)).astype(np.int64)
    sums = np.bincount(document, np.log10(c + 0.1), len(sizes))
    return pa.table([
        pa.array(ids, mask=nulls), pa.array(held), pa.array(sizes + 1), pa.array(known),
        pa.array(sums), pa.array(scores), pa.array(n_bytes),
    ], schema=schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of (doc_id, held_out, text) with token counts, base score and the model's score.

    Tokens are words (A-Z lower-cased) and one end. The base score is a sum of smoothed unigram
    log10 probabilities from the rows that are not held out; the score is the model's log10
    probability of the words and the end, of ``n_bytes`` bytes. Texts are read once: blocks of
    documents send their distinct words to buckets by hash, and the counts come back to the
    blocks. A null text has the end alone; rows with equal or null ids are scored apart.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = min(16, max(4, int(chars / 24 / BUCKET_WORDS).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                scores, n_bytes, words = sent.value.score(part.column(2))
                block.ids += part.column(0).to_pylist()
                block.held += part.column(1).to_pylist()
                block.sizes += np.diff(words.first).tolist()
                block.scores += scores.tolist()
                block.bytes += n_bytes.tolist()
                block.words.append(words.hash)
                block.size += len(words.hash)
                if block.size >= BLOCK_TOKENS:
                    yield block.rows(number, bits)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.rows(number, bits)

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(send, SENT)
    own = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.lit(0).cast("long")).alias("own")
    counted = materialize(rows.groupBy("bucket", own).applyInArrow(_counted, SENT))
    words = 0
    for row in counted.where("kind = 3").select("payload").toLocalIterator():
        words += int(_read(row["payload"], "<i8")[0][0])
    found = materialize(counted.where("kind <> 3").groupBy("block").applyInArrow(_gather, SCORES))
    learned = found.where(~F.col("held_out")).agg(
        F.count("*").alias("ends"), F.sum("n_tokens").alias("tokens")
    ).first()
    ends, tokens = learned["ends"], learned["tokens"] or 0
    kinds = words + (ends > 0)
    below = float(np.log10(tokens + 0.1 * (kinds + 1)))
    base = F.col("base_sum") + float(np.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(below)
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        "n_bytes", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
