"""Hierarchical packing of tokenized documents into windows of several context sizes.

A document gives full longest windows first; its rest goes to the smallest tier that holds it.
Tiers are packed from long to short: a window opens with a piece of its tier, and its gap is
filled with whole pieces of shorter tiers, then with a cut of the shortest one left. All windows
of a task are full but those of its last few ids.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm import common
from regatta.llm.schemas import arrow_schema
from regatta.llm.tokenizing import encoder

TIERS = (2048, 1024, 512, 256, 128, 64)
STEP_IDS = 32_768
"""Ids of a step group, which holds windows of one tier."""
POOL_IDS = 1 << 20
"""Ids a task gathers before it packs them; what fits no full window waits for the next lot."""

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_id long"
)

Piece = tuple[int, int, int]
"""Document, first id and length."""


class Pool:
    """Pieces by tier: a piece is in the smallest tier that holds it."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting: dict[int, deque[Piece]] = {t: deque() for t in self.tiers}

    def add(self, piece: Piece) -> None:
        tier = next(t for t in reversed(self.tiers) if piece[2] <= t)
        self.waiting[tier].append(piece)

    def take(self, room: int) -> Piece | None:
        """A piece of at most ``room`` ids: a long whole one if there is any, else a cut."""
        for tier in self.tiers:
            if tier <= room and self.waiting[tier]:
                return self.waiting[tier].popleft()
        for tier in reversed(self.tiers):
            if self.waiting[tier]:
                doc, start, length = self.waiting[tier].popleft()
                if length > room:
                    self.add((doc, start + room, length - room))
                    length = room
                return doc, start, length
        return None

    def windows(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, longest tier first; the pieces of an unfinished one go back."""
        for tier in self.tiers:
            while self.waiting[tier]:
                pieces = [self.waiting[tier].popleft()]
                room = tier - pieces[0][2]
                while room and (piece := self.take(room)):
                    pieces.append(piece)
                    room -= piece[2]
                if room:
                    for piece in pieces:
                        self.add(piece)
                    return
                yield tier, pieces

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left as full windows of ever shorter tiers and one padded window."""
        for tier in self.tiers:
            left = sum(p[2] for q in self.waiting.values() for p in q)
            while left >= tier:
                pieces, room = [], tier
                while room:
                    piece = self.take(room)
                    pieces.append(piece)
                    room -= piece[2]
                left -= tier
                yield tier, pieces
        pieces = [p for q in self.waiting.values() for p in q]
        if pieces:
            yield self.tiers[0], pieces


def steps(windows: list[list[Piece]], tier: int, step_ids: int = STEP_IDS) -> list[int]:
    """A step group for each window of a tier, so that groups have like attention cost.

    The cost of a window is the sum of squared piece lengths; windows are dealt to the groups
    from the costliest, back and forth.
    """
    each = max(1, step_ids // tier)
    n = max(1, -(-len(windows) // each))
    cost = np.array([sum(p[2] ** 2 for p in pieces) for pieces in windows])
    place = np.empty(len(windows), np.int64)
    place[np.argsort(-cost, kind="stable")] = np.arange(len(windows))
    turn, at = np.divmod(place, n)
    return np.where(turn % 2 == 0, at, n - 1 - at).tolist()


class _Task:
    """One task's documents on their way into windows."""

    def __init__(self, tiers: tuple[int, ...], step_ids: int):
        self.pool, self.step_ids = Pool(tiers), step_ids
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.count = self.step = self.held = self.seen = 0
        self.base = TaskContext.get().partitionId() << 40
        self.schema = arrow_schema(PIECES)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs[self.seen] = (doc_id, ids)
        whole = len(ids) - len(ids) % self.pool.tiers[0]
        for at in range(0, whole, self.pool.tiers[0]):
            self.pool.add((self.seen, at, self.pool.tiers[0]))
        if len(ids) > whole:
            self.pool.add((self.seen, whole, len(ids) - whole))
        self.seen += 1
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        done = list(self.pool.windows())
        if last:
            done += self.pool.rest()
        by_tier: dict[int, list[list[Piece]]] = {}
        for tier, pieces in done:
            by_tier.setdefault(tier, []).append(pieces)
        rows = []
        for tier, windows in by_tier.items():
            groups = steps(windows, tier, self.step_ids)
            for pieces, group in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = self.docs[doc]
                    crc = zlib.crc32(ids[start:start + length].astype("<u4", copy=False))
                    rows.append((
                        doc_id, start, length, crc, len(ids), self.base + self.count, offset,
                        tier, self.base + self.step + group,
                    ))
                    offset += length
                self.count += 1
            self.step += max(groups, default=-1) + 1
        kept = {p[0] for q in self.pool.waiting.values() for p in q} if not last else set()
        self.docs = {k: self.docs[k] for k in kept}
        self.held = 0
        columns = zip(*rows, strict=True) if rows else [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)],
            schema=self.schema,
        )


def pack(
    docs: DataFrame, tokenizer: str, end: int = 1, tiers: tuple[int, ...] = TIERS,
    step_ids: int = STEP_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document in a window, with its step group.

    Each task packs the rows it reads, without a shuffle; a lost task packs the same rows again
    the same way. A window whose length is no tier is padded to the longest tier; there is at
    most one in a task. A null or empty text is the id ``end`` alone. Rows with equal or null
    ids are separate documents. Other columns are not read; an empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = _Task(tuple(tiers), step_ids), encoder(tokenizer).encode
        for batch in batches:
            for part in common.chunks(batch, "text"):
                found = encode(part.column(1), end)
                for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    task.add(doc_id, ids)
                    if task.held >= POOL_IDS:
                        yield task.flush(False)
        yield task.flush(True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, PIECES)
