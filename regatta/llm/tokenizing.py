"""Texts to ids with a ``tokenizers`` file, each distinct piece of text encoded once."""

from __future__ import annotations

import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from regatta.llm import common  # noqa: E402

KNOWN_PIECES = 1_500_000
"""Pieces whose ids a worker remembers, about 30 bytes each."""

_SPACE = common.WHITE | (np.arange(256) >= 28) & (np.arange(256) <= 31)
_ALNUM = ~common.NOT_ALNUM & (np.arange(256) < 128)
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_WIDE_SPACE = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


def _before(data: np.ndarray, back: int) -> np.ndarray:
    """The byte ``back`` places before each one; 0 where there is none."""
    out = np.zeros_like(data)
    out[back:] = data[:len(data) - back]
    return out


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places where a byte-level pre-tokenizer surely starts a new token.

    These are the start of white space after a character that is none, the end of a single line
    break before such a character, and a mark after a letter or digit. Where a character beyond
    ASCII might be a space or a symbol, there is no cut.
    """
    one, two, three = (_before(data, k) for k in (1, 2, 3))
    space, space_one = _SPACE[data], _SPACE[one]
    solid = ~space_one & ((one < 128) | (two != 0xC2) & ~_WIDE_SPACE[three])
    opens = space & solid
    lone = _before(opens.view(np.uint8), 1).astype(bool) & (one == 10)
    latin = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    return opens | lone & (data < 128) & ~space | _MARK[data] & (_ALNUM[one] | latin)


class _Known:
    """Ids of pieces by hash: a large sorted part and a small one of late arrivals."""

    def __init__(self) -> None:
        self.keys = self.new_keys = np.zeros(0, np.uint64)
        self.rows = self.new_rows = np.zeros(0, np.int64)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _find(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, rows[at], -1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of sorted hashes, -1 for unknown ones."""
        found = self._find(self.keys, self.rows, wanted)
        lost = np.flatnonzero(found < 0)
        found[lost] = self._find(self.new_keys, self.new_rows, wanted[lost])
        return found

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        rows = np.arange(len(keys)) + len(self.starts) - 1
        sizes = np.cumsum([len(x) for x in ids]) + self.starts[-1]
        self.starts = np.concatenate([self.starts, sizes])
        added = np.fromiter((i for x in ids for i in x), np.uint32)
        self.flat = np.concatenate([self.flat, added])
        keys = np.concatenate([self.new_keys, keys])
        order = np.argsort(keys)
        self.new_keys, self.new_rows = keys[order], np.concatenate([self.new_rows, rows])[order]
        if len(self.new_keys) > 20_000 + len(self.keys) // 8:
            keys = np.concatenate([self.keys, self.new_keys])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, self.new_rows])[order]
            self.new_keys, self.new_rows = keys[:0], self.rows[:0]
        return rows


class PieceEncoder:
    """Encodes whole texts; the strings of special tokens in a text are ordinary text.

    A byte-level pre-tokenizer never joins characters across certain places, so a text may be
    cut there and its pieces encoded apart. Natural text repeats such pieces; their ids are
    kept by a 64-bit hash and length. With another pre-tokenizer a text is one piece.
    """

    def __init__(self, path: str, known_pieces: int = KNOWN_PIECES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = json.load(file).get("pre_tokenizer") or {}
        self.cuts = (
            kind.get("type") == "ByteLevel"
            and kind.get("use_regex", True)
            and not kind.get("add_prefix_space")
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known_pieces, self.known = known_pieces, _Known()

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each piece the row of its ids; pieces not met before are encoded."""
        hashes = common.spans_hash(data, start, end)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known.starts) + len(keys) > self.known_pieces:
            self.known = _Known()
        rows = self.known.find(keys)
        lost = np.flatnonzero(rows < 0)
        text = data.tobytes()
        new = [text[start[k]:end[k]].decode() for k in first[lost].tolist()]
        ids: list[list[int]] = []
        for at in range(0, len(new), 1024):
            ids += [
                x.ids for x in
                self.tokenizer.encode_batch_fast(new[at:at + 1024], add_special_tokens=False)
            ]
        if new:
            rows[lost] = self.known.add(keys[lost], ids)
        return rows[which]

    def encode(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end`` after them; null is empty."""
        data, offsets = common.buffers(texts)
        cut = safe_cuts(data) if self.cuts else np.zeros(len(data), bool)
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[filled] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(data))
        rows = self._rows(data, start, stop) if len(start) else np.zeros(0, np.int64)
        known = self.known
        sizes = known.starts[rows + 1] - known.starts[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(known.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])
        ids = known.flat[places]
        limits = ends[np.searchsorted(start, offsets)]
        if end is not None:
            ids = np.insert(ids, limits[1:], np.uint32(end))
            limits = limits + np.arange(len(limits))
        return [ids[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
