"""Toxicity by two Kneser-Ney models of spelling, one for each label.

A word is spelled between a start and an end sign, and a letter is predicted from the letters
before it in its word. The longest context counts per class; shorter ones are backoff counts
shared by both classes, over distinct words, so that a rare expression says little about the
label. A text is scored by the difference of the two log-likelihoods divided by its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm import common
from regatta.llm.schemas import arrow_schema
from regatta.session import materialize

ORDER = 4
DISCOUNT = 0.75
FIT_ROWS = 20_000
"""Labelled rows that the classifier is fitted on, at most; chosen by a hash of the id."""
LONGEST_WORD = 64
"""Bytes of a word that are one expression; a longer word is several, cut at this length."""
_START, _END = 1, 2
_SALT = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, 33)]


def _spelling(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Signed spellings one after the other, and for each predicted sign its word and place."""
    sizes = end - start + 2
    edges = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(start)), sizes)
    place = np.arange(edges[-1]) - edges[word]
    spelled = np.full(edges[-1], _START, np.uint8)
    inner = (place > 0) & (place < sizes[word] - 1)
    spelled[inner] = data[(start[word] + place - 1)[inner]]
    upper = (spelled >= 65) & (spelled <= 90)
    spelled[upper] += 32
    spelled[edges[1:] - 1] = _END
    at = np.flatnonzero(place > 0)
    return spelled, at, word[at], place[at]


def _grams(spelled: np.ndarray, at: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Where a sign has k - 1 signs before it: those places, the gram and its context."""
    there = place >= k - 1
    at = at[there]
    salt = _SALT[k]
    gram = common.spans_hash(spelled, at - (k - 1), at + 1) ^ salt
    context = common.spans_hash(spelled, at - (k - 1), at) ^ salt
    return there, gram, context


def _expressions(column: pa.Array) -> tuple[np.ndarray, common.Words, np.ndarray, np.ndarray]:
    """The words of texts, with words of more than ``LONGEST_WORD`` bytes cut."""
    data, offsets = common.buffers(column)
    words = common.Words(data, offsets, common.NOT_ALNUM)
    size = words.end - words.start
    parts = np.maximum(1, -(-size // LONGEST_WORD))
    if (parts == 1).all():
        return data, words, words.start, words.end
    word = np.repeat(np.arange(len(size)), parts)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = words.start[word] + turn * LONGEST_WORD
    end = np.minimum(start + LONGEST_WORD, words.end[word])
    words.start, words.end = start, end
    words.first = np.concatenate([[0], np.cumsum(parts)])[words.first]
    words.hash = common.spans_hash(data, start, end, common.LOWER)
    return data, words, start, end


@dataclass
class _Level:
    """Sorted grams of one length with log probabilities, and contexts with backoff weights."""

    grams: np.ndarray
    gram_share: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def of(gram: np.ndarray, context: np.ndarray, count: np.ndarray, discount: float) -> _Level:
        """Discounted shares of grams in their contexts; count is summed by gram."""
        grams, first, which = np.unique(gram, return_index=True, return_inverse=True)
        counts = np.bincount(which, weights=count, minlength=len(grams))
        seen = counts > 0
        grams, counts, parents = grams[seen], counts[seen], context[first][seen]
        contexts, parent = np.unique(parents, return_inverse=True)
        total = np.bincount(parent, weights=counts, minlength=len(contexts))
        kinds = np.bincount(parent, minlength=len(contexts))
        share = np.maximum(counts - discount, 0) / total[parent]
        return _Level(grams, share, contexts, np.minimum(discount * kinds / total, 1.0))

    def probability(self, gram: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return lower
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        share = np.where(self.grams[at] == gram, self.gram_share[at], 0.0)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[at] == context
        return np.where(known, share + self.backoff[at] * lower, lower)


def gram_counts(words: list[bytes], counts: np.ndarray, order: int) -> list[tuple[np.ndarray, ...]]:
    """For each length the grams of words, their contexts, and counts summed by gram.

    ``counts`` has a row for each word; the first column of the sums counts the word itself.
    """
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    spelled, at, word, place = _spelling(data, ends - [len(w) for w in words], ends)
    out = []
    for k in range(1, order + 1):
        there, gram, context = _grams(spelled, at, place, k)
        grams, first, which = np.unique(gram, return_index=True, return_inverse=True)
        weights = [np.ones(len(gram)), *(c[word[there]].astype(float) for c in counts.T)]
        sums = [np.bincount(which, weights=w, minlength=len(grams)) for w in weights]
        out.append((grams, context[first], np.stack(sums, axis=1)))
    return out


class SpellingModel:
    """Both classes' models, from the counts of grams in words of ordinary and toxic texts.

    ``levels`` has, for each length, grams, contexts and three counts: in distinct words, in
    ordinary and in toxic texts.
    """

    def __init__(self, levels: list[tuple[np.ndarray, ...]]):
        self.order = len(levels)
        self.shared = [_Level.of(g, c, n[:, 0], DISCOUNT) for g, c, n in levels[:-1]]
        self.classes = [_Level.of(*levels[-1][:2], levels[-1][2][:, k], DISCOUNT) for k in (1, 2)]
        self.known = (np.zeros(0, np.uint64), np.zeros(0))

    def _ratios(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per word the log-likelihood under the toxic model less that under the other."""
        spelled, at, word, place = _spelling(data, start, end)
        lower = np.full(len(at), 1 / 256)
        for k, level in enumerate(self.shared, 1):
            there, gram, context = _grams(spelled, at, place, k)
            lower[there] = level.probability(gram, context, lower[there])
        there, gram, context = _grams(spelled, at, place, self.order)
        ordinary, toxic = (c.probability(gram, context, lower[there]) for c in self.classes)
        return np.bincount(
            word[there], weights=np.log(toxic) - np.log(ordinary), minlength=len(start)
        )

    def differences(self, column: pa.Array) -> np.ndarray:
        """Per text the mean over its words; 0 without words."""
        data, words, start, end = _expressions(column)
        keys, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        ratio = np.zeros(len(keys))
        at = np.searchsorted(self.known[0], keys)
        at[at == len(self.known[0])] = 0
        old = self.known[0][at] == keys if len(self.known[0]) else np.zeros(len(keys), bool)
        ratio[old] = self.known[1][at[old]]
        new = np.flatnonzero(~old)
        ratio[new] = self._ratios(data, start[first[new]], end[first[new]])
        if len(self.known[0]) + len(new) > 500_000:
            self.known = keys, ratio
        else:
            every = np.concatenate([self.known[0], keys[new]])
            order = np.argsort(every, kind="stable")
            self.known = every[order], np.concatenate([self.known[1], ratio[new]])[order]
        n = np.diff(words.first)
        return np.bincount(words.document(), ratio[which].astype(float), len(n)) / np.maximum(n, 1)


def calibration(differences: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from differences to the share of label 1: isotonic regression.

    Equal neighbours are pooled and each pool is smoothed by half a row of either label; a
    hundredth of a logistic curve keeps the order of differences within a pool.
    """
    order = np.argsort(differences, kind="stable")
    pools: list[list[float]] = []
    for d, y in zip(differences[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([d, d, y, 1.0])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1][1] = last[1]
            pools[-1][2] += last[2]
            pools[-1][3] += last[3]
    knots = [x for lo, hi, y, n in pools for x in ((lo, (y + 0.5) / (n + 1)), (hi, (y + 0.5) / (n + 1)))]
    x, p = np.array(knots or [(0.0, 0.5)]).T
    return x, np.maximum.accumulate(p)


def calibrated(differences: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    curve = 1 / (1 + np.exp(-np.clip(differences, -30, 30)))
    return np.clip(0.99 * np.interp(differences, *knots) + 0.01 * curve, 0, 1)


@dataclass
class Classifier:
    model: SpellingModel
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, column: pa.Array) -> np.ndarray:
        return calibrated(self.model.differences(column), self.knots)


_COUNTS = ("n00", "n01", "n10", "n11")
"""Counts by half of the sample and label."""


def _spelled_words(rows: DataFrame) -> DataFrame:
    """The distinct words of (text, label, part), with their counts by part and label."""
    shape = "word binary, part long, label long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, parts = (np.array(c.to_pylist()) for c in batch.columns[1:])
            for part, label in ((p, y) for p in (0, 1) for y in (0, 1)):
                mine = batch.filter(pa.array((parts == part) & (labels == label)))
                for piece in common.chunks(mine, "text"):
                    data, words, start, end = _expressions(piece.column(0))
                    _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                    text, spans = data.tobytes(), zip(start[first], end[first], strict=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([text[a:b].lower() for a, b in spans], pa.binary()),
                        pa.array(np.full(len(n), part)), pa.array(np.full(len(n), label)), pa.array(n),
                    ], schema=arrow_schema(shape))

    return rows.mapInArrow(count, shape).groupBy("word").agg(*(
        F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}")
        for p in (0, 1) for y in (0, 1)
    ))


def _gram_table(words: DataFrame, order: int) -> DataFrame:
    """Counts of all grams of words; only these, not the words, go to the driver."""
    shape = "k int, gram long, context long, once double, " + ", ".join(f"{c} double" for c in _COUNTS)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([np.array(c) for c in batch.columns[1:]], axis=1)
            for k, (gram, context, sums) in enumerate(
                gram_counts(batch.column(0).to_pylist(), counts, order), 1
            ):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)),
                    pa.array(context.view(np.int64)), *(pa.array(c.copy()) for c in sums.T),
                ], schema=arrow_schema(shape))

    return words.select("word", *_COUNTS).mapInArrow(grams, shape).groupBy("k", "gram", "context").agg(
        *(F.sum(c).alias(c) for c in ("once", *_COUNTS))
    )


def _model(table: pa.Table, order: int, parts: tuple[int, ...]) -> SpellingModel:
    k = table["k"].to_numpy()
    columns = {c: table[c].to_numpy() for c in table.column_names}
    levels = []
    for length in range(1, order + 1):
        at = np.flatnonzero(k == length)
        at = at[np.argsort(columns["gram"][at])]
        classes = [sum(columns[f"n{p}{y}"][at] for p in parts) for y in (0, 1)]
        levels.append((
            columns["gram"][at].view(np.uint64), columns["context"][at].view(np.uint64),
            np.stack([columns["once"][at], *classes], axis=1),
        ))
    return SpellingModel(levels)


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, order: int = ORDER
) -> Classifier:
    """A classifier from texts (id, text) and labels (id, label) of 0 or 1; others are left out.

    At most ``fit_rows`` labels are used, those with the smallest hash of their id; they are
    sent to all tasks, so that no text is shuffled. Half of the sample by id hash gives the
    counts, the other half the calibration, and then the whole sample gives the counts that are
    used. Without sampled rows scores stay at one half. Empty texts count as texts without
    words; labels without a text are of no use. The counts of spelled grams and a difference
    for each sampled row reach the driver.
    """
    known = labels.where("label in (0, 1)").select("id", F.col("label").cast("long").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows)
    part = F.pmod(F.xxhash64(F.col("id"), F.lit("part")), F.lit(2)).alias("part")
    rows = materialize(docs.join(F.broadcast(known), "id").select("text", "label", part))
    table = _gram_table(_spelled_words(rows), order).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(_model(table, order, (0,)))
    shape = "difference double, label long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in common.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(model.differences(piece.column(0))), piece.column(1)],
                    schema=arrow_schema(shape),
                )

    held = rows.where("part = 1").select("text", "label").mapInArrow(measure, shape)
    held = held.orderBy("difference", "label").toArrow()
    knots = calibration(held["difference"].to_numpy(), held["label"].to_numpy())
    return Classifier(_model(table, order, (0, 1)), knots)


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each text; a column named ``to`` is replaced.

    Each row is scored where it is read, from its text alone; null is an empty text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    docs = docs.drop(to)
    shape = docs.select(*(F.col(f"`{c}`") for c in docs.columns)).withColumn(to, F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in common.chunks(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col))
                fields = [*part.schema, pa.field(to, pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(known.scores(texts))], schema=pa.schema(fields)
                )

    return docs.mapInArrow(scored, shape)

