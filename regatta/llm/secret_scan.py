"""Secrets in texts: fixed rules, and Markov models of random strings and identifiers.

Everything is a column expression: a row's spans come from its text alone, without a shuffle.
Places are code points; an end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.carried import quoted, rows_with, whole_rows

ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
"""``AKIA[A-Z0-9]+`` of 20 characters or more: a shorter match ends where its run does."""
HEX = r"[0-9a-f]{24,}"
"""``[0-9a-f]+`` of 24 characters or more, likewise."""
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
"""Candidates of the Markov models."""
LEAST_TOKEN = 16
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_BLOCK = 128


def running_sum(values: Column) -> Column:
    """Sums up to and with each element, in about n * 128 steps."""

    def sums(block: Column, base: Column) -> Column:
        return F.aggregate(
            block, F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"),
                F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    zero = F.lit(0).cast("bigint")
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
    bases = F.zip_with(sums(totals, zero), totals, lambda s, t: s - t)
    long = F.flatten(F.zip_with(blocks, bases, sums))
    return F.when(F.size(values) > _BLOCK, long).otherwise(sums(values, zero))


def _with_spans(df: DataFrame, text: str, pattern: str, kind: int, to: str, keep=None) -> DataFrame:
    """``df`` with the spans of a pattern's matches as ``to``; texts without one cost one search.

    ``keep`` gets the matched strings and says which to keep, as an array of booleans.
    """
    found, gaps, ends = f"{to}_found", f"{to}_gaps", f"{to}_ends"
    none = F.array().cast(SPAN)
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.split(text, pattern, -1)))
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)), F.col(found),
        lambda g, m: (F.length(g) + F.length(m)).cast("bigint"),
    )
    df = df.withColumn(ends, F.when(some, running_sum(steps)))
    spans = F.zip_with(ends, found, lambda e, m: F.struct(
        (e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end")
    ))
    if keep is not None:
        marked = F.zip_with(spans, keep, lambda s, k: F.when(k, s))
        spans = F.filter(marked, lambda s: s.isNotNull())
    return df.withColumn(to, F.coalesce(F.when(some, spans), none).cast(SPAN)).drop(gaps, ends)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``assign``, ``access`` and ``hex``, the spans of the fixed rules."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    enough = F.transform(values, lambda v: F.length(v) >= LEAST_VALUE)
    docs = _with_spans(docs, text, ASSIGN, 0, "assign", enough)
    docs = _with_spans(docs, text, ACCESS, 1, "access")
    docs = _with_spans(docs, text, HEX, 2, "hex")
    return docs.drop("assign_found", "access_found", "hex_found")


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Strings and labels from texts: (string, label, n).

    Random (1) are the values that the fixed rules find; ordinary (0) are words of candidate
    length that hold letters, hyphens and underscores only.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    value = F.filter(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE
    )
    value = F.transform(value, lambda v: F.regexp_replace(v, r"[^A-Za-z0-9+/_=-]", ""))
    value = F.filter(value, lambda v: F.regexp_like(v, F.lit("[0-9]")))
    random = F.concat(
        value, *(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ACCESS, HEX))
    )
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    words = F.filter(tokens, lambda t: F.regexp_like(t, F.lit("^[A-Za-z_-]+$")))
    both = F.concat(
        F.transform(random, lambda s: F.struct(s.alias("string"), F.lit(1).alias("label"))),
        F.transform(words, lambda s: F.struct(s.alias("string"), F.lit(0).alias("label"))),
    )
    rows = docs.select(F.explode(both).alias("x")).select("x.string", "x.label")
    return rows.groupBy("string", "label").agg(F.count("*").alias("n"))


class MarkovRatio:
    """Log-likelihood ratios of character pairs, random against ordinary.

    Counts of pairs and of first characters are smoothed by adding ``smooth``. Without samples of
    both labels, every ratio is 0 and nothing is found. Only as many numbers as there are pairs
    of the alphabet's characters reach the driver.
    """

    def __init__(self, samples: DataFrame, smooth: float = 0.5):
        size = len(ALPHABET)
        string = F.col("string")
        pairs = F.concat(
            F.array(F.concat(F.lit("^"), F.substring(string, 1, 1))),
            F.when(F.length(string) > 1, F.transform(
                F.sequence(F.lit(1), F.length(string) - 1), lambda i: string.substr(i, F.lit(2))
            )).otherwise(F.array().cast("array<string>")),
        )
        known = samples.where("label in (0, 1) and length(string) > 0 and n > 0")
        found = known.select("label", "n", F.explode(pairs).alias("pair"))
        found = found.where(F.regexp_like("pair", F.lit(r"^[\^A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$")))
        counts: dict[int, dict[str, int]] = {0: {}, 1: {}}
        for row in found.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
            counts[row["label"]][row["pair"]] = row["n"]
        rows = []
        for first in "^" + ALPHABET:
            totals = [
                sum(counts[y].get(first + c, 0) for c in ALPHABET) + smooth * size for y in (0, 1)
            ]
            for second in ALPHABET:
                p = [
                    (counts[y].get(first + second, 0) + smooth) / totals[y] for y in (0, 1)
                ]
                rows.append(round(math.log(p[1] / p[0]), 4))
        usable = counts[0] and counts[1]
        self.ratios = rows if usable else [0.0] * len(rows)

    def _ratios(self, token: Column) -> Column:
        """The ratio of each character of a string, given the one before."""
        size = len(ALPHABET)
        table = F.lit(self.ratios)
        codes = F.lit([ALPHABET.find(chr(k)) for k in range(128)])
        own = F.transform(F.split(token, ""), lambda c: F.element_at(codes, F.ascii(c) + 1))
        return _let(own, lambda own: F.transform(own, lambda c, i: F.element_at(
            table, (F.coalesce(F.get(own, i - 1), F.lit(-1)) + 1) * size + c + 1
        )))

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a string of the alphabet's characters."""
        return F.aggregate(self._ratios(token), F.lit(0.0), lambda acc, r: acc + r)

    def stretches(self, token: Column, least_ratio: float) -> Column:
        """Where a string looks random: an array of (start, end) in it.

        The string as a whole if its ratio is at least ``least_ratio``. Otherwise its best
        stretches of ``LEAST_TOKEN`` characters or more, read from the left: a stretch that has
        the ratio grows while its ratio does, and is closed once the characters after its end
        take ``least_ratio`` away; the search goes on behind those.
        """
        pair = "array<struct<start:int,end:int>>"
        none, far = F.array().cast(pair), F.lit(1e300)

        def span(start: Column, end: Column) -> Column:
            return F.array(F.struct(start.alias("start"), end.alias("end"))).cast(pair)

        def state(at, total, lag, first, low, low_at, best, start, end, out) -> Column:
            names = "at", "sum", "lag", "first", "low", "low_at", "best", "start", "end", "out"
            values = at, total, lag, first, low, low_at, best, start, end, out
            return F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))

        # sum and lag: ratios of all characters so far, and of those at least LEAST_TOKEN back;
        # low: the least lag from ``first`` on, at low_at; best: of the open stretch, or 0.
        zero, nought = F.lit(0), F.lit(0.0)
        opening = state(zero, nought, nought, zero, far, zero, nought, zero, zero, none)

        def read(acc: Column, r: Column, before: Column) -> Column:
            back = acc["at"] + 1 - LEAST_TOKEN
            lag = acc["lag"] + F.coalesce(F.get(before, back - 1), nought)
            moved = F.struct(
                (acc["sum"] + r).alias("sum"), lag.alias("lag"),
                ((back >= acc["first"]) & (lag < acc["low"])).alias("lower"),
            )
            return _let(moved, lambda m: _let(
                F.struct(
                    F.when(m["lower"], m["lag"]).otherwise(acc["low"]).alias("low"),
                    F.when(m["lower"], back).otherwise(acc["low_at"]).alias("low_at"),
                ), lambda low: follow(acc, m, low)
            ))

        def follow(acc: Column, m: Column, low: Column) -> Column:
            at, value = acc["at"] + 1, m["sum"] - low["low"]
            found = acc["best"] > 0
            fallen = found & (value <= acc["best"] - least_ratio)
            grown = (value >= least_ratio) & (value > acc["best"])
            return (
                F.when(fallen, state(
                    at, m["sum"], m["lag"], at, far, zero, nought, zero, zero,
                    F.concat(acc["out"], span(acc["start"], acc["end"])),
                ))
                .when(grown, state(
                    at, m["sum"], m["lag"], acc["first"], low["low"], low["low_at"], value,
                    low["low_at"], at, acc["out"],
                ))
                .otherwise(state(
                    at, m["sum"], m["lag"], acc["first"], low["low"], low["low_at"], acc["best"],
                    acc["start"], acc["end"], acc["out"],
                ))
            )

        def closed(acc: Column) -> Column:
            return (
                F.when(acc["sum"] >= least_ratio, span(zero, acc["at"]))
                .when(acc["best"] > 0, F.concat(acc["out"], span(acc["start"], acc["end"])))
                .otherwise(acc["out"])
            )

        return _let(self._ratios(token), lambda ratios: F.aggregate(
            ratios, opening, lambda acc, r: read(acc, r, ratios), closed
        ))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of all characters of the spans (sorted)."""
    zero = F.lit(0).cast("bigint")
    opening = F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out"))

    def between(a: Column, b: Column) -> Column:
        return text.substr((a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        blank = F.repeat(F.lit(" "), (end - start).cast("int"))
        return F.struct(
            end.alias("at"), F.concat(acc["out"], F.array(between(acc["at"], start), blank)).alias("out")
        )

    rebuilt = F.aggregate(spans, opening, step, lambda acc: F.array_join(
        F.concat(acc["out"], F.array(between(acc["at"], F.length(text).cast("bigint")))), ""
    ))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)


def scan(
    docs: DataFrame, model: MarkovRatio, text_col: str = "text", least_ratio: float = 8.0,
    cut: bool = False,
) -> DataFrame:
    """``docs`` with its secrets: ``assign``, ``access``, ``hex`` and ``markov`` spans.

    Markov spans lie in runs of candidate characters beside the spans of the fixed rules. They are
    the run as a whole or its stretches with a log-likelihood ratio of at least ``least_ratio``,
    see ``MarkovRatio.stretches``. With ``cut``, a run that touches a span of the fixed rules is
    cut there and its parts are looked at; otherwise it is left out. A null text is empty; equal
    rows are scanned apart; an empty table stays one; a text is looked at as a whole, in memory in
    proportion to it; columns named like the results are replaced, all others are kept.
    """
    names, text = docs.columns, "text"
    docs = whole_rows(docs, text=F.coalesce(F.col(quoted(text_col)), F.lit("")))
    docs = base_spans(docs, text)
    base = ordered("assign", "access", "hex")
    if cut:
        docs = docs.withColumn(text, _blanked(F.col(text), base))
    docs = _with_spans(docs, text, TOKEN, 3, "markov")

    def inside(s: Column, t: Column) -> Column:
        return F.transform(model.stretches(t, least_ratio), lambda x: F.struct(
            (s["start"] + x["start"]).alias("start"), s["kind"].alias("kind"),
            (s["start"] + x["end"]).alias("end"),
        ))

    def beside(s: Column, t: Column) -> Column:
        return F.when(
            ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), inside(s, t)
        ).otherwise(F.array().cast(SPAN))

    likely = F.flatten(F.zip_with("markov", "markov_found", inside if cut else beside))
    docs = docs.withColumn("markov", likely.cast(SPAN))
    return rows_with(docs, names, "assign", "access", "hex", "markov")


def ordered(*columns: str) -> Column:
    """Spans by start, then kind in the order of ``KINDS``."""
    return F.array_sort(F.concat(*columns))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (sorted) replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def between(a: Column, b: Column) -> Column:
        return text.substr((a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        beyond = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (F.size(acc["out"]) == 0))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(beyond, F.concat(
                acc["out"], F.array(between(acc["at"], s["start"]), F.lit(mark))
            )).otherwise(acc["out"]).alias("out"),
        )

    rebuilt = F.aggregate(spans, start, step, lambda acc: F.array_join(
        F.concat(acc["out"], F.array(between(acc["at"], F.length(text).cast("bigint")))), ""
    ))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)
