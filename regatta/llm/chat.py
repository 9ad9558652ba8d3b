"""Conversations rebuilt from event logs and rendered with a chat template.

A log holds, for each message, its opening, streamed text deltas, edits (the whole text anew) and
regenerations (the text starts over). Messages are folded where they lie, by their key; only
finished messages are sorted by conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regatta.llm.schemas import arrow_schema

START, END = "<|im_start|>", "<|im_end|>"
KEY = ("conv_id", "turn", "copy")

DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def event_log(turns: DataFrame, delta: int = 40) -> DataFrame:
    """An event log whose folding gives ``turns`` (conv_id, turn, copy, role, text) again.

    Texts are streamed in deltas of ``delta`` characters. By a hash of its place a message first
    gets a draft that is thrown away by a regeneration, or a wrong text that an edit puts right,
    or just its deltas. Events are numbered within their message.
    """
    how = F.pmod(F.xxhash64(*KEY), F.lit(4))
    text = F.coalesce("text", F.lit(""))

    def deltas(x: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
        return F.transform(pieces, lambda p: _event("delta", p))

    opening = F.array(_event("open", F.coalesce("role", F.lit(""))))
    draft = F.concat(deltas(F.substring(text, 1, 3 * delta)), F.array(_event("regenerate", F.lit(""))))
    wrong = F.array(_event("delta", F.lit("unsent")), _event("edit", text))
    events = F.when(how == 0, F.concat(opening, draft, deltas(text))).when(
        how == 1, F.concat(opening, wrong)
    ).otherwise(F.concat(opening, deltas(text)))
    return turns.select(*KEY, F.posexplode(events).alias("seq", "event")).select(
        *KEY, "seq", "event.kind", "event.payload"
    )


def _event(kind: str, payload: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))


def fold(log: DataFrame) -> DataFrame:
    """The final messages of a log: (conv_id, turn, copy, role, text).

    The text is what was streamed or edited in since the last regeneration or edit. The rows of
    one message meet in one task, those of one conversation need not. An event seen twice (equal
    in all columns) counts once; a message without an opening has an empty role; null payloads
    are empty.
    """
    event = F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"))
    folded = log.groupBy(*KEY).agg(F.sort_array(F.collect_set(event)).alias("events"))
    resets = F.array_max(F.transform(
        F.filter("events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["seq"]
    ))
    kept = F.filter("events", lambda e: e["kind"].isin("delta", "edit") & (
        F.col("since").isNull() | (e["seq"] >= F.col("since"))
    ))
    opened = F.filter("events", lambda e: e["kind"] == "open")
    folded = folded.withColumn("since", resets)
    return folded.select(
        *KEY,
        F.coalesce(F.get(F.transform(opened, lambda e: e["payload"]), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["payload"]), "").alias("text"),
    )


def escaped(text: Column) -> Column:
    """Reversible: no control string is left in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:\\.|[^\\\n])*)\n", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    head = _ROLE.match(formatted, len(START))
    if not (formatted.startswith(START) and formatted.endswith(END + "\n") and head):
        raise ValueError(f"not a message: {formatted[:80]!r}")
    return unescaped(head[1]), unescaped(formatted[head.end():-len(END) - 1])


def render(messages: DataFrame) -> DataFrame:
    """Each message in the template, in parts: (conv_id, turn, copy, formatted, mask_start, mask_end).

    A conversation is the concatenation of its parts by (turn, copy). The loss mask covers the
    code points from ``mask_start`` up to ``mask_end`` of a part: the text of an assistant.
    A line break in a role is escaped too, so the first plain one ends the role.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escaped(F.col("text"))
    return messages.select(
        *KEY, F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.length(head).cast("long").alias("mask_start"),
        (F.length(head) + F.when(F.col("role") == "assistant", F.length(body)).otherwise(0))
        .cast("long").alias("mask_end"),
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows as (conv_id, turn, copy, role, text); rows of equal place go by role and text.

    Null ids are one conversation, null turns come first, null roles and texts are empty.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")),
    )
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    return rows.withColumn("copy", F.row_number().over(order).cast("long")).select(*KEY, "role", "text")


def digests(rendered: DataFrame) -> DataFrame:
    """What rendered messages say, read back by conversation.

    The parts of a conversation are dealt to one task, sorted on disk if need be, and streamed
    through two running digests, so a conversation of any length takes the memory of one batch.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, now = arrow_schema(DIGESTS), [], None

        def close() -> None:
            if now is not None:
                conv, turns, chars, loss, all_text, all_loss = now
                rows.append((conv, turns, all_text.hexdigest(), loss, all_loss.hexdigest(), chars))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns)
            for conv, formatted, start, end in zip(*columns, strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                role, text = parse(formatted)
                learned = unescaped(formatted[start:end])
                now[1] += 1
                now[2] += len(formatted)
                now[3] += len(learned)
                now[4].update(f"{role}\n{text}\n".encode())
                now[5].update(learned.encode())
            yield batch_of()
        close()
        yield batch_of()

    dealt = rendered.repartition("conv_id").sortWithinPartitions(*KEY)
    return dealt.select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(read, DIGESTS)
