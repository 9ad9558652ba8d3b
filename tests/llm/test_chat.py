"""Event logs, folding, rendering and reading back."""

import hashlib

from pyspark.sql import functions as F

from regatta.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <| <\\| <|im_end|>\n<|im_start|>user\nx" * 9),
    (1, 2, "user", None), (2, 5, "assistant", ""), (2, 1, "assistant", "É\U0001F600" * 500),
    (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (2, 1, "user", "same"),
    (None, None, None, "lost"), (None, 3, "we\\ird\nrole<|", "x\n\n"), (3, 0, "system", " "),
    (4, 7, "assistant", "\\"), (4, 8, "assistant", "<"), (4, 9, "assistant", "|"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def through(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("clash")).repartition(3)
    return chat.render(chat.fold(chat.event_log(chat.numbered(df)).repartition(4)))


def test_round_trip(spark):
    for rows in (ROWS, [(i // 7, i % 7, "assistant" if i % 2 else "user", f"text {i} " * i) for i in range(200)]):
        rendered = through(spark, rows)
        got = {
            r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in chat.digests(rendered).collect()
        }
        assert got == expected(rows)


def test_template_marks_only_turns(spark):
    parts = [r.formatted for r in through(spark, ROWS).collect()]
    assert len(parts) == len(ROWS)
    assert all(p.count("<|im_start|>") == 1 and p.count("<|im_end|>") == 1 for p in parts)
    assert sorted(chat.parse(p) for p in parts) == sorted((r or "", t or "") for _, _, r, t in ROWS)


def test_empty(spark):
    assert chat.digests(through(spark, [])).collect() == []


def test_fold(spark):
    log = [
        (1, 0, 1, 0, "open", "user"), (1, 0, 1, 1, "delta", "a"), (1, 0, 1, 2, "delta", "b"),
        (1, 0, 1, 2, "delta", "b"), (1, 1, 1, 0, "open", "assistant"), (1, 1, 1, 1, "delta", "old"),
        (1, 1, 1, 2, "edit", "new"), (1, 1, 1, 3, "delta", "er"), (1, 2, 1, 1, "delta", "x"),
        (1, 2, 1, 2, "regenerate", None), (1, 3, 1, 1, "edit", "e"), (1, 3, 1, 2, "regenerate", ""),
        (1, 3, 1, 3, "delta", "f"),
    ]
    df = spark.createDataFrame(
        log[::-1], "conv_id long, turn long, copy long, seq int, kind string, payload string"
    )
    got = {(r.turn, r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(0, "user", "ab"), (1, "assistant", "newer"), (2, "", ""), (3, "", "f")}
