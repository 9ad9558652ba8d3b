"""Re-Pair shards and packing against plain encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regatta.llm import packing, repair
from regatta.llm.tokenizing import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  b", "a \n b\n\n c ", "\t a\t b", "don't we'll  <|endoftext|> x", "é  è　 z",
    "a\x1c b", "12 345  .. !!  \n", None, "a" * 5000, "x y " * 3000,
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(PATH)
    one.encode_special_tokens = True
    return lambda text: one.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a  b", "x"), (3, "other", "x"), (None, "n", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string")


SIGNS = [
    "a", "É", "×", "÷", "»", "\u00a0", "\u3000", "\u2028", "\u0085", "中", "🙂", " ", " ", "\n", "\t",
    "\x1c", ".", ",", "!", "'s", "'", "7", "-", "<|endoftext|>", "the", "Z", "\x00",
]


def test_pieces_equal_whole_texts(plain):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(SIGNS, k=rng.randrange(12))) for _ in range(20_000)]
    for limit in (3, 1_000_000):
        one, at = PieceEncoder(PATH, limit), 0
        assert one.cuts
        while at < len(texts):
            part = texts[at:at + rng.randrange(1, 900)]
            got = one.encode(pa.array(part, pa.string()), 7)
            assert [g.tolist() for g in got] == [[*plain(t), 7] for t in part]
            at += len(part)
    assert one.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("ids", [
    [], [0], [5, 0], [1] * 1000 + [0], [0, 0, 0], [7, 0, 7, 0] * 50, [0, 1, 0, 1, 2, 0, 1, 2] * 90,
    [1, 2, 3, 4] * 500 + [0] + [1, 2, 3] * 300 + [0],
])
def test_repair_round_trip(ids):
    first, rules, lengths, sequence = repair.compress(np.array(ids, np.uint32), 0)
    assert repair.Grammar(first, rules, lengths).expand(sequence).tolist() == ids
    if len(ids) > 500 and 0 not in ids[:4]:
        assert len(sequence) < len(ids) / 3


def uses_left(sequence, end):
    """Of each pair without ``end``, how often it could still be replaced from left to right."""
    uses, free_from = {}, {}
    for at, pair in enumerate(zip(sequence[:-1], sequence[1:], strict=True)):
        if end not in pair and at >= free_from.get(pair, 0):
            uses[pair] = uses.get(pair, 0) + 1
            free_from[pair] = at + (2 if pair[0] == pair[1] else 1)
    return uses


@pytest.mark.parametrize("seed", range(12))
def test_rules_until_none_pays(seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(0, 1 + seed, 4000), np.repeat(rng.integers(0, 9, 500), rng.integers(1, 9, 500)),
             np.tile(rng.integers(0, 300, 97), 1 + seed)]
    for ids in (kinds[0], kinds[1], kinds[2], np.concatenate(kinds)):
        first, rules, lengths, sequence = repair.compress(ids.astype(np.uint32), 0)
        grammar = repair.Grammar(first, rules, lengths)
        assert grammar.expand(sequence).tolist() == ids.tolist()
        assert max(uses_left(sequence.tolist(), 0).values(), default=0) < repair.MIN_USES
        every = np.arange(first, first + len(rules), dtype=np.uint32)
        assert [len(grammar.expand(every[k:k + 1])) for k in range(len(every))] == lengths.tolist()
        assert not (rules == 0).any()


def test_copies_of_a_passage_shrink():
    passage = np.random.default_rng(1).integers(1, 50_000, 20_000).astype(np.uint32)
    for copies in (4, 10, 50):
        _, rules, _, sequence = repair.compress(np.tile(passage, copies), 0)
        assert len(sequence) <= 16 + copies and len(rules) <= len(passage) + 16
        row = repair._block_row(0, 0, [1], [np.tile(passage, copies)], 0)
        stored = sum(len(row[c]) for c in ("rules", "lengths", "sequence"))
        assert copies < 10 or stored < 2 * copies * len(passage) / 3


def test_numbers_by_bits():
    rng = np.random.default_rng(2)
    for bits in (1, 15, 16, 17, 19, 24, 31, 32):
        for n in (0, 1, 7, 8, 9, 1000):
            values = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            blob = repair._packed(values, bits)
            assert repair._unpacked(blob, n, bits).tolist() == values.tolist()
            assert len(blob) == 2 * n + max(0, bits - 16) * -(-n // 8)


def test_parts_of_documents():
    docs = [np.array(x + [0], np.uint32) for x in ([1, 2, 3] * 200, [], [4, 1, 2] * 99, [0, 9, 0])]
    row = repair._block_row(0, 0, [1, None, 3, 4], docs, 0)
    for k, doc in enumerate(docs):
        for start in (0, 1, 5, 250, 10_000):
            for length in (None, 0, 1, 7, 400):
                stop = None if length is None else start + length
                assert repair.read_part(row, k, start, length).tolist() == doc[start:stop].tolist()


def check_shards(spark, docs, plain, tmp_path):
    repair.write_shards(docs, f"{tmp_path}/shards", PATH)
    got = sorted(repair.read_shards(spark, f"{tmp_path}/shards").collect(), key=lambda r: r.start)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    at, want = 0, []
    for row in rows:
        ids = [*plain(row.text), 0]
        want.append((row.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_shards(spark, plain, tmp_path):
    check_shards(spark, odd_documents(spark).repartition(3), plain, tmp_path)


def test_shards_of_the_table(spark, sf, plain, tmp_path):
    check_shards(spark, spark.read.parquet(f"{sf}/documents.parquet"), plain, tmp_path)


def test_no_documents(spark, tmp_path):
    none = odd_documents(spark).limit(0)
    repair.write_shards(none, f"{tmp_path}/shards", PATH)
    assert repair.read_shards(spark, f"{tmp_path}/shards").collect() == []
    assert packing.pack(none, PATH).collect() == []


def check_packed(rows, texts, plain, tasks):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = [*plain(text), 1], 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        padded += bool(at & (at - 1))
        assert len({(r.tier, r.step_id) for r in pieces}) == 1
    assert padded <= tasks
    steps = {}
    for pieces in by_sequence.values():
        key = (pieces[0].tier, pieces[0].step_id)
        steps[key] = steps.get(key, 0) + pieces[0].tier
    assert max(steps.values()) <= packing.STEP_IDS


def test_packing(spark, sf, plain, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packed(packing.pack(docs, PATH).collect(), texts, plain, 3)


def test_packing_of_odd_texts(spark, plain):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    check_packed(packing.pack(docs, PATH).collect(), dict(enumerate(ODD)), plain, 1)
    many = packing.pack(odd_documents(spark).coalesce(1), PATH).collect()
    assert sum(r.length for r in many) == sum(
        len(plain(t)) + 1 for t in [*ODD, "a  b", "other", "n"]
    )


def test_tiers_are_powers_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(odd_documents(spark), PATH, tiers=(2000, 100))


def test_pool_in_lots():
    pool, seen = packing.Pool(), {}
    rng = np.random.default_rng(1)
    done = []
    for lot in range(5):
        for k in range(200):
            n = int(rng.integers(1, 2049))
            seen[lot, k] = n
            pool.add(((lot, k), 0, n))
        done += pool.windows()
    assert all(sum(p[2] for p in w) == t for t, w in done)
    done += pool.rest()
    got = {}
    for _, pieces in done:
        for doc, start, n in pieces:
            got.setdefault(doc, []).append((start, n))
    for doc, n in seen.items():
        at = 0
        for start, m in sorted(got[doc]):
            assert start == at
            at += m
        assert at == n
