"""Bounded-space packing and the byte-level ids behind it, against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import byte_tokens, window_packing
from gleanery.llm.queries import QUERIES

from .cases import awkward, prose, table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_tokens.default_path())


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Ab", "'s", "'", "don't", "1", "23", ".", ",", "...", "é", "漢", "😀", "\x0b", "\x1c", "<|endoftext|>", "ß", "_", "\x00", "\x85", chr(0xA0), chr(0x2003)]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)), prose(5000, 1, 5000)]
    got = list(byte_tokens.encode(texts, byte_tokens.default_path()))
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_a_full_store_is_emptied_without_harm(tokenizer, monkeypatch):
    monkeypatch.setattr(byte_tokens, "KEPT", 10)
    texts = [prose(600, s) for s in range(40)] * 20
    for text, raw in zip(texts, byte_tokens.encode(texts, byte_tokens.default_path())):
        assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, docs, tokenizer, capacity, slack=0):
    """Pieces give every document back, sequences have no gap and next to no padding."""
    want = defaultdict(list)
    for key, text, *_ in docs:
        want[key].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == want.keys()
    for key, mine in pieces.items():
        if len(want[key]) > 1:
            continue  # rows that share an id: their number of ids is checked below
        ids, at = want[key][0], 0
        for r in sorted(mine, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in rows) == sum(len(i) for many in want.values() for i in many)
    padding = 0
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= slack * len(sequences)
    return sequences


def test_packing_of_awkward_rows(spark, tokenizer):
    docs = awkward() + [(8, "again"), (None, None), (None, "x y")]
    rows = window_packing.window_pack(table(spark, docs)).collect()
    check(rows, docs, tokenizer, 2048)


@pytest.mark.parametrize("windows,fan,least", [(1, 2, 1), (3, 2, 1), (8, 64, 20)])
def test_packing_over_many_partitions_and_rounds(spark, tokenizer, windows, fan, least):
    docs = [(i, prose(5 + 37 * i % 260, i)) for i in range(150)]
    rows = window_packing.window_pack(table(spark, docs).repartition(11), capacity=512, windows=windows, fan=fan, least_piece=least, keep_ids=True).collect()
    check(rows, docs, tokenizer, 512, least - 1)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_a_task_holds_few_windows():
    packer = window_packing.Packer(0, 100, 32, 1, False)
    rng = random.Random(5)
    for i in range(2000):
        packer.put(i, 0, np.zeros(rng.randint(1, 90), "<u2"), 0)
        assert len(packer.open) == len(packer.rooms) <= 32
    cut = sum(r[3] > 0 for r in packer.rows)
    assert cut < 600  # best fit leaves most documents whole


def test_packing_of_an_empty_table(spark):
    assert window_packing.window_pack(table(spark, [])).count() == 0


def test_op13(spark, tokenizer):
    rows = QUERIES["op13_window_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, docs, tokenizer, 2048)
