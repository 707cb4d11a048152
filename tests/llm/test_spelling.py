"""Spelling variants against all pairs compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from gleanery.llm import spelling

from .cases import awkward, prose, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    words = Counter()
    for key, text, *_ in docs:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    p = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[p + 1 :] == b[p + (len(a) == len(b)) :]


def brute(vocab):
    by = {}
    for w in vocab:
        by[w] = [x for x in vocab if near(w, x)]
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * vocab[w] else None
    out = set()
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, vocab[w], len(by[w]), vocab[form[w]] if form[w] else None))
    return out


def related(n, seed, letters="abcdeé", length=(7, 12)):
    """Words in families, so that many are near."""
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*length)))
        for _ in range(6):
            out[w] = int(2 * 10 ** rng.uniform(0, 4))
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
    return {w: n for w, n in out.items() if w}


@pytest.mark.parametrize("tile,words", [(128, related(900, 1)), (4, related(500, 2, "ab", (3, 9))), (128, related(120, 3, "abc", (60, 300))), (128, {"x": 5, "y": 60, "xy": 700})])
def test_variants_equal_all_pairs(spark, monkeypatch, tile, words):
    monkeypatch.setattr(spelling, "TILE", tile)
    vocab = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT").repartition(3)
    assert set(map(tuple, spelling.variants(vocab).collect())) == brute(words)


def test_a_block_of_many_words_and_other_alphabets(spark):
    words = {"schluss" + chr(0x4E00 + i) + "ende": 2 + i for i in range(400)} | {"schlussende": 100_000, "😀" * 7: 3, "😀" * 8: 30}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")).collect()}
    assert got["schlussende"]["n_near"] == 400 and all(r["n_near"] == 400 for w, r in got.items() if w.startswith("schluss"))
    assert got["schluss一ende"]["root"] == "schlussende" and got["😀" * 7]["form"] == "😀" * 8


def test_counting_of_awkward_rows(spark):
    docs = awkward() + [(None, "Überraschung Überraschung ×÷abcdefg"), (20, None)] + [(i, "Wonderful WONDERFUL wonderful") for i in range(50, 120)] + [(50, "wonderful")]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(spelling.slipped(table(spark, docs))).collect()}
    assert got == counted(docs)


def test_documents_to_variants(spark):
    docs = [(i, prose(30, i % 7) + " Überraschung wonderful") for i in range(900)]
    got = set(map(tuple, spelling.variants(spelling.vocabulary(spelling.slipped(table(spark, docs)))).collect()))
    assert got == brute(counted(docs)) and any(r[1] for r in got)


def test_empty_tables(spark):
    assert spelling.variants(spelling.vocabulary(spelling.slipped(table(spark, [])))).count() == 0
    assert spelling.variants(spelling.vocabulary(spelling.slipped(table(spark, [(1, "rare words only once")])))).count() == 0
