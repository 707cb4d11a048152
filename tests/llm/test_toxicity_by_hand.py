"""Counts, odds, chosen beginnings and decoding of the toxicity operator against plain versions."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanery.llm import toxicity

from .cases import awkward, prose, table
from .test_near_and_tokens import toxic_case


def model_of(words):
    base = len(toxicity.LETTERS) + 1
    counts = np.zeros(base**3, np.int64)
    for word in words:
        c = toxicity._codes(f"  {word} ")
        np.add.at(counts, (c[:-2] * base + c[1:-1]) * base + c[2:], 1)
    return toxicity.CharacterModel(counts)


def ways(c, n, model):
    """All readings of a run of n equal characters, each (letters, cost)."""
    if c.isalpha() and c not in model.index:
        return [(c if n > 2 else c * n, 0.0)]
    own = [(c, 0.0)] if c in model.index else [(x, toxicity.SIGN) for x in toxicity.READINGS.get(c, "")]
    out = [(x, cost + toxicity.REPEAT * (n > 1)) for x, cost in own]
    out += [(x * 2, 2 * cost + toxicity.REPEAT * (n > 2)) for x, cost in own if n > 1]
    return out + ([("", toxicity.DROP if own else 0.0)] if c not in model.index else [])


def score(word, model):
    a = b = 0
    total = 0.0
    for c in word:
        i = model.index.get(c)
        if i is None:
            a = b = 0
            continue
        total += model.logs[a, b, i]
        a, b = b, i
    return total + model.logs[a, b, 0]


def test_decoding_equals_the_best_of_all_readings():
    rng = random.Random(4)
    model = model_of(["hello", "dunce", "blockhead", "seat", "soon", "see", "class"] * 5)
    for _ in range(300):
        piece = "".join(rng.choice(["h", "e", "l", "o", "3", "0", "1", "$", "4", "aa", "s", "-", "!!"]) for _ in range(rng.randint(1, 6)))
        runs = [(c, len(list(g))) for c, g in itertools.groupby(piece)]
        best = -math.inf
        for path in itertools.product(*(ways(c, n, model) for c, n in runs)):
            best = max(best, sum(cost for _w, cost in path) + score("".join(w for w, _c in path), model))
        word = model.decode(piece)
        reached = max(
            sum(cost for _w, cost in path) + score(word, model)
            for path in itertools.product(*(ways(c, n, model) for c, n in runs)) if "".join(w for w, _c in path) == word
        )
        assert reached == pytest.approx(best, abs=1e-9), piece


def labels_by_hand(docs, labels, keep=lambda key: True):
    """text -> [clean rows, toxic rows]"""
    of = {}
    for key, y in labels:
        if key is not None and y is not None and keep(key):
            of[key] = max(of.get(key, 0), y)
    out = defaultdict(lambda: [0, 0])
    for key, text, *_ in docs:
        if key in of:
            out[text or ""][of[key] > 0] += 1
    return out


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_labels_of_equal_texts_are_added_up(spark, bits):
    docs = awkward() + [(100 + i, "same text") for i in range(6)] + [(100, "same text"), (100, "another"), (None, "same text")]
    labels = [(100 + i, i % 2) for i in range(6)] + [(1, 1), (6, 0), (7, 1), (9, None), (None, 1), (8, 0), (8, 1), (999, 1)]
    marks = spark.createDataFrame([(k, max(y for j, y in labels if j == k and y is not None)) for k in {k for k, y in labels if k is not None and y is not None}], "_id BIGINT, _y INT")
    got = toxicity.labelled_texts(table(spark, docs).repartition(3), marks, "doc_id", "text", bits).collect()
    want = labels_by_hand(docs, labels)
    assert {r["text"]: [r["clean"], r["toxic"]] for r in got} == dict(want) and len(got) == len(want)


def test_chosen_beginnings_equal_counts_by_hand(spark):
    docs, labels = toxic_case()
    texts = labels_by_hand(docs, labels)
    model = model_of(w for t in texts for w in t.split())
    clean, toxic, support = Counter(), Counter(), Counter()
    for text, (c, t) in texts.items():
        for f in toxicity.beginnings(toxicity.restore(text, model, {})):
            clean[f] += c
            toxic[f] += t
            support[f] += t > 0
    n_clean, n_toxic = (sum(v[i] for v in texts.values()) for i in (0, 1))
    odds = lambda f: math.log((toxic[f] + 0.5) / (n_toxic + 1)) - math.log((clean[f] + 0.5) / (n_clean + 1))
    want = sorted((f for f in support if support[f] >= 3 and odds(f) > 0.5), key=lambda f: (-round(odds(f) * math.sqrt(support[f]), 9), f))[:50]
    taught = spark.createDataFrame([(t, c, x) for t, (c, x) in texts.items()], "text STRING, clean BIGINT, toxic BIGINT").repartition(4)
    got = toxicity.telling_beginnings(taught, model, 50, 3, 0.5)
    assert [g[0] for g in got] == want and all((clean[f], toxic[f]) == (c, t) for f, c, t in got)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = toxic_case()
    docs = docs[:200] + [(2000 + i, docs[0][1]) for i in range(8)]
    marks = spark.createDataFrame(labels[:200] + [(2000 + i, i % 2) for i in range(8)], "doc_id BIGINT, toxic INT")
    runs = [
        {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table(spark, docs).repartition(n), marks.repartition(n)).collect()} for n in (1, 5)
    ]
    assert runs[0] == runs[1]
