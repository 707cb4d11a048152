"""Kernels against literal formulas and brute force."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery import lookups as L
from gleanery.functions import kernels
from gleanery.functions.breaker import Breaker
from gleanery.functions.scores import freeze_weights

WORDS = st.text(alphabet="abc d", max_size=14)


def jaro_winkler_by_definition(a, b):
    if a == b:
        return 1.0
    if not a or not b or max(len(a), len(b)) // 2 - 1 < 0:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used_a, used_b = set(), set()
    for i in range(len(a)):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if j not in used_b and a[i] == b[j]:
                used_a.add(i)
                used_b.add(j)
                break
    if not used_a:
        return 0.0
    left, right = [a[i] for i in sorted(used_a)], [b[j] for j in sorted(used_b)]
    m, t = len(left), sum(x != y for x, y in zip(left, right))
    jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
    same = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


@given(WORDS, WORDS)
@settings(max_examples=400, deadline=None)
def test_jaro_winkler(a, b):
    assert kernels.jaro_winkler_score(a, b) == pytest.approx(jaro_winkler_by_definition(a, b), abs=1e-12)


def test_jaro_winkler_edges():
    assert kernels.jaro_winkler_score("", "") == 1
    assert kernels.jaro_winkler_score("a", "") == 0
    assert kernels.jaro_winkler_score("a", "b") == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(WORDS.filter(bool), WORDS)
@settings(max_examples=200, deadline=None)
def test_prefix_distances(word, text):
    assert list(kernels.prefix_distances(word, text)) == [distance(word, text[:n]) for n in range(len(text) + 1)]


@given(st.integers(0, 10_000), st.sampled_from([Breaker(), Breaker(3, 120_000, 1), Breaker(1, 5_000, 2)]))
@settings(max_examples=150, deadline=None)
def test_breaker_stretches_equal_one_run(seed, rule):
    rnd = random.Random(seed)
    calls, now = [], 0
    for _ in range(60):
        now += rnd.choice([0, 1_000, 20_000, 70_000])
        calls.append((now, rnd.random() < 0.5))
    whole = 0
    for t, ok in calls:
        whole = rule.call(whole, t, ok)
    state, size = 0, rnd.choice([60_000, 150_000, 400_000])
    for n in range(now // size + 1):
        part = [c for c in calls if c[0] // size == n]
        state = rule.apply(state, *rule.transfer([c[0] for c in part], [c[1] for c in part], n * size + rule.open_ms))
    assert state == whole


def test_breaker_opens_after_two_failures_and_closes_after_three_successes():
    calls = [(0, False), (1, False), (2, True), (60_001, True), (60_002, True), (60_003, True)]
    changes = [c[1:] for c in Breaker().run(0, calls)]
    assert changes == [("closed", "open", "source_degraded"), ("open", "half_open", None), ("half_open", "closed", "source_recovered")]


@pytest.mark.parametrize("mode", L.MODE_WEIGHTS)
def test_weights_sum_to_one(mode):
    weights = L.MODE_WEIGHTS[mode]
    assert sum(weights.values()) == pytest.approx(1)
    for source in L.SOURCE_FACTORS:
        assert sum(freeze_weights(weights, [source]).values()) == pytest.approx(1)


WORDS = st.text(alphabet="ab é漢😀", max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=30))
def test_many_scores_equal_single_ones(pairs):
    got = kernels.jaro_winkler_many([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [kernels.jaro_winkler_score(a, b) for a, b in pairs]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, st.integers(0, 15))
def test_banded_edit_distance(a, b, most):
    exact, found = int(kernels.prefix_distances(a, b)[-1]), kernels.levenshtein_within(a, b, most)
    assert found == exact if exact <= most else found > most


def test_jaro_winkler_of_laid_out_titles_is_the_literal_formula(monkeypatch):
    rng = random.Random(11)
    for letters in ("ab", "abcdefgh ", "éè日本 a"):
        titles = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 9, 60]) + rng.randint(0, 4))) for _ in range(14)})
        pairs = [(i, j) for i in range(len(titles)) for j in range(len(titles)) if i != j]
        expected = [kernels.jaro_winkler_score(titles[i], titles[j]) for i, j in pairs]
        for chunk in (40, 100_000):
            monkeypatch.setattr(kernels, "_CHUNK", chunk)
            got = kernels.TitleLetters(titles).jaro_winkler(*np.array(pairs).T)
            assert got.tolist() == expected


def test_edit_distances_are_only_walked_for_titles_that_share_runs_of_letters(monkeypatch):
    from gleanery.operators import title_join

    rng = random.Random(12)
    titles = ["".join(rng.choice("eeeaattonsr  ") for _ in range(300)) for _ in range(40)]
    titles += [t[:150] + "x" + t[160:] for t in titles[:5]]
    walked = []
    real = title_join.levenshtein_within
    monkeypatch.setattr(title_join, "levenshtein_within", lambda a, b, most: walked.append(1) or real(a, b, most))
    seq = np.arange(len(titles))
    u, v, score = title_join._compare(titles, seq, titles, seq, True, title_join.EditDistance(0.9))
    assert sorted(zip(u.tolist(), v.tolist())) == [(i, 40 + i) for i in range(5)] and len(walked) < 50


def test_best_windows_equal_the_windows_walked_one_by_one():
    """Claims longer than a machine word, windows at both ends, letters of several scripts; all rows in one call."""
    rng = random.Random(3)
    texts, claims = [], []
    for _ in range(120):
        letters = rng.choice(["ab", "abcde", "aé漢😀 "])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 90, 160])))
        at, size = rng.randrange(max(1, len(text))), rng.choice([0, 1, 2, 5, 12, 30, 63, 64, 65, 130])
        claim = list(text[at : at + size])
        for _ in range(len(claim) // 6):
            claim[rng.randrange(len(claim))] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
        texts.append(text)
        claims.append("".join(claim))

    def walked(text, claim):
        n, spread, best = len(claim), int(len(claim) * 0.2), (-1, -1, 0.0)
        for hit in range(0, len(text) - n + 1, max(1, n // 4)) if n else ():
            if 1 - kernels.prefix_distances(claim, text[hit : hit + n])[-1] / n < 0.7:
                continue
            for j in range(max(0, hit - spread), hit + 1):
                stop = min(len(text), hit + n + spread)
                far = kernels.prefix_distances(claim, text[j:stop])
                for k in range(hit + n, stop + 1):
                    if 1 - far[k - j] / (k - j) > best[2]:
                        best = (j, k, float(1 - far[k - j] / (k - j)))
        return best

    found = kernels.best_windows(texts, claims, 0.7)
    assert found == [walked(t, c) for t, c in zip(texts, claims)]
    assert sum(f[0] >= 0 for f in found) > 50


def test_anchor_search_keeps_pace_with_long_texts():
    """The windows of all claims are compared together, not one by one."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(40)]
    claims = [t[9_000:9_020] + "#@" + t[9_022:9_048] for t in texts]
    start = time.process_time()
    found = kernels.best_windows(texts, claims, 0.7)
    assert time.process_time() - start < 5
    assert [f[:2] for f in found] == [(9_000, 9_048)] * 40


def test_pairs_that_miss_the_floor_are_dropped_early_and_others_keep_their_exact_score(monkeypatch):
    rng = random.Random(21)
    for letters in ("ab", "abcdefgh ", "éè日本 a", "eeeaaattoinshrdluzq  "):
        titles = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 9, 60, 200]) + rng.randint(0, 9))) for _ in range(12)]
        titles += [t[: len(t) // 2] + rng.choice(letters) + t[len(t) // 2 + rng.randint(0, 2) :] for t in titles]
        titles = sorted(set(titles))
        a, b = np.array([(i, j) for i in range(len(titles)) for j in range(len(titles)) if i != j]).T
        exact = np.array([kernels.jaro_winkler_score(titles[i], titles[j]) for i, j in zip(a, b)])
        common = np.array([sum(min(titles[i].count(c), titles[j].count(c)) for c in set(titles[i])) for i, j in zip(a, b)])
        for chunk in (60, 1 << 18):
            monkeypatch.setattr(kernels, "_RANKS", chunk)
            for floor in (0.5, 0.7, 0.85, 0.92):
                got = kernels.TitleLetters(titles).reaching(a, b, common, floor)
                assert got.tolist() == np.where(exact >= floor, exact, -1.0).tolist()


def test_titles_of_the_same_letters_are_told_apart_by_their_beginnings():
    """Texts that share most letters, but not their order, are not scored whole."""
    from gleanery.operators import title_join

    rng = random.Random(22)
    titles = ["".join(rng.choice("eeeeaaattoinshrdlu  ") for _ in range(400)) for _ in range(600)]
    titles += [t[:200] + "x" + t[203:] for t in titles[:4]]
    seq = np.arange(len(titles))
    start = time.process_time()
    u, v, score = title_join._compare(titles, seq, titles, seq, True, title_join.JaroWinkler(0.92))
    assert time.process_time() - start < 2
    assert sorted(zip(u.tolist(), v.tolist())) == [(i, 600 + i) for i in range(4)]
    assert score.tolist() == [kernels.jaro_winkler_score(titles[i], titles[600 + i]) for i in range(4)]
