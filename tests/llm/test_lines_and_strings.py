"""Line and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import line_dedup, substring_dedup

from .cases import awkward, prose, table

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute_lines(rows, least=40, repeats=5):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [l for l in lines if not (len(holders.get(key(l), ())) >= repeats and max(holders[key(l)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def lines_case():
    rng, pool = random.Random(5), [prose(9, i) for i in range(12)] + ["SHORT", "ÄÖ " * 20, "A" * 39, "B" * 40]
    shout = lambda l: rng.choice([l, l.upper(), f"  {l}\t", l + "\r"])
    rows = [(i, "\n".join(shout(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, prose(20_000, 3, 20_000))]


def cleaned(index, docs):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["clean_text"]) for r in index.clean(docs).collect()}


def test_lines_equal_brute_force_and_deletion_undoes_insertion(spark):
    rows = lines_case()
    index = line_dedup.LineIndex(spark, shards=3)
    index.add(table(spark, rows))
    assert cleaned(index, table(spark, rows)) == brute_lines(rows)
    late = [(i + 1000, t) for i, t in rows[:25]]
    index.add(table(spark, late))
    assert cleaned(index, table(spark, rows + late).filter("doc_id < 1000")) == {k: v for k, v in brute_lines(rows + late).items() if k < 1000}
    index.remove(table(spark, late))
    assert cleaned(index, table(spark, rows)) == brute_lines(rows)
    index.rebuild()
    assert cleaned(index, table(spark, rows)) == brute_lines(rows)


def test_a_later_batch_may_bring_many_more_repeated_lines(spark, monkeypatch):
    first = [(i, prose(9, i)) for i in range(5)]
    late = [(100 + i, "\n".join(prose(9, 1000 + k) for k in range(120))) for i in range(6)]
    index = line_dedup.LineIndex(spark, shards=2)
    index.add(table(spark, first))
    with monkeypatch.context() as broken:  # a change that fails half-way and is made again counts once
        broken.setattr(line_dedup.LineIndex, "_turned", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(table(spark, late))
    index.add(table(spark, late))
    assert cleaned(index, table(spark, first + late)) == brute_lines(first + late)
    again = line_dedup.LineIndex(spark, index.folder)
    assert (again.generation, again.shards) == (2, 2)
    again.rebuild()
    again.rebuild()
    again.remove(table(spark, late[:2]))
    assert again.counts().filter("n_docs >= 5").count() == 0
    assert cleaned(again, table(spark, first + late[2:])) == brute_lines(first + late[2:])


def test_lines_empty_table(spark):
    index = line_dedup.LineIndex(spark, shards=2)
    index.add(table(spark, []))
    assert index.clean(table(spark, [])).count() == 0
    assert {"size", "kept", "digest"} <= set(index.clean(table(spark, awkward())).columns)


def test_cuckoo_filter_never_forgets_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, np.uint64)
    held = line_dedup.CuckooFilter.build(keys)
    assert held.contains(keys).all()
    assert held.contains(rng.integers(0, 2**63, 20_000, np.uint64)).mean() < 0.005
    for k in keys[:2500]:
        assert held.delete(int(k))
    assert held.contains(keys[2500:]).all() and held.contains(keys[:2500]).mean() < 0.01
    assert (line_dedup.CuckooFilter.load(held.dump()).cells == held.cells).all()


def brute_strings(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(raw[p : p + length])
        runs = sum(1 for p in range(len(raw)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def strings_got(spark, rows):
    out = substring_dedup.remove_repeats(table(spark, rows).repartition(3)).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out}


def test_substrings_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [prose(40, i) for i in range(4)]
    rows = [(i, " ".join(rng.choice([*passages, prose(rng.randint(5, 40), rng.randint(0, 10**6)), "é" * 70, "ab" * 80]) for _ in range(5))) for i in range(40)]
    for i in range(40, 60):  # near copies: one letter changed in several places
        text = list(prose(150, 77))
        for _ in range(4):
            text[rng.randrange(len(text))] = "X"
        rows.append((i, "".join(text)))
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101), (105, "x" * 5000), (106, passages[0][:120]), (-1, passages[0] + "tail")]
    assert strings_got(spark, rows) == brute_strings(rows)


def test_substrings_awkward_and_empty(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert strings_got(spark, rows) == brute_strings(rows)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0
    nameless = substring_dedup.remove_repeats(table(spark, [(None, prose(50, 1)), (1, prose(50, 1)), (2, prose(50, 1))])).collect()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in nameless} == {None: False, 1: False, 2: True}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=400), max_size=8))
def test_segments_cover_every_start_once(raw):
    roll = substring_dedup.RollingHash()
    text, start, starts, before, _gram, _content = substring_dedup.segments(raw, roll)
    covered = sorted((int(t), p) for t, s, n in zip(text, start, starts) for p in range(s, s + n))
    assert covered == [(t, p) for t, r in enumerate(raw) for p in range(max(0, len(r) - 99))]
    assert all(starts <= 61) and all(before >= 0) and all(before <= 60) and all(before - starts + 1 >= 0)
