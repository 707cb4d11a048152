"""The Merkle manifest against a plain hashlib version, over one and several rounds of blocks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import manifest, midstates

from .cases import DOCS, awkward, table

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def runs(level):
    return [level[i : i + 8] for i in range(0, len(level), 8)]


def ladder(nodes):
    """All levels, from the nodes to their top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*r) for r in runs(levels[-1])])
    return levels


def brute(rows, touched):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars) rows."""
    import zlib

    trees = {}
    for r in rows:
        key, text, lang, source, n = r
        leaf = H(*map(encoded, (key, source, lang, n, text)))
        later = leaf
        if key is not None and touched(zlib.crc32(str(key).encode())) and text is not None:
            later = H(*map(encoded, (key, source, lang, n, text.translate(LOWER))))
        trees.setdefault(lang, []).append((key, leaf, later))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    grown = {t: ladder([leaf for _k, leaf, _l in trees[t]]) for t in order}
    top = ladder([grown[t][-1][0] for t in order])
    out = []
    for no, t in enumerate(order):
        for i, (key, leaf, later) in enumerate(trees[t]):
            value, siblings = later, []
            for levels, at in ((grown[t], i), (top, no)):
                for level in levels[:-1]:
                    run = runs(level)[at // 8]
                    siblings += [d for k, d in enumerate(run) if k != at % 8]
                    value = H(*[value if k == at % 8 else d for k, d in enumerate(run)])
                    at //= 8
            out.append((key, leaf, grown[t][-1][0], top[-1][0], H(*siblings), value, value == top[-1][0]))
    return out


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_midstates_equal_hashlib():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    state = np.repeat(midstates.START[None], 100, axis=0)
    for n in range(4):
        want = [hashlib.sha256((d.hex() * n).encode()).digest() for d in digests]
        assert midstates.octets(midstates.finish(state, np.full(100, n))) == want
        state = midstates.absorb(state, midstates.hex_blocks(midstates.words(digests)))


def make(spark, n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i * 3 - 50, rng.choice([None, "", "Abc É", "text TEXT"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 4])) for i in range(n)]
    rows += [(None, "N", langs[0], None, 1), (None, "M", langs[0], None, 1), (1000, "Twice", None, "s", 2), (1000, "Twice", None, "s", 2)]
    full = [(*r, "x", "y", "z", "w") for r in rows]
    return rows, spark.createDataFrame(full, DOCS).repartition(5)


@pytest.mark.parametrize("levels,n,langs", [(1, 200, ["a"]), (1, 150, [f"l{i}" for i in range(30)]), (2, 600, ["en", "é", None, ""]), (4, 300, ["en", "de"])])
def test_manifest_equals_brute_force(spark, monkeypatch, levels, n, langs):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", 8**levels)
    rows, docs = make(spark, n, langs)
    got = manifest.verify(docs, manifest.lower_cased_third())
    assert found(got) == sorted(brute(rows, lambda c: c % 3 == 0), key=repr)


def test_manifest_of_awkward_tables(spark):
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1) for r in awkward()]
    assert found(manifest.verify(table(spark, awkward()), manifest.lower_cased_third())) == sorted(brute(rows, lambda c: c % 3 == 0), key=repr)
    one = manifest.verify(table(spark, [(7, "Only")]), F.lower("text")).first()
    assert one["leaf"] == one["subroot"] == one["root"] != one["folded_root"] and one["proof_sha256"] == H() and not one["verified"]
    assert manifest.verify(table(spark, []), F.lower("text")).count() == 0


def test_parents_keep_their_states(spark):
    """A parent's digest follows from any of its states, the child there and those right of it."""
    _rows, docs = make(spark, 90, ["a", "b"])
    built = manifest.build(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), manifest.leaf().alias("digest")))
    parents = [r for nodes in built.rounds + built.over for r in nodes.filter("level > 0").collect()]
    assert parents
    for r in parents:
        children, states = midstates.words([r["children"]]), midstates.words([r["states"]])
        for slot in range(len(children)):
            state = states[slot : slot + 1]
            for child in children[slot:]:
                state = midstates.absorb(state, midstates.hex_blocks(child[None]))
            assert midstates.octets(midstates.finish(state, np.array([len(children)]))) == [bytes(r["digest"])]


def test_replacements_without_a_place_are_left_out(spark):
    _rows, docs = make(spark, 20, ["a"])
    built = manifest.build(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), manifest.leaf().alias("digest")))
    digest = hashlib.sha256(b"new").digest()
    asked = spark.createDataFrame([("=a", 3, digest), ("=a", 500, digest), ("=a", 23, digest), ("=q", 0, digest)], "tree STRING, position BIGINT, digest BINARY")
    assert [(r["tree"], r["position"]) for r in manifest.fold(built, asked, ["tree", "position"]).collect()] == [("=a", 3)]
