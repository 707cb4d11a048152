"""The pipeline against a brute-force version of its stages, and on empty tables."""

import random

import pytest

import corpus_pipeline
from gleanery.llm import packing, quality

from .cases import awkward, prose, table
from .test_near_and_tokens import components, edited, ids_of, tokenizer  # noqa: F401
from .test_rows import measures, norm, split, water

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng, rows = random.Random(4), [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in awkward() if r[0] not in (6, 7)]
    for i in range(90):
        base = f"the {prose(40, i)} of {prose(60, i + 500)} and {prose(30 + i, i + 900)}"
        rows.append((100 + 4 * i, base, rng.choice(["a", "b", "c", None])))
        if i % 3 == 0:
            rows.append((101 + 4 * i, base.replace(" ", "  \n"), "a"))
        if i % 4 == 0:
            rows.append((102 + 4 * i, edited(base, 0.01, i), "b"))
        if i % 10 == 0:
            rows.append((103 + 4 * i, base + " ###" * 200, "c"))
    return rows


def passes(text):
    n, chars, symbols, dups, repeats = measures(text)
    ws, lines = split(text), [l for l in (text or "").split("\n") if split(l)]
    return (
        n >= 50 and 100 * repeats <= 50 * n and 2 <= chars / n <= 12 and symbols / n <= 0.1
        and sum(w in quality.STOP_WORDS for w in ws) >= 2 and dups / len(lines) <= 0.5
    )


def test_stages_equal_brute_force(spark, tokenizer):  # noqa: F811
    rows = corpus()
    docs = table(spark, rows).select(*COLUMNS).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["quality_rules"](spark, docs, "").cache()
    rows = [r for r in rows if passes(r[1])]
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in rows)

    docs = stages["exact_dedup"](spark, docs, "").cache()
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        best.setdefault(norm(r[1]), r)
    rows = list(best.values())
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in rows)

    docs = stages["near_dedup"](spark, docs, "").cache()
    roots = components([(r[0], r[1]) for r in rows], 5)
    assert len(roots) > len({w[1] for w in roots.values()})
    rows = [r for r in rows if roots[r[0]][1] == r[0]]
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in rows)

    docs = stages["mix_sources"](spark, docs, "").cache()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(split(r[1]))
    copies = [r["doc_id"] for r in docs.collect()]
    of = {r[0]: r for r in rows}
    for i in copies:
        taken[of[i][2]] = taken.get(of[i][2], 0) + len(split(of[i][1]))
    assert max(copies.count(i) for i in copies) <= 2
    assert all(abs(taken.get(s, 0) - t) <= 120 for s, t in water(sizes).items())
    assert docs.columns == COLUMNS

    packed = stages["best_fit_packing"](spark, docs, "").collect()
    pieces = [(i, n) for i in copies for n in range(-(-(len(ids_of(tokenizer, of[i][1])) + 1) // packing.CAPACITY))]
    assert sorted((r["doc_id"], r["piece"]) for r in packed) == sorted(pieces)
    filled = {}
    for r in packed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (None, "")]])
def test_stages_take_empty_and_null_tables(spark, rows):
    docs = table(spark, rows).select(*COLUMNS)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() <= max(3, len(rows))


def test_pipeline_runs_from_documents_to_sequences(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
