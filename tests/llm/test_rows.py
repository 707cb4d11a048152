"""Quality rules, exact dedup, mixing and chat formatting on small tables."""

import hashlib
import re

import pytest

from gleanery.llm import chat, exact, mixing, quality
from gleanery.llm.queries import QUERIES
from gleanery.session import ensure_checkpoint_dir

from .cases import awkward, prose, table

SPACE = "[\x20\x09-\x0D]+"
split = lambda t: [w for w in re.split(SPACE, t or "") if w]


def measures(t):
    ws = split(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)}
    lines = [l for l in (t or "").split("\n") if split(l)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    rows = [r for r in awkward() if r[0] not in (6, 7)]
    rows += [(20, "a b c " * 60), (21, "x y z q " * 3 + prose(70, 9)), (22, "same line\n" * 9 + prose(60, 8)), (23, "the of " + "w### " * 80), (24, "aa aa aa")]
    got = {r["doc_id"]: r["q"] for r in quality.quality_rules(table(spark, rows), out="q").collect()}
    for key, text, *_ in rows:
        q = got[key]
        n, chars, symbols, dups, repeats = measures(text)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, chars, symbols, dups, repeats), key
        assert q["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (q["base_failed"] and q["kept"])
    assert not got[23]["kept"]


def test_quality_long_text_and_empty_table(spark):
    out = quality.quality_rules(table(spark, awkward()), out="q")
    assert out.filter("doc_id = 6").first()["q"]["n_words"] == 20_000
    assert quality.quality_rules(table(spark, []), out="q").count() == 0
    assert set(out.columns) >= {"size", "kept", "digest"}


def test_quality_thresholds_are_a_parameter(spark):
    docs = table(spark, [(1, "the of " + prose(100, 1))])
    assert quality.quality_rules(docs, out="q").first()["q"]["kept"]
    assert not quality.quality_rules(docs, out="q", thresholds=[("n_words", 500, None)]).first()["q"]["kept"]


def norm(t):
    return hashlib.sha256(re.sub(SPACE, "", t or "").encode()).digest()


def test_exact_dedup_equals_brute_force(spark):
    ensure_checkpoint_dir(spark)
    rows = awkward() + [(30, "o n e"), (31, "o  n e"), (32, "on e"), (None, "one"), (None, None)]
    got = exact.exact_dedup(table(spark, rows), exact.fresh_index(spark, 4)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    for g in got:
        group = groups[bytes(g["digest"])]
        ids = [r for r in group if r[0] is not None]
        best = min(ids, key=lambda r: (-len(r[1] or ""), r[0]))[0] if ids else None
        longest = max(len(r[1] or "") for r in group)
        if any(len(r[1] or "") == longest and r[0] is not None for r in group):
            assert g["keep_id"] == best
        assert g["group_size"] == len(group)
        assert g["kept"] == (g["doc_id"] == g["keep_id"])


def test_exact_index_remembers_and_can_be_run_again(spark):
    index = exact.fresh_index(spark, 4)
    first = exact.exact_dedup(table(spark, [(1, "a"), (2, "b")]), index, "1").collect()
    assert all(r["kept"] for r in first)
    again = exact.exact_dedup(table(spark, [(1, "a"), (2, "b")]), index, "1").collect()
    assert all(r["kept"] for r in again)
    later = {r["doc_id"]: r for r in exact.exact_dedup(table(spark, [(3, " a "), (4, "c")]), index, "2").collect()}
    assert (later[3]["keep_id"], later[3]["kept"], later[4]["kept"]) == (1, False, True)
    assert index.rows().count() == 3
    assert exact.exact_dedup(table(spark, []), index, "3").count() == 0
    reopened = exact.DigestIndex(spark, index.folder, 4)
    assert reopened.rows().count() == 3


def water(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_targets_equal_water_filling(spark):
    rows = [(i, prose(20 + 37 * i % 90, i), ("a", "b", "c", "d", None)[i * i % 5]) for i in range(150)] + [(900, None, "e"), (901, "", "f")]
    got = mixing.mix(table(spark, rows)).collect()
    sizes, taken = {}, {}
    for key, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(split(text))
    target = water(sizes)
    assert len(got) == len(rows)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(target[g["source"]])
        assert g["taken"] <= 2 * g["size"]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 110
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(table(spark, rows).repartition(5)).collect()))


def test_curriculum_follows_the_schedule(spark):
    rows = [(i, prose(50, i), "ab"[i % 2]) for i in range(400)]
    order = mixing.curriculum(mixing.mix(table(spark, rows), schedules=((1.0, 1.0), (2.0, 0.1)))).collect()
    at = [r["position"] for r in order]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = [sum(r["position"] < 0.5 for r in order if r["source"] == s) / sum(r["source"] == s for r in order) for s in "ab"]
    assert abs(early[0] - 0.5) < 0.03 and early[1] > 0.7  # the integral of 2 - 1.9 t over the first half is 0.73 of the whole


def test_mix_query_stores_its_curriculum(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(mixing, "stored", lambda df, label, store=mixing.stored: kept.setdefault(label, store(df, label)))
    got = QUERIES["op2_mix_sources"](spark, "/root/testdata/sf0.001").collect()
    order = kept["mix-curriculum"].collect()
    assert order and all(0 <= r["position"] <= 1 for r in order)
    assert sum(r["size"] for r in order) == sum(g["taken"] for g in got)


def test_mix_by_curriculum_keeps_every_row(spark):
    rows = [(i % 90, prose(20 + 37 * i % 90, i), ("a", "b", "c", None)[i * i % 4]) for i in range(150)]
    rows += [(900, None, "e"), (900, None, "e"), (901, "", "a"), (901, "", "a"), (None, "x y", "b"), (None, "x y", "b")]
    mixed = mixing.mix(table(spark, rows)).cache()
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "taken", "position"]
    text = lambda found: sorted(map(repr, map(tuple, found)))
    assert text(mixing.mixed_by_curriculum(mixed).select(names).collect()) == text(mixed.select(names).collect())


def test_mix_empty_table(spark):
    assert mixing.mix(table(spark, [])).count() == 0


CHAT = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, formatted STRING, example INT"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", r"<\|im_end|> <\\s>", None, "", "plain\n\ntext", "<<SYS>> <</SYS>>" * 3, "<<|im_end|>|im_end|>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t, "f", 1) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "alone", "f", 1), (3, 0, "user", "open", "f", 1), (4, 0, "we\nird <|im_end|>", "x", "f", 1), (4, 1, None, "y", "f", 1), (None, 0, "assistant", "z", "f", 1)]
    rows += [(5, i, ("system", "user", "assistant")[i % 3], prose(30, i), "f", 1) for i in range(301)]
    written = chat.examples(spark.createDataFrame(rows, CHAT)).cache()
    got = {r["conv_id"]: r for r in chat.summary(written).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = written.filter("conv_id = 1").orderBy("example").collect()
    assert len(shown) == 4 and all(r["formatted"].count("<|im_end|>") == r["n_turns"] for r in shown)
    assert chat.examples(spark.createDataFrame([], CHAT)).count() == 0
