"""Near-duplicates, token store, packing and toxicity on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import near_dedup, packing, token_store, tokens, toxicity

from .cases import awkward, prose, table

SPACE = "[\x20\x09-\x0D]+"


def shingles(text, n):
    ws = [w for w in re.split(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def components(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, share, seed):
    rng, ws = random.Random(seed), text.split(" ")
    for _ in range(max(1, int(len(ws) * share))):
        ws[rng.randrange(len(ws))] = prose(1, rng.randint(0, 10**6))
    return " ".join(ws)


def near_case():
    rows = [(r[0], r[1]) for r in awkward()]
    for g in range(8):  # groups at several distances
        base = prose(150, 1000 + g)
        rows += [(100 + 10 * g + k, edited(base, (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)[k], 7 * g + k)) for k in range(6)]
    chain = prose(200, 5)  # each near its neighbour, the ends far apart
    for k in range(12):
        rows.append((500 + k, chain))
        chain = edited(chain, 0.02, k)
    rows += [(600 + k, prose(60, k // 3)) for k in range(12)]
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    rows = near_case()
    got = near_dedup.near_dedup(table(spark, rows).repartition(3), shingle=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_goes_on_to_cross_component_rounds(spark):
    base = prose(120, 42)
    rows = [(i, edited(base, 0.04, i)) for i in range(80)]
    got = near_dedup.near_dedup(table(spark, rows), shingle=4).collect()
    want = components(rows, 4)
    assert len({w[1] for w in want.values()}) > 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_dedup_repeated_and_null_ids_and_empty_table(spark):
    a, b = prose(100, 1), prose(100, 2)
    rows = [(7, a), (7, b), (8, a), (9, b), (9, b), (None, a)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(table(spark, rows)).collect())
    assert got == [(7, 7), (7, 7), (8, 7), (9, 7), (9, 7)]
    assert near_dedup.near_dedup(table(spark, [])).count() == 0


def test_every_pair_within_the_distance_shares_a_key(spark):
    rng = np.random.default_rng(3)
    size = near_dedup.CHUNKS * near_dedup.WIDTH
    rows = []
    for i in range(60):
        one = rng.integers(0, 65536, size).astype("<u2")
        two = one.copy()
        two[rng.choice(size, near_dedup.DISTANCE, replace=False)] ^= 1
        rows += [(2 * i, bytearray(one.tobytes())), (2 * i + 1, bytearray(two.tobytes()))]
    keys = near_dedup.index_keys(spark.createDataFrame(rows, "doc_id BIGINT, signature BINARY")).collect()
    held = {}
    for k in keys:
        held.setdefault(k["doc_id"], set()).add(k["key"])
    assert all(held[2 * i] & held[2 * i + 1] for i in range(60))


# --- tokens ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.lists(st.sampled_from(["Word.", "ÉTÉ,", "don't", "<|endoftext|>", "\n", " ", "  ", "\t", "x1", "Ǆ", "é", "...", " ", "İ"]), max_size=12))
def test_piecewise_ids_equal_the_tokenizer(tokenizer, text, parts):
    whole = text + "".join(parts)
    got = list(np.frombuffer(next(tokens.encode([whole], tokens.default_path())), "<u2"))
    assert got == ids_of(tokenizer, whole)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_reads_back_every_document(spark, tokenizer):
    rows = awkward() + [(4, "the same id"), (None, "no id"), (None, "no id either"), (2**62, "far"), (-(2**62), "near")]
    docs = table(spark, rows).repartition(4)
    store = token_store.write_store(docs, parts=3)
    found = store.locate(docs.select("doc_id").distinct()).unionByName(store.without_key())
    got = sorted(tuple(r) for r in token_store.digests(store.read(found)).collect() if r["doc_id"] is not None)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for r in order:
        ids = ids_of(tokenizer, r[1]) + [token_store.END_ID]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(w for w in want if w[0] is not None)
    assert store.read(store.without_key()).count() == 2
    assert store.locate(spark.createDataFrame([(12345,), (99,)], "doc_id BIGINT")).count() == 0


def test_token_store_empty_table(spark):
    store = token_store.write_store(table(spark, []), parts=2)
    assert store.read(store.without_key()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal_and_keys_are_found(keys):
    keys = np.array(sorted(keys), np.int64)
    n = np.arange(len(keys))
    index = token_store.KeyIndex.build(keys, n, n + 1, n + 2)
    assert sorted(index.table.slots(keys.astype(np.uint64))) == list(n)
    index = token_store.KeyIndex.load(b"".join(index.parts()))
    found, shards, firsts, counts = index.find(keys)
    assert found.all() and (shards == n).all() and (firsts == n + 1).all() and (counts == n + 2).all()


# --- packing --------------------------------------------------------------------------


def check_runs(counts, runs, capacity):
    filled, seen = {}, {}
    for length, first, n, sequence, offset in runs:
        for k in range(n):
            filled.setdefault(sequence + k, []).append((offset, length))
            seen.setdefault(length, []).append(first + k)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def best_fit_decreasing(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - length)
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 12), max_size=30))
def test_plan_places_every_piece_once_without_gaps(counts):
    used = check_runs(counts, packing.plan(counts, 100), 100)
    total = sum(k * n for k, n in counts.items())
    assert -(-total // 100) <= used <= 1.7 * total / 100 + 2


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    counts = {}
    for _ in range(6000):
        length = min(4096, max(1, int(rng.lognormvariate(6.6, 1))))
        counts[length] = counts.get(length, 0) + 1
    used = check_runs(counts, packing.plan(counts), 4096)
    assert used <= 1.005 * sum(k * n for k, n in counts.items()) / 4096 + 2


def test_plan_finds_configurations_that_greedy_misses():
    counts = {51: 60, 27: 60, 26: 60, 23: 120}  # 51 + 26 + 23 and 27 + 27 + 23 + 23 fill 100
    used = check_runs(counts, packing.plan(counts, 100), 100)
    assert used <= best_fit_decreasing(counts, 100)


def test_packing_equals_the_tokenizer(spark, tokenizer):
    rows = awkward() + [(50 + i, prose(10 + i, i)) for i in range(60)] + [(70, "again"), (None, "no id"), (None, None)]
    cut = packing.pieces(table(spark, rows).repartition(3)).cache()
    packed = packing.pack(cut).cache()
    want = {}
    for r in rows:
        ids = ids_of(tokenizer, r[1]) + [packing.END_ID]
        for n, at in enumerate(range(0, len(ids), 4096)):
            want.setdefault((r[0], n), []).append((at, ids[at : at + 4096]))
    got, sequences = {}, {}
    for r in packed.collect():
        ids = list(np.frombuffer(bytes(r["ids"]), "<u4"))
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length, ids in sorted(parts):
            assert offset == at and length == len(ids)
            at += length
        assert at <= 4096
    unique = packed.filter("doc_id BETWEEN 51 AND 69")
    for r in packing.sequences(unique, cut.filter("doc_id BETWEEN 51 AND 69")).collect():
        parts = [p for p in unique.filter(f"sequence_id = {r['sequence_id']}").orderBy("offset").collect()]
        assert bytes(r["ids"]) == b"".join(bytes(p["ids"]) for p in parts) and r["length"] == sum(p["length"] for p in parts)
        break
    assert packing.pack(packing.pieces(table(spark, []))).count() == 0


# --- toxicity -------------------------------------------------------------------------

INSULTS = ["blockhead", "nitwit", "dunce"]


def toxic_case():
    rows, labels = [], []
    for i in range(500):
        text, bad = prose(60, i), i % 5 == 0
        if bad:
            ws = text.split(" ")
            ws.insert(i % 50, random.Random(i).choice(INSULTS))
            text = " ".join(ws)
        rows.append((i, text))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_and_disguised_texts(spark):
    rows, labels = toxic_case()
    probes = {1000: "bl0ckhe4d", 1001: "n i t w i t", 1002: "duuuunce", 1003: "n1twit", 1004: prose(1, 9), 1005: "2024-05-06", 1006: "b@a.org"}
    docs = rows + [(k, f"{prose(30, k)} {w} {prose(30, k + 50)}") for k, w in probes.items()] + [(r[0] + 5000, r[1]) for r in awkward()]
    marks = spark.createDataFrame(labels + labels[:10] + [(2000, 1), (None, 1), (3, None)], "doc_id BIGINT, toxic INT")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table(spark, docs), marks, teach=lambda key: key % 4 != 0).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(i, y) for i, y in labels if i % 4 == 0]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.99 * len(held)
    assert [got[k]["predicted"] for k in probes] == [1, 1, 1, 1, 0, 0, 0]
    assert all(got[r[0] + 5000]["predicted"] == 0 for r in awkward())


def test_toxicity_counts_words_over_all_labelled_rows(spark, monkeypatch):
    """A sample for the fit, here of 60 rows, must not decide which words are known."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 60)
    rows, labels = toxic_case()
    rare = [(600 + i, f"{prose(30, 600 + i)} numskull {prose(30, 700 + i)}") for i in range(8)]
    probe = [(1000, f"{prose(30, 1)} numskull {prose(30, 2)}"), (1001, prose(60, 3))]
    marks = spark.createDataFrame(labels + [(i, 1) for i, _ in rare], "doc_id BIGINT, toxic INT")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table(spark, rows + rare + probe), marks).collect()}
    assert (got[1000], got[1001]) == (1, 0)


def test_fitting_rows_keep_rare_features_and_the_bound(spark):
    rows = [(0, [0, i]) for i in range(1, 400)] * 3 + [(1, [400])] * 4 + [(0, [])] * 900
    often = np.array([1197.0] + [3.0] * 399 + [4.0])
    kept = toxicity.fitting_rows(spark.createDataFrame([(*r, 1) for r in rows], "y INT, found ARRAY<INT>, n INT"), often, 200).collect()
    assert 50 < len(kept) <= 260 and [r["stands_for"] for r in kept if not r["found"]] == [900.0]
    assert sum(r["stands_for"] for r in kept) == pytest.approx(len(rows), rel=0.3)


def test_toxicity_without_labels_and_on_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert all(r["score"] < 1e-9 for r in toxicity.score_toxicity(table(spark, [(1, "a b"), (2, None)]), none).collect())
    assert toxicity.score_toxicity(table(spark, []), none).count() == 0


def test_decoder_prefers_likely_words():
    size = (len(toxicity.LETTERS) + 1) ** 3
    counts = np.zeros(size, np.int64)
    for word in ["hello", "letter", "apple", "tall"] * 50:
        c = toxicity._codes(f"  {word} ")
        np.add.at(counts, (c[:-2] * (len(toxicity.LETTERS) + 1) + c[1:-1]) * (len(toxicity.LETTERS) + 1) + c[2:], 1)
    model = toxicity.CharacterModel(counts)
    for seen, word in {"h3llo": "hello", "heeelllo": "hello", "app1e": "apple", "t4ll": "tall", "l.e.t.t.e.r": "letter", "1etter": "letter"}.items():
        assert model.decode(seen) == word
    known = {}
    assert toxicity.restore("say h3llo and 1234 to a@b", model, known).startswith("say hello and 1234")


def test_long_pieces_and_letters_outside_the_model_are_restored():
    base = len(toxicity.LETTERS) + 1
    counts = np.zeros(base**3, np.int64)
    for word in ["hello", "dunce", "letter"] * 50:
        c = toxicity._codes(f"  {word} ")
        np.add.at(counts, (c[:-2] * base + c[1:-1]) * base + c[2:], 1)
    model = toxicity.CharacterModel(counts)
    read = lambda text: toxicity.restore(text, model, {})
    assert read("d" + "u" * 60 + "nce") == "dunce"
    long = "/".join(["some", "path", "of", "many", "words", "that", "hides", "a", "duuuunce", "and.h3llo", "in", "it"])
    assert len(long) > 40 and {"dunce", "hello", "path", "words"} <= set(re.split(r"\W", read(long)))
    assert "dunce" in read("many,words,come,before,that,is,spelled,d.u.n.c.e,here,and,here")
    assert read("д" + "у" * 5 + "рак") == "дурак" and read("\u0153" * 4 + "uf") == "\u0153uf"
    assert toxicity.beginnings(read("głuuupiec")) >= {"głup"}
    assert len(read("h3llo" * 4000)) >= 4000


@pytest.mark.parametrize("size", [1024, 40])
def test_close_pairs_across_components_are_not_rows(spark, monkeypatch, size):
    """A family whose members are close to all others and linked with few: its pairs are tried inside tiles."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(240):
        words = list(base)
        for at in rng.choice(400, 19, replace=False):
            words[at] = f"x{d}_{at}"
        rows.append((d, " ".join(words)))
    rows += [(1000 + d, text + " again") for d, text in rows[::5]]
    asked, confirm = [], near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, sets: asked.append(pairs.count()) or confirm(pairs, sets))
    monkeypatch.setattr(near_dedup, "SLICE", size, raising=False)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, shingle=4).collect()}
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, w in ((d, t.split()) for d, t in rows)}
    links = [(u, v) for u in sets for v in sets if u < v and 100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v])]
    want = {d: d for d in sets}
    while any(want[u] != want[v] for u, v in links):
        for u, v in links:
            want[u] = want[v] = min(want[u], want[v])
    assert got == want and len(set(want.values())) > 100
    assert sum(asked) < 15 * len(rows)


def test_a_tile_looks_up_shingles_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    own = np.unique(rng.integers(0, 400, 300, np.uint64))
    others = [np.unique(np.concatenate([own[n:], rng.integers(400, 800, n + 1, np.uint64)])) for n in range(0, 60, 3)]
    want = [100 * len(np.intersect1d(own, o)) >= 80 * len(np.union1d(own, o)) for o in others]
    monkeypatch.setattr(near_dedup, "LOOKUP", 500)
    widest = []
    monkeypatch.setattr(near_dedup.np, "searchsorted", lambda a, v, *rest, f=np.searchsorted: widest.append(np.size(v)) or f(a, v, *rest))
    assert near_dedup._linked(own, others).tolist() == want and len(set(want)) == 2
    assert max(widest) < 1000


def test_a_worker_gives_its_token_store_back():
    import tokenizers

    tokens.piece_ids(tokens.default_path())
    assert tokenizers._piece_ids
    tokens.release()
    assert not hasattr(tokenizers, "_piece_ids")
    tokens.release()


def test_a_store_keeps_to_the_bounds_it_is_given(tokenizer):
    texts = [prose(30, i) + f" w{i} v{i}, u{i}" for i in range(4 * tokens.BLOCK)]
    tokens.release()
    got = [np.frombuffer(raw, "<u2").tolist() for raw in tokens.encode(texts, tokens.default_path(), (50, 60))]
    store = tokens.piece_ids(tokens.default_path())
    assert got == [ids_of(tokenizer, t) for t in texts]
    assert len(store.known) <= 50 + tokens.BLOCK * 34 and len(store.known) < len({p for t in texts for p in t.split(" ")})
    list(tokens.encode(["a"], tokens.default_path()))
    assert store.kept == (tokens.KEPT_PIECES, tokens.KEPT_WORDS)
    tokens.release()
    assert max(tokens.FEW) < min(store.kept)  # of the pipeline, whose other stages run beside these stores
