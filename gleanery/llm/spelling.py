"""Spelling variants: words a single edit apart, found by dense prefix-suffix tiles.

1. Runs of letters are counted over all texts; the vocabulary is what is long and frequent
   enough.
2. Two words, the longer of M code points, are a single edit apart when their common
   prefix and common suffix together reach M - 1. Cut M places into segments of SEGMENT: the
   edit lies in the segment where the common prefix ends, so both words agree left and right
   of it. Each word gets a key per segment, from what is left and right of it, for its own
   length and, as the shorter word of a pair, for one more. Words that share a key
   are a block; a block has at most as many words as a segment has spellings, whatever
   the corpus, and no two words of different blocks need be compared.
3. A task sorts its keys, pads the words of its blocks to matrices of code points, stacks
   blocks of like size, and compares tiles, a block of rows against another, densely: prefix length,
   suffix length, and whether they reach. Blocks larger than a tile are cut, and all pairs of
   their parts are tiles. A pair counts in the one segment where its prefix ends.
4. A word's near words are counted and the most frequent one chosen; that choice is followed
   to its end by doubling pointers.

Defined results: a null text has no runs; rows that share an id each count; with a null
id the id is empty in what is hashed; equal counts are decided by code points; an empty
table or one without frequent words gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

LETTERS = r"A-Za-zÀ-ÿ"
#: Length of a word, its count, and how many times as frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Code points of a segment; longer words are cut into at most SEGMENTS.
SEGMENT, SEGMENTS = 2, 64
#: Rows of a tile, and cells (rows x rows x code points) compared at a time.
TILE, CELLS = 128, 1 << 21


def slipped(docs: DataFrame, every: int = 31, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word) of every run of letters that can be long enough; one of `every` runs, by a hash, has lost a code point."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")).alias("id"), run)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words frequent enough. Counts combine before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keys() -> Column:
    """One (key, m, segment) per segment of a word, as the longer word of a pair or one of two equal ones, and as the shorter."""
    length = F.char_length("word")

    def of(longer: Column) -> Column:
        width = F.greatest(F.lit(SEGMENT), F.ceil(longer / SEGMENTS).cast("int"))
        last = F.ceil(longer / width).cast("int") - 1

        def one(i: Column) -> Column:
            right = F.greatest(longer - (i + 1) * width, F.lit(0))
            left = F.substring(F.col("word"), F.lit(1), i * width)
            return F.struct(
                F.xxhash64(longer, i, left, F.substring(F.col("word"), length - right + 1, right)).alias("key"),
                longer.cast("int").alias("m"), i.cast("int").alias("segment"),
            )

        return F.transform(F.sequence(F.lit(0), last), one)

    return F.concat(of(length), of(length + 1))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points from the left, the same from the right, lengths); cells past a word are 0."""
    size = np.array([len(w) for w in words])
    left = np.array(words, f"U{size.max()}").view(np.uint32).reshape(len(words), -1)
    place = size[:, None] - 1 - np.arange(left.shape[1])[None]
    right = np.where(place >= 0, np.take_along_axis(left, np.maximum(place, 0), 1), 0)
    if left.max() < 256:
        left, right = left.astype(np.uint8), right.astype(np.uint8)
    return left, right, size


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of all pairs of rows of stacked tiles a and b: (tiles, rows, rows)."""
    differ = a[:, :, None, :] != b[:, None, :, :]
    return np.where(differ.any(axis=3), differ.argmax(axis=3), a.shape[2])


def _tiles(starts: np.ndarray, sizes: np.ndarray, limit: int):
    """Row numbers (tiles, rows) of like-sized tiles and of their partners, -1 where a tile ends; a tile's partner may be itself."""
    for rows in (1 << b for b in range(1, limit.bit_length())):
        own = (sizes <= rows) & (sizes > rows // 2) & (sizes > 1)
        if own.any():
            at = starts[own][:, None] + np.arange(rows)[None]
            at = np.where(np.arange(rows)[None] < sizes[own][:, None], at, -1)
            yield at, at, True
    for start, size in zip(starts[sizes > limit], sizes[sizes > limit]):
        parts = [np.arange(a, min(a + limit, start + size)) for a in range(start, start + size, limit)]
        parts = [np.concatenate([p, np.full(limit - len(p), -1)])[None] for p in parts]
        for i, p in enumerate(parts):
            for j in range(i, len(parts)):
                yield p, parts[j], i == j


def single_edits(words: list[str], key: np.ndarray, m: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (u, v) of the pairs a single edit apart, of rows sorted by (key, m, segment)."""
    edge = np.flatnonzero((key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (segment[1:] != segment[:-1])) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    us, vs = [], []
    # blocks of words of like length are stacked, so that a long word pads few others
    scale = np.ceil(np.log2(m[starts])).astype(int) if len(starts) else np.zeros(0, int)
    for s in np.unique(scale):
        limit = max(2, min(TILE, 1 << (int((CELLS >> s) ** 0.5).bit_length() - 1)) if CELLS >> s else 2)
        for at, to, own in _tiles(starts[scale == s], sizes[scale == s], limit):
            step = max(1, CELLS // (at.shape[1] ** 2 << s))
            for k in range(0, len(at), step):
                a, b = at[k : k + step], to[k : k + step]
                used, back = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
                left, right, size = _matrices([words[i] if i >= 0 else "" for i in used])
                x, y = back[: a.size].reshape(a.shape), back[a.size :].reshape(b.shape)
                prefix, suffix = _agree(left[x], left[y]), _agree(right[x], right[y])
                longer, shorter = np.maximum(size[x][:, :, None], size[y][:, None, :]), np.minimum(size[x][:, :, None], size[y][:, None, :])
                prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
                first = a[:, :1]  # every row of a block has its m and segment
                width = np.maximum(SEGMENT, -(-m[first] // SEGMENTS))
                begin = (segment[first] * width)[:, :, None]
                near = (prefix + suffix >= longer - 1) & (longer == m[first][:, :, None]) & (shorter >= longer - 1) & (prefix < longer)
                near &= (prefix >= begin) & (prefix < begin + width[:, :, None]) & (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
                if own:
                    near &= np.arange(a.shape[1])[:, None] < np.arange(a.shape[1])[None]
                t, i, j = np.nonzero(near)
                us.append(a[t, i])
                vs.append(b[t, j])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def near_words(vocab: DataFrame, tasks: int | None = None) -> DataFrame:
    """(word, other, other_n): each pair of words a single edit apart, both ways round."""

    def compare(batches):
        waiting = None  # a block may go on in the next batch
        for batch in _with_end(batches):
            if batch is not None and batch.num_rows:
                waiting = pa.concat_tables([waiting, pa.Table.from_batches([batch])]) if waiting is not None else pa.Table.from_batches([batch])
            if waiting is None:
                return
            key = waiting.column("key").to_numpy()
            ends = len(key) if batch is None else int(np.flatnonzero(key != key[-1])[-1] + 1) if (key != key[-1]).any() else 0
            ready, waiting = waiting.slice(0, ends), waiting.slice(ends)
            if not ends:
                continue
            # only rows whose key another row has are turned into words
            key = key[:ends]
            same = key[1:] == key[:-1]
            ready = ready.filter(pa.array(np.concatenate([same, [False]]) | np.concatenate([[False], same])))
            if ready.num_rows:
                words, n = ready.column("word").to_pylist(), ready.column("n").to_numpy()
                u, v = single_edits(words, *(ready.column(c).to_numpy() for c in ("key", "m", "segment")))
                for a, b in ((u, v), (v, u)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()), pa.array(n[b], pa.int64())],
                        names=["word", "other", "other_n"],
                    )

    keyed = vocab.select("word", "n", F.explode(_keys()).alias("k")).select("k.key", "k.m", "k.segment", "word", "n")
    dealt = keyed.repartition(tasks, "key") if tasks else keyed.repartition("key")
    return dealt.sortWithinPartitions("key", "m", "segment").mapInArrow(compare, "word STRING, other STRING, other_n BIGINT")


def _with_end(batches):
    yield from batches
    yield None


def variants(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `vocab` (word, n)."""
    vocab = stored(vocab, "spelling-words")
    # the most frequent, then the least by code points, which a string's bytes agree with
    best = F.min(F.struct((-F.col("other_n")).alias("back"), "other"))
    met = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = vocab.join(met, "word", "left")
    far = -F.col("best.back") >= times * F.col("n")
    judged = stored(known.select(
        "word", F.when(far, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, -F.col("best.back")).alias("form_n"),
    ), "spelling-judged")
    # a form is `times` as frequent, so a chain has few steps; each round doubles them
    steps = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = stored(steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        if longer.filter("moved").isEmpty():
            break
        steps = longer.select("word", "root")
    return judged.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
