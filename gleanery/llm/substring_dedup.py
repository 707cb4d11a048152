"""Removal of repeated byte strings by triggers and hash matching, without suffix arrays.

Every string of LENGTH bytes is to go that also starts earlier in the corpus. Sorting all
suffixes would say which; sorting every suffix of a corpus is what the parse avoids:

1. A rolling hash over GRAM bytes picks triggers: in every LENGTH bytes the gram with the
   least hash. Equal strings have their trigger at the same place, and triggers are a few
   hundredths of all positions. They cut a text into phrases that overlap by a gram, none
   a prefix of another with the same trigger.
2. The dictionary: the starts that share a trigger occurrence form a segment, and equal
   segments (by content) are one entry with its first occurrence. All starts of a later
   occurrence are repeats, which settles copies of any size without comparing their
   bytes. Such segments are flagged; they go through the shuffle like the others.
3. Only entries that share a trigger and differ are compared further: for every number of
   bytes in front of the trigger, the LENGTH bytes from there are sorted by a 64-bit hash,
   not in suffix order; equal neighbours are repeats, all but the first in corpus order. A trigger with very many entries is split
   by the bytes before or after it, whichever side the string has more of.
4. The repeated starts of a text, as ranges, give the bytes to remove.

Defined results: null text is empty; a text shorter than LENGTH loses nothing; matches
never cross texts; a row with a null id is kept whole and never counts as earlier; rows
that share an id are read as one place, and each loses what is found repeated in either
at those positions; an empty table gives an empty result; other columns are not looked at.
Segments and strings are compared by 64-bit hashes beside their trigger.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LENGTH, GRAM = 100, 40
REST = LENGTH - GRAM
HALF = REST // 2
#: Bytes of text hashed at a time in a task.
BLOCK = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any slices of a block of bytes, from one running sum."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 97):
        self.bytes = np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if n > len(self.powers):
            size = max(n, min(2 * n, BLOCK))
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[: n - 1], out=self.sums[1:])

    def slices(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix((self.sums[last] - self.sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))


def segments(raw: list[bytes], roll: RollingHash):
    """(text number, start, starts, bytes before the trigger, trigger hash, content hash) of every segment."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll.load(data)
    grams = np.arange(len(data) - GRAM + 1)
    gram = roll.slices(grams, grams + GRAM)
    low = np.uint64((1 << int(len(gram)).bit_length()) - 1)
    least = (gram & ~low) | grams.astype(np.uint64)  # the hash above, the place below: the leftmost least wins
    width, reach = 1, REST + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    trigger = (least & low).astype(np.int64)
    inside = np.ones(len(trigger) + 1, bool)
    inside[-1] = False
    for e in ends:
        inside[max(0, e - LENGTH + 1) : e] = False
    # a text shorter than LENGTH has no start: those before its end are out already, those before its begin belong to others
    begins = np.concatenate([[0], ends[:-1]])
    for b, e in zip(begins, ends):
        if e - b < LENGTH:
            inside[b:e] = False
    valid = inside[:-1]
    change = np.ones(len(trigger), bool)
    change[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & change)
    stop = np.ones(len(trigger), bool)
    stop[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    text = np.searchsorted(ends, first, side="right")
    at = trigger[first]
    return text, first - begins[text], last - first + 1, at - first, gram[at], roll.slices(first, last + LENGTH)


def _blocks(sizes: list[int]):
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total > BLOCK:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


#: `place` packs a segment: start * 65536 + number of starts * 256 + bytes before the trigger.
PLACE = 65536


def dictionary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, content, doc_id, place, settled): segments; `settled` ones repeat one of their own batch."""

    def parse(batches):
        roll = RollingHash()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found = []
            for a, b in _blocks([len(r) for r in raw]):
                n, start, starts, before, gram, content = segments(raw[a:b], roll)
                found.append(np.stack([gram.view(np.int64), content.view(np.int64), keys[a + n], start * PLACE + starts * 256 + before]))
            if not found:
                continue
            gram, content, doc, place = np.concatenate(found, axis=1)
            order = np.lexsort((place, doc, content, gram))
            gram, content, doc, place = gram[order], content[order], doc[order], place[order]
            settled = np.zeros(len(gram), bool)
            settled[1:] = (gram[1:] == gram[:-1]) & (content[1:] == content[:-1])
            for at in range(0, len(gram), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[cut]), pa.array(content[cut]), pa.array(doc[cut]), pa.array(place[cut]), pa.array(settled[cut])],
                    names=["gram", "content", "doc_id", "place", "settled"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    return source.mapInArrow(parse, "gram BIGINT, content BIGINT, doc_id BIGINT, place BIGINT, settled BOOLEAN")


def _neighbours(docs: DataFrame, open_: DataFrame, key: str, text: str) -> DataFrame:
    """(part, gram, doc_id, place, side, bytes): the bytes around open triggers, once for each side that can be the longer."""
    places = open_.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place")).alias("places"))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(places, "doc_id")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (t or "").encode()
                for f in found:
                    gram, place = f["gram"], f["place"]
                    start, starts, before = place // PLACE, place // 256 % 256, place % 256
                    at, end = start + before, start + starts - 1 + LENGTH
                    if end > len(raw):
                        continue  # a place of another text with this id
                    if before >= HALF:  # strings with HALF bytes or more before the trigger
                        near, window = raw[at - HALF : at], raw[start : min(end, at + GRAM + REST - HALF)]
                        rows = [(b"L" + near, window, 0)]
                    else:
                        rows = []
                    if end - at - GRAM > REST - HALF:  # strings with more than REST - HALF bytes after it
                        rows.append((b"R" + raw[at + GRAM : at + GRAM + REST - HALF + 1], raw[max(start, at - HALF + 1) : end], 1))
                    for near, window, side in rows:
                        part = int.from_bytes(hashlib.blake2b(near + gram.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                        for column, value in zip(out, (part, gram, doc, place, side, window)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()),
                 pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())], names=["part", "gram", "doc_id", "place", "side", "bytes"],
            )

    return source.mapInArrow(cut, "part BIGINT, gram BIGINT, doc_id BIGINT, place BIGINT, side INT, bytes BINARY")


def repeated_in_order(pdf, roll: RollingHash):
    """Ranges (doc_id, first, last) of repeated starts among entries of the same parts."""
    import pandas as pd

    doc, place, side = pdf["doc_id"].to_numpy(), pdf["place"].to_numpy(), pdf["side"].to_numpy()
    part = pdf["part"].to_numpy().view(np.uint64)
    start, starts, before = place // PLACE, place // 256 % 256, place % 256
    at, last = start + before, start + starts - 1
    raw = pdf["bytes"].tolist()
    sizes = np.array([len(r) for r in raw], np.int64)
    base = np.cumsum(sizes) - sizes  # of a row's bytes in the block
    begin = np.where(side == 0, start, np.maximum(start, at - HALF + 1))  # text position of a row's first byte
    roll.load(np.frombuffer(b"".join(raw), np.uint8))
    repeats = np.zeros((len(pdf), REST + 1), bool)
    for k in range(REST + 1):  # bytes before the trigger: the length of the phrase suffix
        p = at - k
        rows = np.flatnonzero((p >= start) & (p <= last) & (side == (0 if k >= HALF else 1)))
        if len(rows) < 2:
            continue
        where = base[rows] + p[rows] - begin[rows]
        value = roll.slices(where, where + LENGTH) ^ part[rows]
        order = np.lexsort((p[rows], doc[rows], value))
        again = value[order][1:] == value[order][:-1]
        repeats[rows[order[1:][again]], k] = True
    edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, k1 = np.nonzero(edge == 1)
    _, k2 = np.nonzero(edge == -1)  # exclusive
    return pd.DataFrame({"doc_id": doc[row], "first": at[row] - (k2 - 1), "last": at[row] - k1})


def repeated_starts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first, last): ranges of starts whose LENGTH bytes also start earlier."""
    spark = docs.sparkSession
    entries = Window.partitionBy("gram").orderBy("content", "doc_id", "place")
    whole = Window.partitionBy("gram")
    ordered = dictionary(docs, key, text).select(
        "*", (F.col("settled") | F.coalesce(F.lag("content").over(entries) == F.col("content"), F.lit(False))).alias("later"),
        (F.min("content").over(whole) != F.max("content").over(whole)).alias("open"),
    )
    found = stored(ordered.filter("later OR open").select("gram", "doc_id", "place", "later"), "repeat-entries")
    first = F.expr(f"place div {PLACE}")
    copies = found.filter("later").select("doc_id", first.alias("first"), (first + F.expr("place div 256 % 256") - 1).alias("last"))
    around = _neighbours(docs, found.filter("NOT later"), key, text)
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(pdf):
        return repeated_in_order(pdf, RollingHash())

    bucket = F.pmod(F.xxhash64("part"), F.lit(parts)).alias("bucket")
    others = around.groupBy(bucket).applyInPandas(compare, "doc_id BIGINT, first BIGINT, last BIGINT")
    return stored(copies.unionByName(others), "repeat-ranges")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): spans are the removed byte ranges, kept the bytes left."""
    ranges = repeated_starts(docs, key, text).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ranges, "doc_id", "left")

    def cut(batches):
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, runs, left = t.encode(), [], []
                for first, stop in sorted((f["first"], f["last"] + LENGTH) for f in found or ()):
                    stop = min(stop, len(raw))
                    if first >= stop:
                        continue
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([first, stop])
                at = 0
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in runs))
                spans.append([{"first": a, "last": b} for a, b in runs])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return source.mapInArrow(cut, "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, spans ARRAY<STRUCT<first: BIGINT, last: BIGINT>>, kept BINARY")
