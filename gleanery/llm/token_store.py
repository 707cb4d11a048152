"""Token-id files with keyed access through a minimal perfect hash index.

A store is a folder:
- `shard-N.ids`: ids of the documents of one key range, in ascending key order, as
  little-endian unsigned 16-bit integers; then the offset of each document (n + 1
  unsigned 64-bit), then the number of documents, the number of ids and a mark.
- `index-N.mph`: the keys whose hash falls to part N. A minimal perfect hash gives a key its
  slot; the slot holds a fingerprint of the key, its shard, its first document there and
  how many documents carry the key. A lookup is a few array reads, whatever the size.
- `manifest`: one row per shard with its number of ids and the ids before it.

Documents are range-partitioned by key, each task writes its shard under a private name
and renames it when complete, so a task that runs twice leaves one whole file.

Defined results: null text is empty and still carries the end id; documents that share
a key follow each other, ordered by text, and share an index slot; documents with a null key stand before all
others and are found through the manifest; an empty table gives an empty store; other
columns are not looked at.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored
from .tokens import default_path, encode

END_ID, MARK = 2, b"IDSHARD1"


# --- files ----------------------------------------------------------------------------


def _place(uri: str):
    """File system and path of a folder; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _put(uri: str, name: str, parts) -> None:
    files, folder = _place(uri)
    private = f"{folder}/.{name}-{uuid.uuid4().hex}"
    files.create_dir(folder)
    with files.open_output_stream(private) as out:
        for part in parts:
            out.write(part)
    files.move(private, f"{folder}/{name}")


# --- the minimal perfect hash ---------------------------------------------------------


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays. A key that is alone at its position of a level sets the bit
    there; the others go on to the next level. A key's slot is the number of set bits before its own."""

    SPARE = 1.7

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, levels, left = [], [], keys
        while len(left):
            size = 64 * int(np.ceil(max(1.0, cls.SPARE * len(left)) / 64))
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("a key is given twice")
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.packbits(flags, bitorder="little").view("<u8")
        counts = flags.reshape(-1, 64).sum(axis=1) if len(flags) else np.zeros(0, int)
        return cls(sizes, bits, (np.cumsum(counts) - counts).astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has a bit for it (certainly not a key)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class KeyIndex:
    """Part of the index in memory: keys -> (found, shard, first document, documents)."""

    FIELDS = (("marks", "<u2"), ("shards", "<u4"), ("firsts", "<u4"), ("counts", "<u4"))

    def __init__(self, table: PerfectHash, columns: dict[str, np.ndarray]):
        self.table, self.columns = table, columns

    @staticmethod
    def mark(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1000) >> np.uint64(48)).astype("<u2")

    @classmethod
    def build(cls, keys: np.ndarray, shards, firsts, counts) -> "KeyIndex":
        keys = keys.astype(np.uint64)
        table = PerfectHash.build(keys)
        at = table.slots(keys)
        columns = {}
        for (name, kind), values in zip(cls.FIELDS, (cls.mark(keys), shards, firsts, counts)):
            columns[name] = np.zeros(len(keys), kind)
            columns[name][at] = values
        return cls(table, columns)

    def parts(self):
        head = json.dumps({"sizes": self.table.sizes, "keys": len(self.columns["marks"])}).encode()
        yield len(head).to_bytes(8, "little")
        yield head
        for a in (self.table.bits, self.table.ranks, *(self.columns[n] for n, _ in self.FIELDS)):
            yield a.tobytes()

    @classmethod
    def load(cls, data: bytes) -> "KeyIndex":
        at = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:at])
        words, columns = sum(head["sizes"]) // 64, {}

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        table = PerfectHash(head["sizes"], read("<u8", words), read("<u4", words))
        for name, kind in cls.FIELDS:
            columns[name] = read(kind, head["keys"])
        return cls(table, columns)

    def find(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        at = self.table.slots(keys)
        found = at >= 0
        at = np.where(found, at, 0)
        if not len(self.columns["marks"]):
            return found & False, at, at, at
        found &= self.columns["marks"][at] == self.mark(keys)
        return found, *(self.columns[n][at] for n in ("shards", "firsts", "counts"))


# --- writing --------------------------------------------------------------------------


class TokenStore:
    def __init__(self, spark: SparkSession, folder: str, parts: int):
        self.spark, self.folder, self.parts = spark, folder, parts

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def locate(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, shard, first, count) of each key of `keys` that is in the store; keys are bigint, not null.

        A task loads the index parts of its own keys only.
        """
        folder = self.folder

        def look(batches):
            loaded: tuple[int, KeyIndex] | None = None
            for batch in batches:
                part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                for p in np.unique(part):
                    if loaded is None or loaded[0] != p:
                        files, path = _place(folder)
                        with files.open_input_file(f"{path}/index-{p:05d}.mph") as f:
                            loaded = (p, KeyIndex.load(f.read()))
                    mine = key[part == p]
                    found, shards, firsts, counts = loaded[1].find(mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mine[found], pa.int64()), pa.array(shards[found].astype(np.int32)), pa.array(firsts[found].astype(np.int64)),
                         pa.array(counts[found].astype(np.int64))], names=["key", "shard", "first", "count"],
                    )

        asked = keys.select(self._part(F.col(key).cast("long")).alias("part"), F.col(key).cast("long").alias("key")).filter("key IS NOT NULL")
        return asked.repartition("part").sortWithinPartitions("part").mapInArrow(look, "key BIGINT, shard INT, first BIGINT, count BIGINT")

    def without_key(self) -> DataFrame:
        """Documents whose key is null, as locate() gives others."""
        return self.manifest().filter("n_null > 0").select(
            F.lit(None).cast("long").alias("key"), "shard", F.lit(0).cast("long").alias("first"), F.col("n_null").alias("count")
        )

    def read(self, located: DataFrame) -> DataFrame:
        """(key, start, ids) of located documents: ids as little-endian unsigned 32-bit, start counted over the whole store."""
        folder = self.folder

        def fetch(batches):
            opened = None
            for batch in batches:
                keys, shards, firsts, counts, bases = (batch.column(i).to_pylist() for i in range(5))
                rows = [[], [], []]
                size = 0
                for key, shard, first, count, base in zip(keys, shards, firsts, counts, bases):
                    if opened is None or opened[0] != shard:
                        files, path = _place(folder)
                        f = files.open_input_file(f"{path}/shard-{shard:05d}.ids")
                        f.seek(f.size() - 24)
                        n, total = np.frombuffer(f.read(16), "<u8")
                        opened = (shard, f, int(total))
                    _, f, total = opened
                    f.seek(2 * total + 8 * first)
                    offsets = np.frombuffer(f.read(8 * (count + 1)), "<u8").astype(np.int64)
                    f.seek(2 * int(offsets[0]))
                    ids = np.frombuffer(f.read(2 * int(offsets[-1] - offsets[0])), "<u2").astype("<u4")
                    for a, b in zip(offsets[:-1], offsets[1:]):
                        rows[0].append(key)
                        rows[1].append(base + int(a))
                        rows[2].append(ids[a - offsets[0] : b - offsets[0]].tobytes())
                        size += 4 * int(b - a)
                    if size > 8_000_000:
                        yield _rows(rows)
                        rows, size = [[], [], []], 0
                yield _rows(rows)

        def _rows(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["key", "start", "ids"]
            )

        based = located.join(self.manifest().select("shard", "base"), "shard").select("key", "shard", "first", "count", "base")
        return based.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(fetch, "key BIGINT, start BIGINT, ids BINARY")


def write_store(
    docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
    parts: int | None = None,
) -> TokenStore:
    """Tokenise `docs` and write shards, index and manifest. Returns the store."""
    spark = docs.sparkSession
    path, folder = tokenizer or default_path(), folder or shared_folder(spark, "token-store")
    store = TokenStore(spark, folder, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def shard(batches):
        number = TaskContext.get().partitionId()
        keys, lengths, end = [], [], np.array([end_id], "<u2").tobytes()

        def payload():
            for batch in batches:
                keys.extend(batch.column(0).to_pylist())
                for ids in encode(batch.column(1).to_pylist(), path):
                    lengths.append(len(ids) // 2 + 1)
                    yield ids + end
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<u8")
            yield offsets.tobytes() + np.array([len(lengths), offsets[-1]], "<u8").tobytes() + MARK

        _put(folder, f"shard-{number:05d}.ids", payload())
        known = np.array([k for k in keys if k is not None], np.int64)
        n_null = len(keys) - len(known)
        starts = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]])) if len(known) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([starts, [len(known)]]))
        total, n = int(np.sum(lengths, dtype=np.int64)), len(starts)
        first = known[starts] if n else known
        yield pa.RecordBatch.from_arrays(  # the first row speaks for the shard
            [pa.array([None, *first.tolist()], pa.int64()), pa.array([number] * (n + 1), pa.int32()), pa.array([n_null, *(starts + n_null).tolist()], pa.int64()),
             pa.array([len(keys), *counts.tolist()], pa.int64()), pa.array([total] + [None] * n, pa.int64())],
            names=["key", "shard", "first", "count", "total"],
        )

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = source.repartitionByRange("key").sortWithinPartitions("key", "text")
    entries = stored(ordered.mapInArrow(shard, "key BIGINT, shard INT, first BIGINT, count BIGINT, total BIGINT"), "token-entries")
    shards = entries.filter("total IS NOT NULL").select("shard", F.col("first").alias("n_null"), F.col("count").alias("n_docs"), "total")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long"))).write.parquet(f"{folder}/manifest")

    def index(batches):
        held: dict[int, list] = {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            for p in np.unique(part):
                held.setdefault(int(p), []).append(np.stack([batch.column(i).to_numpy().astype(np.int64)[part == p] for i in range(1, 5)]))
        for p, found in held.items():
            k, s, f, c = np.concatenate(found, axis=1)
            _put(folder, f"index-{p:05d}.mph", KeyIndex.build(k, s, f, c).parts())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32())], names=["part"])

    keyed = entries.filter("total IS NULL").select(store._part(F.col("key")).alias("part"), "key", "shard", "first", "count")
    keyed.repartition(store.parts, "part").mapInArrow(index, "part INT").write.parquet(f"{folder}/index-parts")
    return store


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that TokenStore.read() gave."""
    return read.select(
        F.col("key").alias("doc_id"), "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
