"""Line deduplication that can be undone: exact reference counts behind sharded cuckoo filters.

The state is a log of references (digest of a line key, document, +1 or -1) in the
shared folder. Net references give the exact counts: in how many documents a key
stands, and the largest of them. A cuckoo filter per shard of the digest space holds
the repeated keys; it takes insertions and deletions, so adding or deleting documents
changes the filters of the shards they touch and nothing is rebuilt. Cleaning asks the
filter of a line's shard first, and only lines it lets through meet the exact counts.

Defined results: null or empty text is one empty line; a key is the line stripped of
ASCII white space at both ends with A-Z lower-cased; rows that share an id count as one
document; a null id is a document of its own and less than any other; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, shared_folder

STRIP = " \t\n\x0b\x0c\r"
#: Rows of one shard are dealt to this many tasks, so that a very common line is too.
SALTS = 8


# --- the filter -----------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets. Keys are 64-bit hashes."""

    WIDTH, KICKS = 4, 500

    def __init__(self, cells: np.ndarray):
        self.cells = cells  # buckets x WIDTH, 0 = free

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (cls.WIDTH * 0.85)))))
        return cls(np.zeros((buckets, cls.WIDTH), np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray, least: int = 0) -> "CuckooFilter":
        """A filter of all keys, of `least` buckets or more (a power of two)."""
        made = cls.sized(len(keys))
        if len(made.cells) < least:
            made = cls(np.zeros((least, cls.WIDTH), np.uint16))
        while not all(made.insert(int(k)) for k in keys):
            made = cls(np.zeros((2 * len(made.cells), cls.WIDTH), np.uint16))
        return made

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.WIDTH).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray):
        h = _mix(keys.astype(np.uint64))
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.cells) - 1)
        first = h & mask
        return mark, first, (first ^ _mix(mark.astype(np.uint64))) & mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        hit = self.cells[first] == mark[:, None]
        return (hit | (self.cells[second] == mark[:, None])).any(axis=1)

    def insert(self, key: int) -> bool:
        mark, first, second = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (first, second):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return True
        at, mask = int(second), len(self.cells) - 1
        for n in range(self.KICKS):
            slot = (n * 7 + at) % self.WIDTH
            mark, self.cells[at, slot] = self.cells[at, slot], mark
            at = (at ^ int(_mix(np.array([mark], np.uint64))[0])) & mask
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        mark, first, second = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (first, second):
            found = np.flatnonzero(self.cells[at] == mark)
            if len(found):
                self.cells[at, found[0]] = 0
                return True
        return False


# --- keys and references --------------------------------------------------------------


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def line_digest(line: Column, least: int) -> Column:
    """First half of the SHA-256 of a key with `least` code points or more; null for a shorter one."""
    key = line_key(line)
    return F.when(F.char_length(key) >= least, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def references(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, doc_id) once for each key of each row; repeats within a text fall before any shuffle."""
    digests = F.transform(_lines(F.col(text)), lambda l: line_digest(l, least))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.explode(F.array_distinct(F.filter(digests, lambda d: d.isNotNull()))).alias("digest")
    )


class LineIndex:
    """Reference counts and filters in a shared folder. `generation` is the last finished change.

    A change writes its part of the log, then the counts, then the filters, all under the
    next number. One that fails is not counted: the next change writes the same places anew.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 40, repeats: int = 5, shards: int | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "line-index")
        self.least, self.repeats = least, repeats
        self.generation = 0
        while folder and self._finished(f"filters/{self.generation + 1}"):
            self.generation += 1
        kept = self.filters().count() if self.generation else None
        self.shards = kept or shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _finished(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _log(self, upto: int | None = None) -> DataFrame:
        log = self.spark.read.schema("doc_id BIGINT, digest BINARY, delta INT, batch INT").parquet(f"{self.folder}/log")
        return log.filter(F.col("batch") <= (self.generation if upto is None else upto)).drop("batch")

    def counts(self) -> DataFrame:
        """(digest, n_docs, last_doc): exact, from net references."""
        if not self.generation:
            return self.spark.createDataFrame([], "digest BINARY, n_docs BIGINT, last_doc BIGINT")
        return self.spark.read.parquet(f"{self.folder}/counts/{self.generation}")

    def filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/filters/{self.generation}")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        self._change(references(docs, self.least, key, text), 1)

    def remove(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Take documents out again; pass the same rows that were added."""
        self._change(references(docs, self.least, key, text), -1)

    def rebuild(self) -> None:
        """Make all filters anew from the exact counts, in sizes that fit them: a change without documents."""
        self._change(self.spark.createDataFrame([], "doc_id BIGINT, digest BINARY"), 1, anew=True)

    def _change(self, refs: DataFrame, delta: int, anew: bool = False) -> None:
        number = self.generation + 1
        before = self.counts().filter(F.col("n_docs") >= self.repeats).select("digest")
        refs.withColumn("delta", F.lit(delta)).write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")
        if not self.generation:
            # one batch: a document's references are distinct already, unless rows share an id
            net = self._log(number).select("doc_id", "digest").distinct() if delta > 0 else self._log(number).limit(0)
        else:
            net = self._log(number).groupBy("digest", "doc_id").agg(F.sum("delta").alias("n")).filter("n > 0")
        counts = net.groupBy("digest").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        after_path = f"{self.folder}/counts/{number}"
        counts.write.mode("overwrite").parquet(after_path)
        after = self.spark.read.parquet(after_path).filter(F.col("n_docs") >= self.repeats).select("digest")
        if anew or not self.generation:
            made = self._built(self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("least")), after)
        else:
            made = self._turned(before, after, number)
        made.write.mode("overwrite").parquet(f"{self.folder}/filters/{number}")
        self.generation = number

    def _dealt(self, keys: DataFrame, *also: str) -> DataFrame:
        return keys.select(_shard(F.col("digest"), self.shards).alias("shard"), F.xxhash64("digest").alias("h"), *also)

    def _built(self, shards: DataFrame, keys: DataFrame) -> DataFrame:
        """New filters of `shards` (shard, least number of buckets) over all their keys."""

        def build(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked):
                return pd.DataFrame({"shard": [], "cells": []}).astype({"shard": "int32", "cells": object})
            made = CuckooFilter.build(held["h"].to_numpy().astype(np.uint64), int(asked["least"].iloc[0]))
            return pd.DataFrame({"shard": [key[0]], "cells": [made.dump()]})

        return shards.groupBy("shard").cogroup(self._dealt(keys).groupBy("shard")).applyInPandas(build, "shard INT, cells BINARY")

    def _turned(self, before: DataFrame, after: DataFrame, number: int) -> DataFrame:
        """Keys that became repeated are inserted, those that no longer are get deleted; a filter that is full is built anew, twice as large."""
        came = after.join(before, "digest", "left_anti").select("digest", F.lit(True).alias("insert"))
        went = before.join(after, "digest", "left_anti").select("digest", F.lit(False).alias("insert"))
        moved = self._dealt(came.unionByName(went), "insert")

        def turn(key, held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            new = changes["h"].to_numpy()[changes["insert"].to_numpy().astype(bool)].astype(np.uint64)
            gone = changes["h"].to_numpy()[~changes["insert"].to_numpy().astype(bool)].astype(np.uint64)
            made = CuckooFilter.load(held["cells"].iloc[0])
            buckets = len(made.cells)
            for h in gone:
                made.delete(int(h))
            full = not all(made.insert(int(h)) for h in new)
            return pd.DataFrame({"shard": [key[0]], "cells": [None if full else made.dump()], "least": [2 * buckets]})

        path = f"{self.folder}/turned/{number}"
        out = self.filters().groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(turn, "shard INT, cells BINARY, least INT")
        out.write.mode("overwrite").parquet(path)
        turned = self.spark.read.parquet(path)
        full = turned.filter("cells IS NULL").select("shard", "least")
        kept = turned.filter("cells IS NOT NULL").select("shard", "cells")
        if full.isEmpty():
            return kept
        keys = after.withColumn("shard", _shard(F.col("digest"), self.shards)).join(full, "shard", "left_semi").select("digest")
        return kept.unionByName(self._built(full, keys))

    def candidates(self, refs: DataFrame) -> DataFrame:
        """References that the filter of their shard lets through: all repeated keys and few others."""
        dealt = refs.withColumn("shard", _shard(F.col("digest"), self.shards)).withColumn(
            "salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        )
        copies = self.filters().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

        def ask(_key, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if len(held) and len(rows):
                rows = rows[CuckooFilter.load(held["cells"].iloc[0]).contains(rows["h"].to_numpy().astype(np.uint64))]
            return rows[["doc_id", "digest"]]

        rows = dealt.select("shard", "salt", "doc_id", "digest", F.xxhash64("digest").alias("h"))
        return rows.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(ask, "doc_id BIGINT, digest BINARY")

    def clean(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with (n_lines, n_dropped, clean_text): repeated lines stay only in their largest document."""
        repeated = self.counts().filter(F.col("n_docs") >= self.repeats)
        refs = self._log().filter("delta > 0").select("doc_id", "digest")
        drops = (
            self.candidates(refs)
            .join(repeated, "digest")
            .filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
            .groupBy(F.col("doc_id").alias("_drop_id"))
            .agg(F.collect_set("digest").alias("_drop"))
        )
        kept = lambda ls: F.filter(ls, lambda l: ~F.coalesce(F.array_contains(F.col("_drop"), line_digest(l, self.least)), F.lit(False)))
        lines = _lines(F.col(text))
        out = docs.join(drops, docs[key].cast("long").eqNullSafe(drops["_drop_id"]), "left")
        left = F.when(F.col("_drop").isNull(), lines).otherwise(kept(lines))
        return (
            out.withColumn("_left", left)
            .withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_dropped", F.col("n_lines") - F.size("_left"))
            .withColumn("clean_text", F.when(F.col("n_dropped") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join("_left", "\n")))
            .drop("_left", "_drop", "_drop_id")
        )
