"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A
batch is first reduced to one row per digest (combined before the shuffle, so a text
with a third of all copies is one row per task), met with the index by a sort-merge
anti-join over the buckets, and the digests that are new are appended.

Defined results: null text counts as empty; equal texts are those identical after all
ASCII white space is deleted; the row with most code points stays, then the smallest
id (a null id loses to any other); rows that share an id stay or go together; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, shared_folder, stored

COLUMNS = "digest BINARY, keep_id BIGINT, n_chars BIGINT, batch STRING"


class DigestIndex:
    """A folder of digests, bucketed and sorted, that batches are checked against."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.table = "digest_index_" + re.sub(r"\W", "_", folder).lower()[-100:]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, new: DataFrame) -> None:
        """One sorted file per bucket, as the hash of the shuffle is that of the buckets."""
        new.select("digest", "keep_id", "n_chars", "batch").repartition(self.buckets, "digest").sortWithinPartitions(
            "digest"
        ).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def digest(text: str = "text") -> Column:
    """SHA-256 of a text without its ASCII white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+", ""), 256))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    n_chars = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), n_chars.alias("n_chars"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str = "0", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row; appends new digests to the index.

    A text that an earlier batch put into the index is dropped in favour of that row.
    Entries of the same `batch` are not held against it, so a batch can be run again.
    group_size counts the rows of this batch.
    """
    rows = stored(digests(docs, key, text), "exact-rows")
    # ~id turns the order of ids round without overflow, and leaves null the least
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("back")))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select(
        "digest", F.bitwise_not("best.back").alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size"
    )
    groups = stored(groups, "exact-groups")
    seen = index.rows()
    earlier = seen.filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    judged = stored(groups.join(earlier.hint("merge"), "digest", "left"), "exact-judged")
    fresh = judged.filter("old IS NULL").join(seen.select("digest").hint("merge"), "digest", "left_anti")
    index.append(fresh.withColumn("batch", F.lit(batch)))
    verdicts = judged.select(
        "digest", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size",
        F.coalesce("old", F.lit(False)).alias("old"),
    )
    return rows.join(verdicts, "digest").select(
        "doc_id", "keep_id", "group_size", (~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest"
    )


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder, with a bucket for each shuffle partition."""
    return DigestIndex(spark, shared_folder(spark, "exact-index"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
