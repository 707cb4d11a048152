"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The six white-space characters of ASCII, as the inside of a regular-expression class.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    """Number of words, without building them twice."""
    return F.size(words(text)).cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. `lower` does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        ensure_checkpoint_dir(spark)
        conf = spark.sparkContext.getCheckpointDir()
    return f"{conf.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage for good."""
    path = shared_folder(df.sparkSession, label)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    return df.sparkSession.read.parquet(path)
