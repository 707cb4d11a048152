"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), reads all that the stage before it kept, and
returns the rows that go on. All but the last return the columns of `documents`.

Defined results: the stages name rows by doc_id. Rows with a null id are judged by their
text; rows that share an id and differ in text are judged together from the near-duplicate stage on.
A stage given an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import exact, mixing, near_dedup, packing, quality, tokens
from gleanery.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_rules(docs, out="_quality").filter("_quality.kept").drop("_quality")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    judged = exact.exact_dedup(docs, exact.fresh_index(spark))
    gone = judged.filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_gone_digest")).distinct()
    marked = docs.withColumn("_digest", exact.digest("text"))
    same = (marked["_digest"] == gone["_gone_digest"]) & marked["doc_id"].cast("long").eqNullSafe(gone["_gone"])
    return marked.join(gone, same, "left_anti").drop("_digest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    gone = near_dedup.near_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training time."""
    chosen = mixing.mix(docs).filter("copies > 0").groupBy("doc_id").agg(
        F.max(F.struct("copies", "starts_at", "source_size", "target", "schedule")).alias("m")
    )
    chosen = stored(mixing.curriculum(chosen.select("doc_id", "m.*", F.lit(0).alias("size"), F.lit("").alias("source"))), "mix-chosen")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("position").alias("_position"), F.col("copy").alias("_copy"))
    taken = docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["_id"]))
    return taken.repartitionByRange("_position", "_id", "_copy").sortWithinPartitions("_position", "_id", "_copy").drop("_id", "_position", "_copy")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    cut = stored(packing.pieces(docs, kept=tokens.FEW), "pieces")
    packed = packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("best_fit_packing", pack_stage),
]

#: Token ids cannot be had in SQL, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
