"""Runs a stream over the files of a table to its end and hands back what it emitted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Files a micro-batch takes at most, so that a backlog is not one batch.
FILES_PER_TRIGGER = 16


def new_base(spark) -> str:
    """A folder of its own beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _to_the_end(tables, name: str, build, mode: str, folder: str | None, files: int | None, base: str, store) -> None:
    """Hands every micro-batch of `build(stream)` to `store(batch, number)` until all files are read."""
    spark = tables.spark
    path = folder or f"{tables.folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    pattern = path if folder else f"{tables.folder}/{name}.parquet*"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or FILES_PER_TRIGGER).parquet(pattern)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = (
            build(source).writeStream.foreachBatch(store).outputMode(mode.lower()).option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def run(
    tables, name: str, build: Callable[[DataFrame], DataFrame], mode: str, folder: str | None = None, latest: list[str] | None = None,
    files: int | None = None,
) -> DataFrame:
    """Emitted rows of `build(stream)`, as a table written beside the checkpoints.

    Every micro-batch is written to its own folder, so a batch that is run again after
    a failure replaces its own output. `latest` names the key whose rows a later
    micro-batch replaces: of each key only those of its last batch are handed back.
    """
    spark, base = tables.spark, new_base(tables.spark)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    _to_the_end(tables, name, build, mode, folder, files, base, store)
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    if latest:
        last = out.groupBy(*latest).agg(F.max("batch").alias("batch"))
        out = out.join(last, [*latest, "batch"], "left_semi")
    return out.drop("batch")


class LateSplit:
    """The store of a stream that parts late rows from those on time, both written in one pass.

    A row is late if it is more than `delay_s` behind the highest time of the micro-batches
    before its own, like Spark's watermark; the first batch has none. A batch keeps the highest time up to
    itself beside its rows, and looks only at what the batch before it kept. So a batch that is
    run again after a failure replaces its rows by the same ones.
    """

    def __init__(self, spark, base: str, delay_s: int, ts: str):
        self.spark, self.base, self.delay_s, self.ts = spark, base, delay_s, ts

    def high(self, number: int):
        """The highest time of micro-batches up to `number`, or None before the first one."""
        return self.spark.read.parquet(f"{self.base}/high/batch={number}").first()["high"] if number >= 0 else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self.high(number - 1)
        limit = F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(self.delay_s))
        marked = batch.withColumn("late", F.coalesce(F.col(self.ts) < limit, F.lit(False)))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{self.base}/out/batch={number}")
        written = self.spark.read.schema(marked.schema).parquet(f"{self.base}/out/batch={number}")
        high = written.agg(F.greatest(F.max(self.ts), F.lit(before).cast("timestamp")).alias("high"))
        high.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/high/batch={number}")

    def rows(self, columns) -> DataFrame:
        """All rows with `late` and the `batch` that brought them."""
        schema = columns.add("late", "boolean").add("batch", "long")
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/out").parquet(f"{self.base}/out")


def run_split(
    tables, name: str, build: Callable[[DataFrame], DataFrame], delay_s: int, ts: str = "ts", folder: str | None = None, files: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of `build(stream)`, which must keep the column `ts`. Together they are the whole stream."""
    spark, base = tables.spark, new_base(tables.spark)
    split, seen = LateSplit(spark, base, delay_s, ts), []

    def store(batch: DataFrame, number: int) -> None:
        seen.append(batch.schema)
        split(batch, number)

    _to_the_end(tables, name, build, "append", folder, files, base, store)
    rows = split.rows(type(seen[0])(list(seen[0].fields)))
    return rows.filter("NOT late").drop("late"), rows.filter("late").drop("late")
