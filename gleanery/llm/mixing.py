"""Mixing sources to target weights along a time-varying curriculum.

Targets come from water-filling: sources share a total by weight, a source stops at
`most` times its size and the excess is shared again by weight. A source's weight
schedule says how its target is spread over training time; integrating the schedule
gives its cumulative demand, and a document at cumulative size c of its source is
assigned the time at which that demand reaches c. Range-sorting by time gives the
training order.

The order inside a source is a hash of the id. Cumulative sizes are added up in slices
of that hash, so no task holds a source; the table of sources goes through the driver
only as sizes per source and only inside Spark.

Defined results: null text has size 0; a null source is a source of its own, last in
order; repeated rows are separate documents; rows equal in id and size are
interchangeable; an empty table gives an empty mix; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import running_total
from .common import stored, word_count

#: Weights of the sources in code-point order, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: (start, end) weight of the schedule per source in code-point order, repeating: the weight moves linearly over time.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
#: Hexadecimal digits of the hash that name a slice: 4096 slices a source.
SLICE_DIGITS = 3


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, source_size, weight, no, target) of every source, from (source, source_size).

    Sources are ordered by the ratio at which they fill up, most * size / weight. If the
    first k are full, the rest share what is left by weight; the level is the first at
    which the next source is not full. One row per source, in one window: the number of
    sources is the number of names a corpus is mixed from, not of its documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("no", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.col("no") % len(cycle) + 1).cast("int"))
    )
    everyone = Window.partitionBy()
    fill = named.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "no").rowsBetween(0, Window.unboundedFollowing)
    levelled = fill.withColumn("total", F.sum("source_size").over(everyone) * share).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(everyone)["level"]
    return levelled.withColumn("_level", level).select(
        "source", "source_size", "weight", "no",
        F.least(F.col("limit"), F.coalesce(F.col("_level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _time_of(demand: Column, first: Column, last: Column) -> Column:
    """Time in 0..1 at which the integral of a linear weight reaches the share `demand`.

    The schedule's weight is first + (last - first) * t, scaled to integrate to 1.
    """
    mean = (first + last) / 2
    a, b = (last - first) / (2 * mean), first / mean
    straight = F.abs(a) < 1e-12
    root = F.sqrt(F.greatest(b * b + 4 * a * demand, F.lit(0.0)))
    return F.when(straight, demand).otherwise((2 * demand) / (b + root))


def mix(
    docs: DataFrame, size: Column | None = None, key: str = "doc_id", source: str = "source", share: float = 1.5,
    most: float = 2.0, cycle: tuple[float, ...] = CYCLE, schedules=SCHEDULES,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, position, ...) of every row.

    A source is walked in hash order: whole passes first, then the documents whose end
    stays nearest to the target. `copies` counts how often a row is taken; `position` is the
    training time of its first copy (null where it is not taken). A pass is one walk over
    the source; document c of pass p stands at cumulative size p * source_size + c.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = stored(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size")), "mix-rows"
    )
    spread = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slices = F.substring("_order", 1, SLICE_DIGITS)
    walked = running_total(spread, ["source"], ["_order", "doc_id", "size"], slices, F.col("size"), "_end")
    known = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, cycle)
    pairs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in schedules])
    schedule = F.element_at(pairs, (F.col("no") % len(schedules) + 1).cast("int"))
    joined = walked.alias("w").join(known.alias("k"), F.col("w.source").eqNullSafe(F.col("k.source"))).select(
        "w.doc_id", "w.source", "w.size", "w._end", "k.source_size", "k.target", schedule.alias("_schedule")
    )
    passes = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rest = F.col("target") - passes * F.col("source_size")
    # the document across the target is taken if more than half of it lies before the target
    more = ((F.col("_end") - F.col("size") / 2.0) < rest) & (F.col("size") > 0)
    counted = joined.withColumn("copies", (passes + more.cast("int")).cast("long")).withColumn("_start", F.col("_end") - F.col("size"))
    return _placed(counted)


def _placed(counted: DataFrame) -> DataFrame:
    at = _position(F.col("starts_at"), F.col("target"), F.col("schedule"))
    return counted.withColumnsRenamed({"_start": "starts_at", "_schedule": "schedule"}).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, at).alias("position"), "starts_at", "schedule",
    )


def _position(start: Column, target: Column, schedule: Column) -> Column:
    share = F.least(start / F.greatest(target, F.lit(1.0)), F.lit(1.0))
    return _time_of(share, schedule["first"], schedule["last"])


def curriculum(mixed: DataFrame, *also: str) -> DataFrame:
    """One row per taken copy, range-sorted by training time: (position, doc_id, source, copy, size) and the columns `also`."""
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    start = F.col("starts_at") + F.col("copy") * F.col("source_size")
    return (
        copies.withColumn("position", _position(start, F.col("target"), F.col("schedule")))
        .select("position", "doc_id", "source", "copy", "size", *also)
        .repartitionByRange("position", "doc_id", "copy")
        .sortWithinPartitions("position", "doc_id", "copy")
    )


def mixed_by_curriculum(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, position) of every row of a mix, the last three from its curriculum.

    The range-sorted copies are stored with their times; a row that has no copy is taken 0 times and has no position.
    """
    rows = stored(mixed.drop("taken", "position").withColumn("_row", F.monotonically_increasing_id()), "mix-counted")
    order = stored(curriculum(rows, "_row"), "mix-curriculum")
    taken = order.groupBy("_row").agg(F.count("*").alias("copies"), F.sum("size").alias("taken"), F.min("position").alias("position"))
    return rows.drop("copies").join(taken, "_row", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("taken", F.lit(0)).alias("taken"), "position",
    )
