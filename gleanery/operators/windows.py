"""First-wins, ranking and running operators that survive a hot key.

`row_number() <= k` over a key is safe: Spark limits each group before the
shuffle. A full ranking or running sum is not, so it is done in chunks: each
(key, chunk) is ranked on its own and shifted by the total of earlier chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Keep the earliest row per key. Rows with a null key are all kept.

    A row with a null key gets a number of its own as key, so null rows neither
    collapse, even where all their columns are equal, nor meet in one task.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    orders = [F.col(o) if isinstance(o, str) else o for o in order]
    no_key = F.lit(False)
    for c in cols:
        no_key = no_key | c.isNull()
    marked = df.withColumn("_own", F.when(no_key, F.monotonically_increasing_id()))
    w = Window.partitionBy(*cols, "_own").orderBy(*orders)
    return marked.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_own")


def one_per_key(df: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """One row per non-null key: the least by `order`, then by all its columns.

    For the side of a lookup that must not multiply the rows that ask. Combines before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    least = F.min(F.struct(*[o.alias(f"_o{n}") for n, o in enumerate(order or [])], *rest))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(least.alias("_least")).select(key, *[F.col(f"_least.`{c}`").alias(c) for c in rest])


def top_k(df: DataFrame, k: int, order: list[Column], per: list[str] | None = None) -> DataFrame:
    """k best rows overall (no full sort) or per group (limited before the shuffle)."""
    if not per:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, out: str
) -> DataFrame:
    """Inclusive running sum of `value` per key in `order`, computed chunk by chunk.

    `chunk` must not decrease along `order`; it bounds how many rows one task ranks.
    """
    marked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    totals = marked.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [marked[k].eqNullSafe(offsets[k]) for k in keys] + [marked["_chunk"].eqNullSafe(offsets["_chunk"])]
    joined = marked.join(offsets, same).select(marked["*"], "_offset")
    return joined.withColumn(out, F.sum("_value").over(local) + F.col("_offset")).drop("_chunk", "_value", "_offset")


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "row_no") -> DataFrame:
    """Dense position of every row within its key, from 1."""
    return running_total(df, keys, order, chunk, F.lit(1).cast("long"), out)


def page(df: DataFrame, n: int, size: int, order: str = "seq", per: str = "source") -> DataFrame:
    """Page n of every source. Only the first n pages of a source are ever shuffled."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(per).orderBy(order)))
    return ranked.filter((F.col("_rn") <= n * size) & (F.col("_rn") > (n - 1) * size)).drop("_rn")


def page_plan(df: DataFrame, size: int, max_pages: int, per: str = "source") -> DataFrame:
    """How many pages each source needs, and whether the page limit cuts it."""
    pages = F.ceil(F.col("hits") / size)
    return df.groupBy(per).agg(F.count("*").alias("hits")).select(
        per, "hits", F.least(pages, F.lit(max_pages)).cast("long").alias("pages"), (pages > max_pages).alias("cut")
    )


def last_n_events(
    df: DataFrame, n: int, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id"), since: DataFrame | None = None
) -> DataFrame:
    """The last n events per job; with `since` (key, event_id) only those after that event.

    A `since` event that is not in the buffer leaves the buffer whole.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    recent = df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n)
    if since is not None:
        mark = recent.alias("r").join(
            since.alias("s"), (F.col(f"r.{key}") == F.col(f"s.{key}")) & (F.col("r.event_id") == F.col("s.event_id"))
        ).select(F.col(f"r.{key}").alias(key), F.col("r._back").alias("_mark"))
        recent = recent.join(mark, key, "left").filter("_mark IS NULL OR _back < _mark").drop("_mark")
    return recent.drop("_back")


def current_phase(df: DataFrame) -> DataFrame:
    """Last known phase per job: phase events name it, status events may only carry a status."""
    name = F.when(F.col("kind") == "phase", F.coalesce("phase", "name")).when(
        F.col("kind") == "status", F.coalesce("phase", "status")
    )
    known = df.withColumn("_phase", name).filter("_phase IS NOT NULL")
    return known.groupBy("job_id").agg(F.max_by("_phase", F.struct("ts", "event_id")).alias("current_phase"))


def waterfall(spans: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Offset and width of each span as a share of its trace."""
    bounds = spans.groupBy(trace).agg(F.min("start_ms").alias("_t0"), F.max("end_ms").alias("_t1"))
    total = F.col("_t1") - F.col("_t0")
    share = lambda part: F.when(total > 0, F.round(part / total * 100, 4)).otherwise(0.0)
    return (
        spans.join(bounds, trace)
        .withColumn("offset_pct", share(F.col("start_ms") - F.col("_t0")))
        .withColumn("width_pct", share(F.col("end_ms") - F.col("start_ms")))
        .drop("_t0", "_t1")
    )


def primary_trial(ids: DataFrame, paper: str = "work_id") -> DataFrame:
    """Most certain trial id per paper, the earliest on ties."""
    w = Window.partitionBy(paper).orderBy(F.col("confidence").desc(), F.col("position"))
    return ids.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float
) -> DataFrame:
    """value at index floor(share * n) of the sorted group, exactly, for any group size.

    Counts per value band find the band that holds the wanted index; only the rows
    of that band are then ranked. `width` is the band width.
    """
    banded = df.filter(F.col(value).isNotNull()).withColumn("_band", F.floor(F.col(value) / width))
    bands = banded.groupBy(*keys, "_band").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    placed = bands.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(whole)
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("share"), F.least(F.floor(F.col("_total") * share), F.col("_total") - 1).alias("at"))
          for name, share in shares.items()]
    )
    targets = (
        placed.withColumn("_want", F.explode(wanted))
        .filter((F.col("_want.at") >= F.col("_before")) & (F.col("_want.at") < F.col("_before") + F.col("_n")))
        .select(*keys, "_band", F.col("_want.share").alias("_share"), (F.col("_want.at") - F.col("_before") + 1).alias("_pos"))
    )
    hot = banded.join(targets.select(*keys, "_band").distinct(), [*keys, "_band"], "left_semi")
    local = Window.partitionBy(*keys, "_band").orderBy(value)
    ranked = hot.select(*keys, "_band", value, F.row_number().over(local).alias("_pos"))
    return (
        ranked.join(targets, [*keys, "_band", "_pos"])
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_share") == name, F.col(value))).alias(name) for name in shares])
    )


def next_row(df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str], out: str) -> DataFrame:
    """Struct of `cols` of the following row of the key, looked up chunk by chunk.

    Inside a chunk it is a plain lead; the last row of a chunk takes the first row of
    the next one, which is known from a small per-chunk aggregate.
    """
    marked = df.withColumn("_chunk", chunk)
    row = F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"v_{c}") for c in cols])
    firsts = marked.groupBy(*keys, "_chunk").agg(F.min(row).alias("_first"))
    ahead = firsts.select(*keys, "_chunk", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_ahead"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    joined = marked.join(ahead, [*keys, "_chunk"]).withColumn("_next", F.coalesce(F.lead(row).over(local), F.col("_ahead")))
    value = F.when(F.col("_next").isNotNull(), F.struct(*[F.col(f"_next.v_{c}").alias(c) for c in cols]))
    return joined.withColumn(out, value).drop("_chunk", "_ahead", "_next")
