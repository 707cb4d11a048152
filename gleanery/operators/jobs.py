"""Batch twins of the stateful operators: source health, jobs, quotas, sessions.

Each gives, on a closed log, what the streaming operator has emitted or holds at
the end of it.
"""

from __future__ import annotations

from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scores
from ..functions.breaker import Breaker
from .windows import next_row, running_total

# --- Source health -------------------------------------------------------------------


def _chunked_calls(calls: DataFrame, chunk_s: int) -> DataFrame:
    return calls.select(
        "source", "event_id", F.unix_millis("ts").alias("t"), "ok", F.floor(F.unix_seconds("ts") / chunk_s).alias("chunk")
    )


def _per_stretch(df: DataFrame, produce, schema: str) -> DataFrame:
    """Rows of produce(source, chunk, calls) for every stretch, its calls in time order.

    Grouped, as a repartition below a map may be left out after a join on the same
    columns, and its shuffle then be read by mapper: a stretch would fall into several tasks.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        entered = pdf["entered"].tolist() if "entered" in pdf else repeat(0)
        calls = list(zip(pdf["t"].tolist(), pdf["ok"].tolist(), pdf["event_id"].tolist(), entered))
        return pd.DataFrame(list(produce(pdf["source"].iat[0], int(pdf["chunk"].iat[0]), calls)), columns=columns)

    return df.groupBy("source", "chunk").applyInPandas(run, schema)


def _entry_states(chunked: DataFrame, rule: Breaker, chunk_s: int) -> DataFrame:
    """State in which every (source, chunk) is entered.

    A chunk is first reduced to its effect on each possible state, in parallel. Only
    these effects are then applied one after the other, a row per chunk of time.
    """

    def effects_of(source, chunk, calls):
        horizon = chunk * chunk_s * 1000 + rule.open_ms
        finite, limits, ends = rule.transfer([c[0] for c in calls], [c[1] for c in calls], horizon)
        yield source, chunk, finite, limits, ends

    effects = _per_stretch(chunked, effects_of, "source string, chunk long, finite array<long>, limits array<long>, ends array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, entered, left = 0, [], []
        for finite, limits, ends in zip(pdf["finite"], pdf["limits"], pdf["ends"]):
            entered.append(state)
            state = rule.apply(state, list(finite), list(limits), list(ends))
            left.append(state)
        return pd.DataFrame({"source": pdf["source"], "chunk": pdf["chunk"], "entered": entered, "left_in": left})

    return effects.groupBy("source").applyInPandas(chain, "source string, chunk long, entered long, left_in long")


def circuit_state(calls: DataFrame, rule: Breaker = Breaker(), chunk_s: int = 3600) -> DataFrame:
    """Every change of a source's health: source, event_id, t, from_state, to_state, alert.

    calls: source, event_id, ts, ok. The log is worked in stretches of `chunk_s`
    seconds, so a source with most of the calls is still spread over many tasks.
    """
    chunked = _chunked_calls(calls, chunk_s)
    entries = _entry_states(chunked, rule, chunk_s)

    def changes(source, _chunk, calls):
        found = rule.run(calls[0][3], ((t, ok) for t, ok, *_ in calls))
        for step, (i, before, after, alert) in enumerate(found):
            yield source, calls[i][2], calls[i][0], step, before, after, alert

    entered = chunked.join(entries.select("source", "chunk", "entered"), ["source", "chunk"])
    return _per_stretch(
        entered, changes, "source string, event_id long, t long, step int, from_state string, to_state string, alert string"
    )


def circuit_health(calls: DataFrame, rule: Breaker = Breaker(), chunk_s: int = 3600) -> DataFrame:
    """State of each source after its last call."""
    entries = _entry_states(_chunked_calls(calls, chunk_s), rule, chunk_s)
    last = entries.groupBy("source").agg(F.max_by("left_in", "chunk").alias("s"))
    state = F.when(F.col("s") < rule.half, "closed").when(F.col("s") < rule.finite, "half_open").otherwise("open")
    return last.select("source", state.alias("state"), F.when(F.col("s") >= rule.finite, F.col("s")).alias("open_until_ms"))


# --- Jobs ----------------------------------------------------------------------------


def dead_letter_queue(events: DataFrame, limit: int = L.MAX_FAILURES, ttl_days: int = 7, delay_ms: int = 0) -> DataFrame:
    """Dead-letter rows of a closed log, as `dead_letter_queue_stream` emits them.

    events: job_id, event_id, ts, kind (failure | phase | retry), phase, size, ms, error. A job starts anew after a
    retry and after `ttl_days` of quiet. Every failure at or over the limit is `dead`, with what was
    done until then; what ends by quiet, or is as old at the end of the log, is `expired`.
    """
    ttl = ttl_days * 86_400_000
    at = Window.partitionBy("job_id").orderBy("t", "event_id")
    end = events.agg((F.max(F.unix_millis("ts")) - delay_ms).alias("_end"))
    timed = events.withColumn("t", F.unix_millis("ts")).filter("t IS NOT NULL")
    gap = F.col("t") - F.lag("t").over(at) > ttl
    marked = timed.withColumn("_new", (F.lag("kind").over(at).isNull() | (F.lag("kind").over(at) == "retry") | gap).cast("int"))
    marked = marked.withColumn("_next_t", F.lead("t").over(at)).withColumn("_stretch", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("job_id", "_stretch").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = Window.partitionBy("job_id", "_stretch", "kind", "phase").orderBy("t", "event_id")
    fresh = ((F.col("kind") == "phase") & F.col("phase").isNotNull() & (F.row_number().over(seen) == 1)).cast("int")
    told = marked.filter("kind <> 'retry'").withColumn("_fresh", fresh)
    told = told.select(
        "job_id", "kind", "t", "_next_t", F.sum((F.col("kind") == "failure").cast("long")).over(run).alias("failures"),
        F.min(F.when(F.col("kind") == "failure", F.col("t"))).over(run).alias("first_t"), F.sum("_fresh").over(run).cast("long").alias("phases_completed"),
        F.coalesce(F.max("size").over(run), F.lit(0)).cast("long").alias("size"),
        F.sum(F.when(F.col("kind") == "phase", F.coalesce("ms", F.lit(0.0))).otherwise(0.0)).over(run).alias("total_ms"), F.col("error").alias("last_error"),
    ).filter(F.col("failures") >= limit)
    numbers = ["failures", "first_t", "phases_completed", "size", "total_ms"]
    dead = told.filter("kind = 'failure'").select("job_id", F.lit("dead").alias("kind"), "t", *numbers, "last_error")
    quiet = told.filter((F.col("_next_t") - F.col("t") > ttl) | (F.col("_next_t").isNull() & (F.col("t") + ttl < end.scalar())))
    expired = quiet.select("job_id", F.lit("expired").alias("kind"), (F.col("t") + ttl).alias("t"), *numbers, F.lit(None).cast("string").alias("last_error"))
    return dead.unionByName(expired)


def dead_letter(failures: DataFrame, retries: DataFrame | None = None, limit: int = L.MAX_FAILURES, ttl_days: int = 7) -> DataFrame:
    """Jobs with at least `limit` failures: count, first and last failure, last error.

    failures: job_id, event_id, ts, error. A retry (job_id, ts) clears what came
    before it. The count starts again after `ttl_days` without a failure; days are
    aggregated first, so a job is a row per day however often it fails.
    """
    if retries is not None:
        last_retry = retries.groupBy("job_id").agg(F.max("ts").alias("_retry"))
        failures = failures.join(last_retry, "job_id", "left").filter("_retry IS NULL OR ts > _retry").drop("_retry")
    days = failures.groupBy("job_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("error", F.struct("ts", "event_id")).alias("error"),
    )
    w = Window.partitionBy("job_id").orderBy("day")
    quiet = F.unix_seconds("first_ts") - F.unix_seconds(F.lag("last_ts").over(w)) > ttl_days * 86400
    streaks = days.withColumn("_new", F.when(F.coalesce(quiet, F.lit(True)), 1).otherwise(0)).withColumn(
        "_streak", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    per_streak = streaks.groupBy("job_id", "_streak").agg(
        F.sum("n").alias("failures"), F.min("first_ts").alias("first_failed"), F.max("last_ts").alias("last_failed"),
        F.max_by("error", "day").alias("last_error"),
    )
    last = per_streak.groupBy("job_id").agg(F.max_by(F.struct("failures", "first_failed", "last_failed", "last_error"), "_streak").alias("s"))
    return last.select("job_id", "s.*").filter(F.col("failures") >= limit)


def job_status(events: DataFrame, terminal: list[str] = L.TERMINAL_JOB_STATES) -> DataFrame:
    """Current status per job; a terminal status stays, whatever is logged later."""
    ended = F.col("status").isin(terminal)
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct(ended.alias("e"), "ts", "event_id")).alias("status"), F.count("*").alias("events")
    ).withColumn("can_cancel", ~F.col("status").isin(terminal))


def jobs_by_status(events: DataFrame) -> DataFrame:
    return job_status(events).groupBy("status").agg(F.count("*").alias("jobs"))


def source_progress(events: DataFrame) -> DataFrame:
    """Latest status and results per source of a search."""
    return events.groupBy("search_id", "source").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events")
    )


def search_progress(events: DataFrame) -> DataFrame:
    """Is a search complete, and is it partial?"""
    return source_progress(events).groupBy("search_id").agg(
        F.count("*").alias("sources"),
        F.bool_and(F.col("status").isin("complete", "error")).alias("complete"),
        F.bool_or(F.col("status") == "error").alias("partial"),
    )


def phase_durations(events: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Pair each phase start with the next event of its job and phase, if that is an end.

    events: job_id, phase, event_id, ts, status (phase_start | phase_end).
    """
    steps = events.filter(F.col("status").isin("phase_start", "phase_end"))
    chunk = F.floor(F.unix_seconds("ts") / chunk_s)
    paired = next_row(steps, ["job_id", "phase"], ["ts", "event_id"], chunk, ["ts", "status"], "nxt")
    started = paired.filter("status = 'phase_start'")
    closed = F.col("nxt.status") == "phase_end"
    return started.select(
        "job_id", "phase", "event_id",
        F.when(closed, F.unix_millis("nxt.ts") - F.unix_millis("ts")).alias("duration_ms"),
        F.coalesce(closed, F.lit(False)).alias("closed"),
    )


def session_gaps(events: DataFrame, gap: str, user: str = "user_id") -> DataFrame:
    """Sessions of a user: events no further apart than `gap`."""
    s = events.groupBy(user, F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return s.select(user, "events", "first_ts", "last_ts")


# --- Quotas --------------------------------------------------------------------------


def quota_limits(tier: Column) -> dict[str, Column]:
    names = ["max_mb", "max_pages", "per_minute", "per_day", "concurrent", "cost_limit"]
    return {n: scores.lookup({t[0]: t[i + 1] for t in L.QUOTA_TIERS}, tier) for i, n in enumerate(names)}


def quota_tier(usage: DataFrame, tier: str = "tier") -> DataFrame:
    return usage.select("*", *[c.alias(n) for n, c in quota_limits(F.col(tier)).items()])


def request_cost(processing_ms: Column, memory_mb: float = 1024.0) -> Column:
    return F.round(F.lit(memory_mb / 1024.0) * (processing_ms / 1000.0) * L.PRICE_PER_GB_SECOND + L.PRICE_PER_REQUEST, 10)


def rate_windows(usage: DataFrame) -> DataFrame:
    """Per key and minute: requests in it, with the minute before, in its day and month.

    Minutes are counted first; the windows then run over one row per active minute.
    """
    minutes = usage.groupBy("api_key", F.floor(F.unix_seconds("ts") / 60).alias("minute")).agg(F.count("*").alias("in_minute"))
    w = Window.partitionBy("api_key").orderBy("minute").rangeBetween(-1, 0)
    start = F.timestamp_seconds(F.col("minute") * 60)
    dated = minutes.withColumn("day", F.date_format(start, "yyyy-MM-dd")).withColumn("month", F.date_format(start, "yyyy-MM"))
    return (
        dated.withColumn("two_minutes", F.sum("in_minute").over(w))
        .withColumn("in_day", F.sum("in_minute").over(Window.partitionBy("api_key", "day")))
        .withColumn("in_month", F.sum("in_minute").over(Window.partitionBy("api_key", "month")))
    )


def cost_report(usage: DataFrame, budget: float = L.MONTHLY_BUDGET) -> DataFrame:
    """Per month: cost, share of the budget, whether to slow down or stop."""
    months = usage.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("requests"), F.sum(request_cost(F.col("processing_ms"))).alias("_cost")
    )
    pct = F.col("_cost") / F.lit(budget) * 100
    return months.select(
        "month", "requests",
        F.round("_cost", 6).alias("cost_usd"),
        F.round(F.greatest(F.lit(0.0), F.lit(budget) - F.col("_cost")), 6).alias("remaining_usd"),
        F.round(pct, 2).alias("pct_used"),
        (pct >= L.THROTTLE_SHARE * 100).alias("throttle"),
        (pct >= L.STOP_SHARE * 100).alias("stop"),
    )


def admission_offered(usage: DataFrame, stopped_months: list[str] = [], chunk_s: int = 3600) -> DataFrame:
    """Decision per request if every earlier request had been admitted (offered load).

    A bound: it never admits what the exact, stateful check of `streaming` refuses for
    load. Running counts are chunked by time, so a busy key is spread over tasks.
    """
    limits = quota_limits(F.col("tier"))
    base = usage.select("event_id", "api_key", "tier", "ts", "file_size_mb", "pages", "processing_ms").withColumn(
        "minute", F.floor(F.unix_seconds("ts") / 60)
    ).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    chunk = F.floor(F.unix_seconds("ts") / chunk_s)
    order = ["ts", "event_id"]
    counted = running_total(base, ["api_key", "minute"], order, F.lit(0), F.lit(1).cast("long"), "_in_minute")
    per_minute = base.groupBy("api_key", (F.col("minute") + 1).alias("minute")).agg(F.count("*").alias("_before"))
    counted = counted.join(per_minute, ["api_key", "minute"], "left")
    counted = running_total(counted, ["api_key", "day"], order, chunk, F.lit(1).cast("long"), "_in_day")
    cost = request_cost(F.col("processing_ms"))
    counted = running_total(counted, ["api_key", "month"], order, chunk, F.round(cost * 1e10).cast("long"), "_spent")
    # active jobs: starts minus ends, ends first at the same instant
    ms = F.unix_millis("ts")
    moves = base.select("api_key", "event_id", ms.alias("t"), F.lit(1).cast("long").alias("delta")).unionByName(
        base.select("api_key", "event_id", (ms + F.ceil("processing_ms")).alias("t"), F.lit(-1).cast("long").alias("delta"))
    )
    active = running_total(moves, ["api_key"], ["t", "delta", "event_id"], F.floor(F.col("t") / (chunk_s * 1000)), F.col("delta"), "_active")
    counted = counted.join(active.filter("delta = 1").select("api_key", "event_id", "_active"), ["api_key", "event_id"])
    minute_load = F.col("_in_minute") - 1 + F.coalesce("_before", F.lit(0))
    spent = (F.col("_spent") - F.round(cost * 1e10).cast("long")) / 1e10
    reason = (
        F.when(limits["max_mb"].isNull(), "invalid_api_key")
        .when(F.col("month").isin(stopped_months) if stopped_months else F.lit(False), "monthly_budget_exceeded")
        .when(F.col("file_size_mb") > limits["max_mb"], "file_too_large")
        .when(F.col("pages") > limits["max_pages"], "too_many_pages")
        .when(minute_load >= limits["per_minute"], "rate_exceeded_minute")
        .when(F.col("_in_day") - 1 >= limits["per_day"], "rate_exceeded_daily")
        .when(F.col("_active") - 1 >= limits["concurrent"], "concurrent_limit_exceeded")
        .when((limits["cost_limit"] > 0) & (spent >= limits["cost_limit"]), "monthly_cost_limit_exceeded")
        .otherwise("")
    )
    wait = (
        F.when(reason == "rate_exceeded_minute", 60 - F.unix_seconds("ts") % 60)
        .when(reason == "rate_exceeded_daily", 86400 - F.unix_seconds("ts") % 86400)
        .when(reason == "concurrent_limit_exceeded", 5)
        .otherwise(0)
    )
    return counted.select("event_id", "api_key", (reason == "").alias("allowed"), reason.alias("reason"), wait.cast("long").alias("retry_after_s"))
