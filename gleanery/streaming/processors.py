"""Stateful operators over live logs. Each has a batch twin in `operators.jobs`.

Rows of one key arrive in time order within a micro-batch group after sorting;
events later than the watermark go to a late table (`drive.run_split`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .. import lookups as L
from ..functions import text
from ..functions.breaker import Breaker


#: Buckets of keys in streams that touch very many keys: a call has all rows of a bucket, not of one key.
BUCKETS = 1024


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame | None:
    """Rows of one key in one micro-batch, in order; the trigger bounds their number."""
    parts = [p for p in rows if len(p)]
    if not parts:
        return None
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return pdf if len(pdf) == 1 else pdf.take(np.lexsort([pdf[c].to_numpy() for c in reversed(by)])).reset_index(drop=True)


def _bucket(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("_bucket")


class CircuitProcessor(StatefulProcessor):
    """Health machine per source; state is one integer."""

    def __init__(self, rule: Breaker):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value long, step long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["t", "event_id"])
        if pdf is None:
            return
        value, step = self.state.get() if self.state.exists() else (0, 0)
        machine = self.rule.run(int(value), zip(pdf["t"].tolist(), pdf["ok"].tolist()))
        out = []
        while True:
            try:
                i, before, after, alert = next(machine)
            except StopIteration as done:
                value = done.value
                break
            step += 1
            out.append((key[0], int(pdf["event_id"].iloc[i]), int(pdf["t"].iloc[i]), before, after, alert))
        self.state.update((int(value), int(step)))
        yield pd.DataFrame(out, columns=["source", "event_id", "t", "from_state", "to_state", "alert"])

    def close(self) -> None:
        pass


def circuit_stream(calls: DataFrame, rule: Breaker = Breaker()) -> DataFrame:
    rows = calls.select("source", "event_id", F.unix_millis("ts").alias("t"), "ok")
    return rows.groupBy("source").transformWithStateInPandas(
        CircuitProcessor(rule),
        outputStructType=StructType.fromDDL(
            "source string, event_id long, t long, from_state string, to_state string, alert string"
        ),
        outputMode="Append",
        timeMode="None",
    )


class DeadLetterProcessor(StatefulProcessor):
    """Failure count per job, forgotten after the time to live; a retry clears it."""

    def __init__(self, limit: int, ttl_ms: int, live: bool):
        self.limit, self.ttl_ms, self.live = limit, ttl_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the log's own clock decides; on a live stream the store also frees what is long dead
        kept = {"ttlDurationMs": self.ttl_ms} if self.live else {}
        self.state = handle.getValueState("failures", "n long, first_t long, last_t long", **kept)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["t", "event_id"])
        if pdf is None:
            return
        n, first, last = self.state.get() if self.state.exists() else (0, 0, 0)
        out = []
        for t, kind, error in zip(pdf["t"], pdf["kind"], pdf["error"]):
            if kind == "retry":
                n = 0
                continue
            if n and t - last > self.ttl_ms:
                n = 0
            first = int(t) if n == 0 else first
            n, last = n + 1, int(t)
            if n >= self.limit:
                out.append((key[0], int(n), int(first), int(last), error))
        self.state.update((int(n), int(first), int(last)))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "failures", "first_t", "last_t", "last_error"])

    def close(self) -> None:
        pass


def dead_letter_stream(events: DataFrame, limit: int = L.MAX_FAILURES, ttl_days: int = 7, live: bool = False) -> DataFrame:
    """events: job_id, event_id, ts, kind (failure | retry), error. Emits a row per failure at or over the limit.

    `live` lets the state store expire idle jobs by wall clock; such a query never
    ends by itself, so a run over a closed log leaves it off.
    """
    rows = events.select("job_id", "event_id", F.unix_millis("ts").alias("t"), "kind", "error")
    return rows.groupBy("job_id").transformWithStateInPandas(
        DeadLetterProcessor(limit, ttl_days * 86_400_000, live),
        outputStructType=StructType.fromDDL("job_id string, failures long, first_t long, last_t long, last_error string"),
        outputMode="Update",
        timeMode="ProcessingTime" if live else "None",
    )


class DeadLetterQueueProcessor(StatefulProcessor):
    """A job's failures, finished phases, size and time; an event-time timer forgets it when it has been quiet for the time to live.

    Emits `dead` for every failure at or over the limit, and `expired` for an entry that
    ends by quiet. Time is that of the log: the watermark fires the timers, so state is freed
    without a wall clock.
    """

    FIELDS = "n long, first_t long, last_t long, phases array<string>, size long, total_ms double"

    def __init__(self, limit: int, ttl_ms: int):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", self.FIELDS)

    def _row(self, job: str, kind: str, t: int, held: tuple, error) -> tuple:
        n, first, _last, phases, size, total = held
        return job, kind, int(t), int(n), int(first) if n else None, len(phases), int(size), float(total), error

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in DEAD_LETTERS.split(", ")])

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["t", "event_id"])
        if pdf is None:
            return
        empty = (0, 0, None, [], 0, 0.0)
        before = tuple(self.state.get()) if self.state.exists() else empty
        held, out = before, []
        for t, kind, phase, size, ms, error in zip(*(pdf[c].tolist() for c in ("t", "kind", "phase", "size", "ms", "error"))):
            n, first, last, phases, most, total = held
            if last is not None and t - last > self.ttl_ms:
                if n >= self.limit:
                    out.append(self._row(key[0], "expired", last + self.ttl_ms, held, None))
                n, first, last, phases, most, total = empty
            if kind == "retry":
                held = empty
                continue
            if kind == "phase":
                phases = list(phases) if phase in phases or phase is None else [*phases, phase]
                total += 0.0 if pd.isna(ms) else float(ms)
            else:
                first, n = int(t) if n == 0 else first, n + 1
            held = (n, first, int(t), list(phases), most if pd.isna(size) else max(int(most), int(size)), total)
            if kind == "failure" and n >= self.limit:
                out.append(self._row(key[0], "dead", t, held, error))
        if held[2] != before[2]:
            if before[2] is not None:
                self.handle.deleteTimer(before[2] + self.ttl_ms)
            if held[2] is not None:
                self.handle.registerTimer(held[2] + self.ttl_ms)
        if held[2] is None:
            self.state.clear()
        else:
            self.state.update(held)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        held = tuple(self.state.get())
        over = held[2] is not None and held[2] + self.ttl_ms == expiredTimerInfo.getExpiryTimeInMs()
        if over:
            self.state.clear()
        if over and held[0] >= self.limit:
            yield self._frame([self._row(key[0], "expired", held[2] + self.ttl_ms, held, None)])

    def close(self) -> None:
        pass


DEAD_LETTERS = "job_id string, kind string, t long, failures long, first_t long, phases_completed long, size long, total_ms double, last_error string"


def dead_letter_queue_stream(events: DataFrame, limit: int = L.MAX_FAILURES, ttl_days: int = 7, delay: str = "0 seconds") -> DataFrame:
    """events: job_id, event_id, ts, kind (failure | phase | retry), phase, size, ms, error.

    A retry clears the job. Rows more than `delay` behind the log are left out by the watermark;
    `drive.run_split` keeps them in a table of their own.
    """
    rows = events.withWatermark("ts", delay).select("job_id", "event_id", "ts", F.unix_millis("ts").alias("t"), "kind", "phase", "size", "ms", "error")
    return rows.groupBy("job_id").transformWithStateInPandas(
        DeadLetterQueueProcessor(limit, ttl_days * 86_400_000),
        outputStructType=StructType.fromDDL(DEAD_LETTERS),
        outputMode="Update",
        timeMode="EventTime",
    )


class ReplayProcessor(StatefulProcessor):
    """The last n events per job, kept for a time; each batch emits the buffer as it stands."""

    def __init__(self, n: int, ttl_ms: int, live: bool):
        self.n, self.ttl_ms, self.live = n, ttl_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = {"ttlDurationMs": self.ttl_ms} if self.live else {}
        self.buffer = handle.getListState("events", "event_id long, t long, phase string", **kept)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.buffer.get()]
        for pdf in rows:
            held += [(int(e), int(t), p) for e, t, p in zip(pdf["event_id"], pdf["t"], pdf["phase"])]
            held = sorted(held, key=lambda e: (e[1], e[0]))[-self.n :]
        if held:
            self.buffer.put(held)
        yield pd.DataFrame([(key[0], *e) for e in held], columns=["job_id", "event_id", "t", "phase"])

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, n: int = L.REPLAY_EVENTS, ttl_hours: int = 1, live: bool = False) -> DataFrame:
    rows = events.select("job_id", "event_id", F.unix_millis("ts").alias("t"), "phase")
    return rows.groupBy("job_id").transformWithStateInPandas(
        ReplayProcessor(n, ttl_hours * 3_600_000, live),
        outputStructType=StructType.fromDDL("job_id string, event_id long, t long, phase string"),
        outputMode="Update",
        timeMode="ProcessingTime" if live else "None",
    )


def decide(state: dict, limits: dict, t: int, mb: float, pages: int, ms: float, cost: float, stopped: bool) -> tuple[str, int]:
    """One admission check; on success the request is recorded in `state`."""
    minute, day, month = t // 60_000, t // 86_400_000, pd.Timestamp(t, unit="ms").strftime("%Y-%m")
    if state["minute"] != minute:
        state["before"] = state["in_minute"] if state["minute"] == minute - 1 else 0
        state["minute"], state["in_minute"] = minute, 0
    if state["day"] != day:
        state["day"], state["in_day"] = day, 0
    if state["month"] != month:
        state["month"], state["spent"] = month, 0.0
    state["ends"] = [e for e in state["ends"] if e > t]
    seconds = t // 1000
    if stopped:
        return "monthly_budget_exceeded", 0
    if mb > limits["max_mb"]:
        return "file_too_large", 0
    if pages > limits["max_pages"]:
        return "too_many_pages", 0
    if state["in_minute"] + state["before"] >= limits["per_minute"]:
        return "rate_exceeded_minute", max(60 - seconds % 60, 1)
    if state["in_day"] >= limits["per_day"]:
        return "rate_exceeded_daily", 86_400 - seconds % 86_400
    if len(state["ends"]) >= limits["concurrent"]:
        return "concurrent_limit_exceeded", 5
    if limits["cost_limit"] > 0 and state["spent"] >= limits["cost_limit"]:
        return "monthly_cost_limit_exceeded", 0
    state["in_minute"] += 1
    state["in_day"] += 1
    state["spent"] += cost
    state["ends"].append(t + int(-(-ms // 1)))
    return "", 0


def fresh_quota() -> dict:
    return {"minute": -1, "in_minute": 0, "before": 0, "day": -1, "in_day": 0, "month": "", "spent": 0.0, "ends": []}


class AdmissionProcessor(StatefulProcessor):
    """Exact admission per key: only admitted requests count against the limits."""

    def __init__(self, stopped_months: list[str]):
        self.stopped = set(stopped_months)
        names = ["max_mb", "max_pages", "per_minute", "per_day", "concurrent", "cost_limit"]
        self.limits = {t[0]: dict(zip(names, t[1:])) for t in L.QUOTA_TIERS}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "quota",
            "minute long, in_minute long, before long, day long, in_day long, month string, spent double, ends array<long>",
        )

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["t", "event_id"])
        if pdf is None:
            return
        quota = fresh_quota()
        if self.state.exists():
            quota = dict(zip(quota, self.state.get()))
            quota["ends"] = list(quota["ends"])
        out = []
        for r in pdf.itertuples():
            limits = self.limits.get(r.tier)
            if limits is None:
                reason, wait = "invalid_api_key", 0
            else:
                month = pd.Timestamp(r.t, unit="ms").strftime("%Y-%m")
                reason, wait = decide(quota, limits, int(r.t), r.file_size_mb, r.pages, r.processing_ms, r.cost, month in self.stopped)
            out.append((int(r.event_id), key[0], reason == "", reason, int(wait)))
        self.state.update(tuple(quota.values()))
        yield pd.DataFrame(out, columns=["event_id", "api_key", "allowed", "reason", "retry_after_s"])

    def close(self) -> None:
        pass


def admission_stream(usage: DataFrame, stopped_months: list[str] = []) -> DataFrame:
    from ..operators.jobs import request_cost

    rows = usage.select(
        "api_key", "event_id", F.unix_millis("ts").alias("t"), "tier", "file_size_mb", "pages", "processing_ms",
        request_cost(F.col("processing_ms")).alias("cost"),
    )
    return rows.groupBy("api_key").transformWithStateInPandas(
        AdmissionProcessor(stopped_months),
        outputStructType=StructType.fromDDL("event_id long, api_key string, allowed boolean, reason string, retry_after_s long"),
        outputMode="Append",
        timeMode="None",
    )


# --- Built-in stateful operators -------------------------------------------------------


def job_status_stream(events: DataFrame) -> DataFrame:
    ended = F.col("status").isin(L.TERMINAL_JOB_STATES)
    return events.groupBy("job_id").agg(F.max_by("status", F.struct(ended.alias("e"), "ts", "event_id")).alias("status"))


def minute_counts_stream(usage: DataFrame, delay: str = "10 minutes", size: str = "1 minute", slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        usage.withWatermark("ts", delay).groupBy("api_key", w.alias("w")).agg(F.count("*").alias("requests"))
        .select("api_key", F.unix_seconds("w.start").alias("start_s"), "requests")
    )


class FirstSeenProcessor(StatefulProcessor):
    """Lets the earliest row of a key of the first micro-batch that has it through; state is one flag per key, by bucket."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.any = handle.getValueState("any", "any boolean")
        self.seen = handle.getMapState("seen", "key string", "seq long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["seq"])
        if pdf is None:
            return
        pdf = pdf.set_axis([*self.columns, "_key", "_bucket"], axis=1)  # Spark may hand over unnamed columns
        first = pdf.drop_duplicates("_key")
        if self.any.exists():
            first = first[[not self.seen.containsKey((k,)) for k in first["_key"]]]
        else:
            self.any.update((True,))
        for k, seq in zip(first["_key"], first["seq"]):
            self.seen.updateValue((k,), (int(seq),))
        if len(first):
            yield first[self.columns]

    def close(self) -> None:
        pass


def _first_seen(rows: DataFrame, key: Column) -> DataFrame:
    out = rows.schema
    return rows.withColumn("_key", key).withColumn("_bucket", _bucket("_key")).groupBy("_bucket").transformWithStateInPandas(
        FirstSeenProcessor(out.names), outputStructType=out, outputMode="Append", timeMode="None"
    )


def dedup_stream(works: DataFrame) -> DataFrame:
    """(work_id, seq, doi, dedup_hash) of the first row per DOI, then per title/year/surname hash, over the whole stream.

    Equals the batch form for a log that arrives in the order of `seq`. The state is a
    flag per key for as long as the log is kept; duplicates may be any time apart.
    A title without a letter or digit is no title: such works have no hash and all pass it.
    """
    own = F.concat(F.lit("own:"), F.col("work_id").cast("string"))
    keyed = works.select(
        "work_id", "seq", F.nullif(text.norm_doi(F.col("doi")), F.lit("")).alias("doi"),
        F.when(text.norm_title(F.col("title")) != "", text.dedup_hash(F.col("title"), F.col("year"), F.col("first_author"))).alias("dedup_hash"),
    )
    by_doi = _first_seen(keyed, F.coalesce(F.concat(F.lit("doi:"), F.col("doi")), own))
    return _first_seen(by_doi, F.coalesce(F.col("dedup_hash"), own))


class PhaseProcessor(StatefulProcessor):
    """The open starts of a bucket of (job, phase); the next event of each closes it, by an end with a duration."""

    KEPT = ["job_id", "phase", "event_id", "t"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "job_id string, phase string, event_id long, t long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        held = pd.DataFrame([tuple(r) for r in self.open.get()], columns=self.KEPT)
        pdf = pd.concat([*([held.assign(status="phase_start", old=0)] if len(held) else []), *(p.assign(old=1) for p in parts)], ignore_index=True)
        pdf["own"] = pdf.groupby(["job_id", "phase"], dropna=False, sort=False).ngroup()
        pdf = pdf.take(np.lexsort([pdf[c].to_numpy() for c in ("event_id", "t", "old", "own")])).reset_index(drop=True)
        start, own = (pdf["status"] == "phase_start").to_numpy(), pdf["own"].to_numpy()
        last = np.append(own[1:] != own[:-1], True)
        at = np.flatnonzero(start & ~last & ~np.append(start[1:], True))
        still = pdf.loc[start & last, self.KEPT]
        if len(still):
            self.open.put([(j, p, int(e), int(t)) for j, p, e, t in still.itertuples(index=False)])
        else:
            self.open.clear()
        if len(at):
            one, two = pdf.iloc[at].reset_index(drop=True), pdf.iloc[at + 1].reset_index(drop=True)
            yield pd.DataFrame({"job_id": one["job_id"], "phase": one["phase"], "start_id": one["event_id"], "end_id": two["event_id"], "duration_ms": two["t"] - one["t"]})

    def close(self) -> None:
        pass


def phase_durations_stream(events: DataFrame) -> DataFrame:
    """Each phase start whose next event of that job and phase is an end, as in the batch form."""
    rows = events.filter(F.col("status").isin("phase_start", "phase_end")).select(
        _bucket("job_id", "phase"), "job_id", "phase", F.col("event_id").cast("long").alias("event_id"), F.unix_millis("ts").alias("t"), "status"
    )
    return rows.groupBy("_bucket").transformWithStateInPandas(
        PhaseProcessor(),
        outputStructType=StructType.fromDDL("job_id string, phase string, start_id long, end_id long, duration_ms long"),
        outputMode="Append",
        timeMode="None",
    )
