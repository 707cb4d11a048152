"""Catalogue: jobs, quotas, sessions, source health and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import text
from ..functions.breaker import Breaker
from ..operators import filters, jobs, layout, ledger as ledger_ops, metrics, windows
from ..streaming import drive, processors
from .registry import lit, query, sql_doi, sql_hash, sql_map, sql_title
from .records import md5

# --- Event logs ------------------------------------------------------------------------


@query(
    "last_n_events",
    "SELECT event_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM jobs) WHERE rn <= 20",
)
def _(t):
    return windows.last_n_events(t.jobs, 20).select("event_id", "job_id")


@query(
    "events_since",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM jobs), b AS (SELECT * FROM r WHERE rn <= 50),
m AS (SELECT b.job_id, b.rn AS mark FROM b JOIN (SELECT job_id, max(event_id) AS event_id FROM jobs WHERE status = 'completed' GROUP BY job_id) c ON b.event_id = c.event_id)
SELECT event_id, b.job_id FROM b LEFT JOIN m ON b.job_id = m.job_id WHERE mark IS NULL OR rn < mark""",
)
def _(t):
    """Replay after the last completed event a client has seen; an event out of the buffer replays all."""
    seen = t.jobs.filter("status = 'completed'").groupBy("job_id").agg(F.max("event_id").alias("event_id"))
    return windows.last_n_events(t.jobs, 50, since=seen).select("event_id", "job_id")


@query(
    "current_phase",
    """SELECT job_id, max_by(p, (ts, event_id)) AS current_phase FROM (SELECT *, CASE WHEN status IN ('phase_start', 'phase_end') THEN phase WHEN status IN ('failed', 'completed') THEN status END AS p FROM jobs) WHERE p IS NOT NULL GROUP BY job_id""",
)
def _(t):
    c = F.col
    kind = F.when(c("status").isin("phase_start", "phase_end"), "phase").when(c("status").isin("failed", "completed"), "status").otherwise("other")
    typed = t.jobs.withColumn("kind", kind).withColumn("name", F.lit(None).cast("string")).withColumn("phase", F.when(c("kind") == "phase", c("phase")))
    return windows.current_phase(typed)


@query(
    "job_status",
    """SELECT job_id, max_by(status, (status IN ('completed', 'failed', 'cancelled'), ts, event_id)) AS status, count(*) AS events,
  max_by(status, (status IN ('completed', 'failed', 'cancelled'), ts, event_id)) NOT IN ('completed', 'failed', 'cancelled') AS can_cancel FROM jobs GROUP BY job_id""",
)
def _(t):
    return jobs.job_status(t.jobs)


@query(
    "jobs_by_status",
    "SELECT status, count(*) AS jobs FROM (SELECT job_id, max_by(status, (status IN ('completed', 'failed', 'cancelled'), ts, event_id)) AS status FROM jobs GROUP BY job_id) GROUP BY status",
)
def _(t):
    return jobs.jobs_by_status(t.jobs)


@query("source_progress", "SELECT search_id, source, max_by(status, (ts, event_id)) AS status, count(*) AS events FROM calls GROUP BY search_id, source")
def _(t):
    return jobs.source_progress(t.calls)


_STATUS_BY_PAGE = "SELECT search_id, concat(source, CAST(page AS STRING)) AS source, CASE WHEN event_id % 13 = 0 THEN 'pending' ELSE status END AS status, ts, event_id FROM calls"


@query(
    "search_progress",
    f"""WITH s AS (SELECT search_id, source, max_by(status, (ts, event_id)) AS status FROM ({_STATUS_BY_PAGE}) GROUP BY ALL)
SELECT search_id, count(*) AS sources, bool_and(status IN ('complete', 'error')) AS complete, bool_or(status = 'error') AS partial FROM s GROUP BY search_id""",
)
def _(t):
    return jobs.search_progress(t.sql(_STATUS_BY_PAGE))


@query(
    "dead_letter",
    """WITH f AS (SELECT * FROM jobs WHERE status = 'failed'), r AS (SELECT job_id, max(ts) AS rt FROM jobs WHERE status = 'processing' AND ts < CAST('2024-01-20' AS TIMESTAMP) GROUP BY job_id),
k AS (SELECT f.* FROM f LEFT JOIN r ON f.job_id = r.job_id WHERE rt IS NULL OR ts > rt),
g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 2 * 86400 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM k WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g), l AS (SELECT *, max(streak) OVER (PARTITION BY job_id) AS last_streak FROM s)
SELECT job_id, count(*) AS failures, epoch_us(max(ts)) // 1000 AS last_failed, max_by(phase, (ts, event_id)) AS last_error FROM l WHERE streak = last_streak GROUP BY job_id HAVING count(*) >= 2""",
)
def _(t):
    """Failed jobs with retries up to a date; two quiet days forget the failures."""
    failed = t.jobs.filter("status = 'failed'").select("job_id", "event_id", "ts", F.col("phase").alias("error"))
    retries = t.jobs.filter("status = 'processing'").filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).select("job_id", "ts")
    out = jobs.dead_letter(failed, retries, ttl_days=2)
    return out.select("job_id", "failures", F.unix_millis("last_failed").alias("last_failed"), "last_error")


@query("eventual_expiry", "SELECT event_id FROM jobs WHERE ts >= CAST('2024-01-30 00:00:00' AS TIMESTAMP) - INTERVAL 604800 SECOND")
def _(t):
    return ledger_ops.eventual_expiry(t.jobs, "2024-01-30 00:00:00", 7 * 86400).select("event_id")


@query(
    "phase_durations",
    """WITH s AS (SELECT *, lead(status) OVER w AS ns, lead(ts) OVER w AS nt FROM jobs WHERE status IN ('phase_start', 'phase_end') WINDOW w AS (PARTITION BY job_id, phase ORDER BY ts, event_id))
SELECT event_id, CASE WHEN ns = 'phase_end' THEN epoch_us(nt) // 1000 - epoch_us(ts) // 1000 END AS duration_ms, coalesce(ns = 'phase_end', false) AS closed FROM s WHERE status = 'phase_start'""",
)
def _(t):
    return jobs.phase_durations(t.jobs).select("event_id", "duration_ms", "closed")


@query(
    "session_gaps",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, count(*) AS events, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM s GROUP BY user_id, no""",
)
def _(t):
    out = jobs.session_gaps(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.select("user_id", "events", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"))


# --- Source health ---------------------------------------------------------------------


def _sql_machine(fail_at: int = 2, open_ms: int = 60_000, close_after: int = 3) -> str:
    """CTEs up to `changes`, from `health_calls` (source, event_id, ts, ok): the machine walked call by call.

    was, now: failures while closed, then successes while half open, then the millisecond until which it is open.
    """
    half, finite = fail_at, fail_at + close_after
    named = lambda s: f"CASE WHEN {s} < {half} THEN 'closed' WHEN {s} < {finite} THEN 'half_open' ELSE 'open' END"
    return f"""turns AS (SELECT source, event_id, epoch_us(ts) // 1000 AS t, ok, row_number() OVER (PARTITION BY source ORDER BY epoch_us(ts) // 1000, event_id) AS turn FROM health_calls),
walk AS (SELECT DISTINCT source, 0::BIGINT AS turn, NULL::BIGINT AS event_id, NULL::BIGINT AS t, 0::BIGINT AS was, 0::BIGINT AS now FROM turns
  UNION ALL SELECT c.source, c.turn, c.event_id, c.t, w.now, CASE WHEN w.now >= {finite} AND c.t < w.now THEN w.now
      WHEN w.now < {half} THEN CASE WHEN c.ok THEN 0 WHEN w.now + 1 < {fail_at} THEN w.now + 1 ELSE c.t + {open_ms} END
      WHEN NOT c.ok THEN c.t + {open_ms}
      WHEN CASE WHEN w.now >= {finite} THEN {half} ELSE w.now END + 1 < {finite} THEN CASE WHEN w.now >= {finite} THEN {half} ELSE w.now END + 1 ELSE 0 END
  FROM walk w JOIN turns c ON c.source = w.source AND c.turn = w.turn + 1),
steps AS (SELECT *, was >= {finite} AND t >= was AS probing, {named('was')} AS held, {named('now')} AS left_in FROM walk WHERE turn > 0),
changes AS (SELECT source, event_id, t, turn, 0 AS part, 'open' AS from_state, 'half_open' AS to_state, NULL::VARCHAR AS alert FROM steps WHERE probing
  UNION ALL SELECT source, event_id, t, turn, 1, CASE WHEN probing THEN 'half_open' ELSE held END, left_in,
    CASE WHEN NOT probing AND held = 'closed' AND left_in = 'open' THEN 'source_degraded' WHEN left_in = 'closed' THEN 'source_recovered' END
  FROM steps WHERE left_in <> CASE WHEN probing THEN 'half_open' ELSE held END),
health AS (SELECT source, arg_max(now, turn) AS s FROM walk GROUP BY source),
states AS (SELECT source, {named('s')} AS state, CASE WHEN s >= {finite} THEN s END AS open_until_ms FROM health)"""


_CALLS = "WITH health_calls AS (SELECT source, event_id, ts, ok FROM calls)"


@query(
    "circuit_state",
    f"""{_CALLS}, {_sql_machine()} SELECT source, event_id, t, CAST(row_number() OVER (PARTITION BY source, t // 3600000 ORDER BY turn, part) - 1 AS INT) AS step, from_state, to_state, alert FROM changes""",
)
def _(t):
    return jobs.circuit_state(t.calls).select("source", "event_id", "t", "step", "from_state", "to_state", "alert")


@query("circuit_health", f"{_CALLS}, {_sql_machine()} SELECT source, state, open_until_ms FROM states")
def _(t):
    return jobs.circuit_health(t.calls)


@query("circuit_registry_variant", f"{_CALLS}, {_sql_machine(3, 120_000, 1)} SELECT source, state, open_until_ms FROM states")
def _(t):
    """The registry breaker: three failures, two minutes, one probe."""
    return jobs.circuit_health(t.calls, Breaker(fail_at=3, open_ms=120_000, close_after=1))


def _sql_frozen(sources: tuple[str, ...]) -> str:
    """(source, dimension, weight): the weights that are left when the factors a source feeds are frozen out."""
    from ..functions import scores

    rows = ", ".join(f"({lit(s)}, {lit(d)}, {float(w)!r}::DOUBLE)" for s in sources for d, w in scores.freeze_weights(L.MODE_WEIGHTS["evidence"], [s]).items())
    return f"(VALUES {rows}) v(source, dimension, weight)"


@query(
    "degraded_weights",
    f"""WITH health_calls AS (SELECT CASE source WHEN 's0' THEN 'crossref' WHEN 's1' THEN 'pubmed' ELSE source END AS source, event_id, ts, ok FROM calls), {_sql_machine()}
SELECT states.source, state, dimension, round(weight, 6) AS weight FROM states JOIN {_sql_frozen(('crossref', 'pubmed'))} ON states.source = v.source""",
)
def _(t):
    """Composite weights per source-health snapshot: factors of open sources are frozen out."""
    from ..functions import scores

    named = t.calls.withColumn("source", F.when(F.col("source") == "s0", "crossref").when(F.col("source") == "s1", "pubmed").otherwise(F.col("source")))
    health = jobs.circuit_health(named)
    rows = F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(d).alias("dimension"), F.lit(float(w)).alias("weight"))
        for s in ("crossref", "pubmed") for d, w in scores.freeze_weights(L.MODE_WEIGHTS["evidence"], [s]).items()
    ])
    frozen = health.select("source", "state", F.explode(rows).alias("w")).filter("source = w.source")
    return frozen.select("source", "state", "w.dimension", F.round("w.weight", 6).alias("weight"))


# --- Quotas ----------------------------------------------------------------------------


@query(
    "quota_tier",
    "SELECT event_id, max_mb, per_minute, cost_limit FROM usage JOIN (VALUES " + ", ".join(f"('{t[0]}', {t[1]}, {t[3]}, {t[6]}::DOUBLE)" for t in L.QUOTA_TIERS) + ") q(tier, max_mb, per_minute, cost_limit) ON usage.tier = q.tier",
)
def _(t):
    return jobs.quota_tier(t.usage).select("event_id", "max_mb", "per_minute", "cost_limit")


@query(
    "rate_windows",
    """WITH m AS (SELECT api_key, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS in_minute FROM usage GROUP BY ALL), d AS (SELECT *, make_timestamp(minute * 60000000) AS at_ts FROM m)
SELECT api_key, minute, in_minute, CAST(sum(in_minute) OVER (PARTITION BY api_key ORDER BY minute RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two_minutes,
  CAST(sum(in_minute) OVER (PARTITION BY api_key, strftime(at_ts, '%Y-%m-%d')) AS BIGINT) AS in_day, CAST(sum(in_minute) OVER (PARTITION BY api_key, strftime(at_ts, '%Y-%m')) AS BIGINT) AS in_month FROM d""",
)
def _(t):
    return jobs.rate_windows(t.usage).select("api_key", "minute", "in_minute", "two_minutes", "in_day", "in_month")


_COST = "round(processing_ms / 1000.0::DOUBLE * 0.0000166667::DOUBLE + 0.0000000021::DOUBLE, 10)"


@query(
    "cost_report",
    f"""SELECT month, requests, round(c, 6) AS cost_usd, round(greatest(0, 0.5 - c), 6) AS remaining_usd, round(c / 0.5 * 100, 2) AS pct_used, c / 0.5 * 100 >= 80 AS throttle, c / 0.5 * 100 >= 95 AS stop
FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS requests, sum({_COST})::DOUBLE AS c FROM usage GROUP BY 1)""",
)
def _(t):
    return jobs.cost_report(t.usage, 0.5)


@query(
    "admission_offered",
    f"""WITH b AS (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, {_COST} AS cost, epoch_us(ts) // 1000 AS ms FROM usage),
q(tier, max_mb, max_pages, per_minute, per_day, concurrent, cost_limit) AS (VALUES {', '.join(str(x) for x in L.QUOTA_TIERS)}),
n AS (SELECT b.*, q.* EXCLUDE (tier), row_number() OVER (PARTITION BY api_key, minute ORDER BY ts, event_id) - 1 AS im, row_number() OVER (PARTITION BY api_key, day ORDER BY ts, event_id) - 1 AS idy,
  coalesce(sum(cost) OVER (PARTITION BY api_key, month ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b JOIN q ON b.tier = q.tier),
pm AS (SELECT api_key, minute + 1 AS minute, count(*) AS before FROM b GROUP BY ALL),
mv AS (SELECT api_key, event_id, ms AS t, 1 AS delta FROM b UNION ALL SELECT api_key, event_id, ms + CAST(ceil(processing_ms) AS BIGINT), -1 FROM b),
ac AS (SELECT api_key, event_id, delta, sum(delta) OVER (PARTITION BY api_key ORDER BY t, delta, event_id ROWS UNBOUNDED PRECEDING) AS active FROM mv),
d AS (SELECT n.event_id, n.api_key, CASE WHEN file_size_mb > max_mb THEN 'file_too_large' WHEN pages > max_pages THEN 'too_many_pages' WHEN im + coalesce(before, 0) >= per_minute THEN 'rate_exceeded_minute'
  WHEN idy >= per_day THEN 'rate_exceeded_daily' WHEN active - 1 >= concurrent THEN 'concurrent_limit_exceeded' WHEN cost_limit > 0 AND spent >= cost_limit THEN 'monthly_cost_limit_exceeded' ELSE '' END AS reason
  FROM n LEFT JOIN pm ON n.api_key = pm.api_key AND n.minute = pm.minute JOIN ac ON n.event_id = ac.event_id AND ac.delta = 1)
SELECT event_id, api_key, reason = '' AS allowed, reason FROM d""",
)
def _(t):
    return jobs.admission_offered(t.usage).select("event_id", "api_key", "allowed", "reason")


# --- Streams, run to the end of the given table ------------------------------------------


@query("stream_circuit", f"{_CALLS}, {_sql_machine()} SELECT source, event_id, t, from_state, to_state, alert FROM changes")
def _(t):
    return drive.run(t, "events", lambda s: processors.circuit_stream(t.over("calls", s)), "Append")


@query(
    "stream_job_status",
    "SELECT job_id, max_by(status, (status IN ('completed', 'failed', 'cancelled'), ts, event_id)) AS status FROM jobs GROUP BY job_id",
)
def _(t):
    return drive.run(t, "events", lambda s: processors.job_status_stream(t.over("jobs", s)), "Update", latest=["job_id"])


@query("stream_admission")
def _(t):
    return drive.run(t, "events", lambda s: processors.admission_stream(t.over("usage", s)), "Append")


@query("stream_minute_counts", "SELECT api_key, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS start_s, count(*) AS requests FROM usage GROUP BY ALL")
def _(t):
    return drive.run(t, "events", lambda s: processors.minute_counts_stream(t.over("usage", s)), "Update", latest=["api_key", "start_s"])


#: A job's failures, finished phases and retries, with a file size.
_QUEUE = """SELECT job_id, event_id, ts, CASE status WHEN 'failed' THEN 'failure' WHEN 'phase_end' THEN 'phase' ELSE 'retry' END AS kind, phase, event_id % 1000 AS size, duration_ms AS ms, phase AS error
FROM jobs WHERE status IN ('failed', 'phase_end') OR (status = 'processing' AND event_id % 2 = 0)"""
_SQL_QUEUE = f"""WITH q AS ({_QUEUE}), o AS (SELECT *, epoch_us(ts) // 1000 AS t, lag(kind) OVER w AS pk, lag(ts) OVER w AS pt, lead(ts) OVER w AS nt FROM q WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk = 'retry' OR t - epoch_us(pt) // 1000 > 4 * 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM o),
r AS (SELECT a.job_id, a.kind, a.t, epoch_us(any_value(a.nt)) // 1000 AS nt, a.error, a.event_id, count_if(b.kind = 'failure') AS failures, min(b.t) FILTER (WHERE b.kind = 'failure') AS first_t, count(DISTINCT b.phase) FILTER (WHERE b.kind = 'phase') AS phases_completed,
  max(b.size) AS size, coalesce(sum(b.ms) FILTER (WHERE b.kind = 'phase'), 0) AS total_ms FROM s a JOIN s b ON a.job_id = b.job_id AND a.stretch = b.stretch AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id))
  WHERE a.kind <> 'retry' AND b.kind <> 'retry' GROUP BY a.job_id, a.kind, a.t, a.error, a.event_id HAVING count_if(b.kind = 'failure') >= 2)
SELECT job_id, 'dead' AS kind, t, CAST(failures AS BIGINT) AS failures, first_t, phases_completed, size, total_ms, error AS last_error FROM r WHERE kind = 'failure'
UNION ALL SELECT job_id, 'expired', t + 4 * 86400000, CAST(failures AS BIGINT), first_t, phases_completed, size, total_ms, NULL FROM r WHERE nt - t > 4 * 86400000 OR (nt IS NULL AND t + 4 * 86400000 < (SELECT max(epoch_us(ts) // 1000) FROM q))"""


@query("dead_letter_queue", _SQL_QUEUE)
def _(t):
    return jobs.dead_letter_queue(t.sql(_QUEUE), limit=2, ttl_days=4)


@query("stream_dead_letter_queue", _SQL_QUEUE)
def _(t):
    """The same rows from the log as a stream; quiet jobs are forgotten by event-time timers."""
    build = lambda s: processors.dead_letter_queue_stream(_queue(t.over("jobs", s)), limit=2, ttl_days=4)
    return drive.run(t, "events", build, "Update")


def _queue(rows):
    kind = F.when(F.col("status") == "failed", "failure").when(F.col("status") == "phase_end", "phase").otherwise("retry")
    wanted = rows.filter("status IN ('failed', 'phase_end') OR (status = 'processing' AND event_id % 2 = 0)")
    return wanted.select("job_id", "event_id", "ts", kind.alias("kind"), "phase", (F.col("event_id") % 1000).alias("size"), F.col("duration_ms").alias("ms"), F.col("phase").alias("error"))


@query(
    "stream_late",
    """WITH h AS (SELECT b.n AS batch, max(e.ts) AS high FROM (SELECT unnest([1, 2]) AS n) b JOIN events e ON e.event_id % 3 < b.n GROUP BY b.n)
SELECT event_id, event_id % 3 AS batch, coalesce(CAST(ts AS TIMESTAMP) < CAST(high AS TIMESTAMP) - INTERVAL 864000 SECOND, false) AS late FROM events LEFT JOIN h ON batch = event_id % 3""",
)
def _(t):
    """The log as three shuffled files: what comes more than ten days behind goes to the late table."""
    base = drive.new_base(t.spark)
    for k in range(3):
        t.events.filter(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.parquet(f"{base}/log/{k}")
    on_time, late = drive.run_split(t, "events", lambda s: s.select("event_id", F.col("ts").cast("timestamp").alias("ts")), 10 * 86400, folder=f"{base}/log/*", files=1)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("event_id", "batch", "late")


@query(
    "stream_dead_letter",
    """SELECT job_id, CAST(rn AS BIGINT) AS failures FROM (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM jobs WHERE status = 'failed') WHERE rn >= 2""",
)
def _(t):
    def build(s):
        failed = t.over("jobs", s).filter("status = 'failed'").withColumn("kind", F.lit("failure")).withColumn("error", F.col("phase"))
        return processors.dead_letter_stream(failed, ttl_days=60)

    return drive.run(t, "events", build, "Update").select("job_id", "failures")


@query(
    "stream_replay",
    "SELECT event_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM jobs) WHERE rn <= 20",
)
def _(t):
    """The buffer per job after its last micro-batch."""
    return drive.run(t, "events", lambda s: processors.replay_stream(t.over("jobs", s), 20), "Update", latest=["job_id"]).select("event_id", "job_id")


@query(
    "stream_phase_durations",
    """SELECT event_id AS start_id, next_id AS end_id, epoch_us(next_ts) // 1000 - epoch_us(ts) // 1000 AS duration_ms FROM (
  SELECT *, lead(status) OVER w AS next_status, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM jobs WHERE status IN ('phase_start', 'phase_end')
  WINDOW w AS (PARTITION BY job_id, phase ORDER BY ts, event_id)) WHERE status = 'phase_start' AND next_status = 'phase_end'""",
)
def _(t):
    return drive.run(t, "events", lambda s: processors.phase_durations_stream(t.over("jobs", s)), "Append").select("start_id", "end_id", "duration_ms")


@query(
    "stream_dedup",
    f"""SELECT work_id FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN {sql_title('title')} <> '' THEN {sql_hash()} ELSE concat('own:', CAST(work_id AS STRING)) END ORDER BY seq) AS hash_no FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(nullif({sql_doi('doi')}, ''), concat('own:', CAST(work_id AS STRING))) ORDER BY seq) AS doi_no FROM works) WHERE doi_no = 1) WHERE hash_no = 1""",
)
def _(t):
    return drive.run(t, "documents", lambda s: processors.dedup_stream(t.over("works", s)), "Append").select("work_id")


# --- Layout ----------------------------------------------------------------------------

_B = "(SELECT *, left_pt AS x0, left_pt + width_pt AS x1, top_pt AS y0, top_pt + height_pt AS y1 FROM boxes)"
_HIT = "a.page_id = b.page_id AND a.box_id < b.box_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_W = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))"
_OVERLAPS = f"SELECT a.page_id, a.box_id AS box_a, b.box_id AS box_b, round({_W} * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 4) AS area FROM {_B} a JOIN {_B} b ON {_HIT}"


@query("box_overlaps", _OVERLAPS)
def _(t):
    return layout.box_overlaps(t.boxes).withColumn("area", F.round("area", 4))


_COLLIDE = f"""SELECT a.page_id, CASE WHEN a.y0 <= b.y0 THEN a.box_id ELSE b.box_id END AS upper_id, CASE WHEN a.y0 <= b.y0 THEN b.box_id ELSE a.box_id END AS lower_id,
  round(CASE WHEN a.y0 <= b.y0 THEN a.y1 - b.y0 ELSE b.y1 - a.y0 END, 4) AS overlap_pt FROM {_B} a JOIN {_B} b ON {_HIT} AND {_W} / least(a.width_pt, b.width_pt) > 0.2"""


@query("box_collisions", _COLLIDE)
def _(t):
    return layout.box_collisions(t.boxes).withColumn("overlap_pt", F.round("overlap_pt", 4))


@query(
    "collision_groups",
    f"""WITH c AS ({_COLLIDE}), e AS (SELECT page_id, upper_id AS u, lower_id AS v FROM c UNION SELECT page_id, lower_id, upper_id FROM c),
r AS (SELECT page_id, u, v FROM e UNION SELECT r.page_id, r.u, e.v FROM r JOIN e ON r.page_id = e.page_id AND r.v = e.u)
SELECT b.page_id, b.box_id, coalesce(min(least(r.u, r.v)), b.box_id)::BIGINT AS group_id FROM boxes b LEFT JOIN r ON b.page_id = r.page_id AND b.box_id = r.u GROUP BY b.page_id, b.box_id""",
)
def _(t):
    return layout.collision_groups(t.boxes)


_BLOCKS = "SELECT l_orderkey AS page_id, l_linenumber AS block_id, l_quantity * 6 AS bx0, l_quantity * 6 + 260 AS bx1, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 500 AS DOUBLE) AS by0, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 500 AS DOUBLE) + 300 AS by1 FROM lineitem"


@query(
    "assign_to_blocks",
    f"SELECT s.page_id, s.box_id, b.block_id FROM boxes s JOIN ({_BLOCKS}) b ON s.page_id = b.page_id AND s.left_pt BETWEEN b.bx0 AND b.bx1 AND s.top_pt BETWEEN b.by0 AND b.by1",
)
def _(t):
    return layout.assign_to_blocks(t.boxes, t.sql(_BLOCKS)).select("page_id", "box_id", "block_id")


_TABLES = "SELECT page_id, box_id AS table_id, left_pt AS tx0, left_pt + width_pt AS tx1, top_pt AS ty0 FROM boxes WHERE width_pt > 100"


@query(
    "above_table",
    f"SELECT page_id, box_id FROM {_B} b WHERE EXISTS (SELECT 1 FROM ({_TABLES}) t WHERE t.page_id = b.page_id AND b.y1 <= t.ty0 AND b.x0 < t.tx1 AND b.x1 > t.tx0)",
)
def _(t):
    return layout.above_table(t.boxes, t.sql(_TABLES)).select("page_id", "box_id")


# texts and boxes tight enough that lines and blocks form
_SPANS = """SELECT l_orderkey AS page_id, ((CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS box_id, CAST(l_linenumber % 3 AS DOUBLE) * 52 AS left_pt, CAST(floor(l_linenumber / 3) * (12 + l_orderkey % 9) AS DOUBLE) AS top_pt,
  50 + l_tax * 20 AS width_pt, CAST(10 AS DOUBLE) AS height_pt, CAST(8 + l_orderkey % 4 AS DOUBLE) AS font_size, concat(l_returnflag, CAST(l_linenumber AS STRING)) AS text FROM lineitem"""


def _sql_lines(source: str) -> str:
    w = "WINDOW w AS (PARTITION BY page_id ORDER BY top_pt, left_pt, box_id)"
    return f"""SELECT page_id, CAST(line_id AS BIGINT) AS line_id, min(left_pt) AS left_pt, min(top_pt) AS top_pt, max(left_pt + width_pt) - min(left_pt) AS width_pt, max(top_pt + height_pt) - min(top_pt) AS height_pt, avg(font_size) AS font_size, count(*) AS members,
  string_agg(text, ' ' ORDER BY top_pt, left_pt, box_id) AS text
FROM (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY top_pt, left_pt, box_id ROWS UNBOUNDED PRECEDING) AS line_id FROM (SELECT *, CASE WHEN left_pt - lag(left_pt + width_pt) OVER w <= font_size * 0.3 AND abs(top_pt - lag(top_pt) OVER w) < font_size * 0.5 THEN 0 ELSE 1 END AS brk FROM ({source}) {w})) GROUP BY page_id, line_id"""


@query("line_clusters", f"SELECT page_id, line_id, round(left_pt, 4) AS left_pt, round(width_pt, 4) AS width_pt, members, text FROM ({_sql_lines(_SPANS)})")
def _(t):
    out = layout.line_clusters(t.sql(_SPANS))
    return out.select("page_id", "line_id", F.round("left_pt", 4).alias("left_pt"), F.round("width_pt", 4).alias("width_pt"), "members", "text")


@query(
    "block_clusters",
    f"""WITH l AS ({_sql_lines(_SPANS)}), k AS (SELECT *, CASE WHEN abs(top_pt - lag(top_pt) OVER w) < font_size * 1.5 AND left_pt - lag(left_pt + width_pt) OVER w < font_size * 2 THEN 0 ELSE 1 END AS brk FROM l WINDOW w AS (PARTITION BY page_id ORDER BY top_pt, left_pt, line_id)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY top_pt, left_pt, line_id ROWS UNBOUNDED PRECEDING) AS block_id FROM k)
SELECT page_id, CAST(block_id AS BIGINT) AS block_id, count(*) AS members, string_agg(text, '/' ORDER BY top_pt, left_pt, line_id) AS text FROM n GROUP BY page_id, block_id""",
)
def _(t):
    blocks = layout.block_clusters(layout.line_clusters(t.sql(_SPANS)))
    return blocks.select("page_id", "block_id", "members", F.replace("text", F.lit("\n"), F.lit("/")).alias("text"))


@query(
    "vertical_stacks",
    """WITH c AS (SELECT *, sum(far) OVER (PARTITION BY page_id ORDER BY left_pt, box_id ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN left_pt - lag(left_pt) OVER (PARTITION BY page_id ORDER BY left_pt, box_id) <= 70 THEN 0 ELSE 1 END AS far FROM boxes)),
g AS (SELECT *, CASE WHEN gap >= 0 AND gap <= fs * 6 THEN 0 ELSE 1 END AS cut FROM (SELECT *, top_pt - lag(top_pt + height_pt) OVER w AS gap, (font_size + lag(font_size) OVER w) / 2 AS fs FROM c WINDOW w AS (PARTITION BY page_id, col ORDER BY top_pt, box_id))),
s AS (SELECT *, sum(cut) OVER (PARTITION BY page_id, col ORDER BY top_pt, box_id ROWS UNBOUNDED PRECEDING) AS stack FROM g),
m AS (SELECT *, count(*) OVER (PARTITION BY page_id, col, stack) AS members, first_value(box_id) OVER (PARTITION BY page_id, col, stack ORDER BY top_pt, box_id) AS anchor_id FROM s)
SELECT page_id, box_id, anchor_id, members FROM m WHERE members >= 2""",
)
def _(t):
    return layout.vertical_stacks(t.boxes, 700.0, gap_multiplier=6.0).select("page_id", "box_id", "anchor_id", "members")


@query(
    "column_gaps",
    f"""WITH c AS (SELECT page_id, box_id, left_pt + width_pt / 2 AS center FROM boxes), g AS (SELECT *, center - lag(center) OVER w AS gap, row_number() OVER w AS i, count(*) OVER (PARTITION BY page_id) AS n FROM c WINDOW w AS (PARTITION BY page_id ORDER BY center, box_id)),
s AS (SELECT page_id, max(n) AS n, max(gap) AS mx, avg(gap) AS av, max(CASE WHEN i = floor(n / 2) + 1 THEN center END) AS med FROM g GROUP BY page_id),
l AS (SELECT g.page_id, count(*) FILTER (WHERE center < med) AS left_n FROM g JOIN s ON g.page_id = s.page_id GROUP BY g.page_id), o AS (SELECT page_id, count(*) AS k FROM ({_OVERLAPS}) GROUP BY page_id)
SELECT s.page_id, n, coalesce(k, 0) AS overlaps, n >= 3 AND (mx > av * 3 AND least(left_n, n - left_n) > 2) AS multi_column, n >= 3 AND ((mx > av * 3 AND least(left_n, n - left_n) > 2) OR coalesce(k, 0) > n * 0.3) AS complex
FROM s JOIN l ON s.page_id = l.page_id LEFT JOIN o ON s.page_id = o.page_id""",
)
def _(t):
    out = layout.column_gaps(t.boxes)
    return out.select("page_id", "n", "overlaps", F.coalesce("multi_column", F.lit(False)).alias("multi_column"), F.coalesce("complex", F.lit(False)).alias("complex"))


_ORDER = "SELECT page_id, left_pt AS x, top_pt AS y, CAST(row_number() OVER (PARTITION BY page_id ORDER BY text, top_pt DESC, box_id) AS INT) AS order_no FROM boxes WHERE font_size < 11"


@query(
    "reading_order",
    f"""WITH o AS ({_ORDER}), k AS (SELECT page_id, round(x, 1) AS x, round(y, 1) AS y, max(order_no) AS o FROM o GROUP BY ALL)
SELECT b.page_id, b.box_id, CAST(row_number() OVER (PARTITION BY b.page_id ORDER BY coalesce(k.o, 1000000), b.box_id) AS INT) AS position FROM boxes b LEFT JOIN k ON b.page_id = k.page_id AND round(b.left_pt, 1) = k.x AND round(b.top_pt, 1) = k.y""",
)
def _(t):
    return layout.reading_order(t.boxes, t.sql(_ORDER)).select("page_id", "box_id", "position")


_ROLE_BOXES = "SELECT *, CASE WHEN box_id % 2 = 0 THEN 'Arial-Bold' ELSE 'Arial' END AS font_name FROM (SELECT page_id, box_id, left_pt, top_pt, width_pt, height_pt, font_size, CASE WHEN box_id % 5 = 3 THEN '1. item' WHEN box_id % 5 = 4 THEN '- item' ELSE text END AS text FROM boxes)"


@query(
    "semantic_roles",
    f"""WITH b AS ({_ROLE_BOXES}), t1 AS (SELECT page_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY font_size DESC, box_id) AS rn FROM b WHERE top_pt <= 140) WHERE rn = 1),
t2 AS (SELECT page_id, box_id FROM (SELECT b.*, row_number() OVER (PARTITION BY b.page_id ORDER BY font_size DESC, b.box_id) AS rn FROM b LEFT JOIN t1 ON b.page_id = t1.page_id AND b.box_id = t1.box_id WHERE top_pt <= 210 AND t1.box_id IS NULL) WHERE rn = 1)
SELECT b.page_id, b.box_id, CASE WHEN t1.box_id IS NOT NULL THEN 'title' WHEN t2.box_id IS NOT NULL THEN 'subtitle'
  WHEN font_name LIKE '%Bold' AND EXISTS (SELECT 1 FROM ({_TABLES}) t WHERE t.page_id = b.page_id AND b.top_pt + b.height_pt <= t.ty0 AND b.left_pt < t.tx1 AND b.left_pt + b.width_pt > t.tx0) THEN 'column_header'
  WHEN b.box_id % 5 IN (3, 4) OR regexp_matches(text, {lit(L.LIST_ITEM_PATTERN)}) THEN 'list_item' WHEN top_pt <= 56 AND font_size > 12 THEN 'header' WHEN top_pt + height_pt >= 644 AND font_size < 10.2 THEN 'footer' WHEN top_pt >= 595 AND font_size < 10.2 THEN 'caption' ELSE 'body' END AS role
FROM b LEFT JOIN t1 ON b.page_id = t1.page_id AND b.box_id = t1.box_id LEFT JOIN t2 ON b.page_id = t2.page_id AND b.box_id = t2.box_id""",
)
def _(t):
    return layout.semantic_roles(t.sql(_ROLE_BOXES), 700.0, 12.0, t.sql(_TABLES)).select("page_id", "box_id", "role")


_CELLS = "SELECT l_suppkey AS table_id, l_linenumber AS row_no, CAST(l_orderkey % 15 AS INT) AS col_no, CASE WHEN l_suppkey % 4 = 0 AND l_quantity > 8 THEN ' ' ELSE l_returnflag END AS value FROM lineitem"
_CELLS_TALL = _CELLS.replace("l_linenumber AS row_no", "CAST(l_orderkey % 29 AS INT) AS row_no")


@query(
    "table_validity",
    f"""SELECT table_id, count(DISTINCT row_no) AS n_rows, count(DISTINCT col_no) AS n_cols, CASE WHEN count(DISTINCT row_no) > 20 AND count(DISTINCT col_no) > 10 THEN format('grid_hallucination_{{}}x{{}}', count(DISTINCT row_no), count(DISTINCT col_no))
  WHEN count(*) FILTER (WHERE trim(coalesce(value, '')) = '') / count(*) > 0.7 THEN 'sparse_data' ELSE 'valid' END AS verdict FROM ({_CELLS}) GROUP BY table_id
UNION ALL SELECT table_id + 1000000, count(DISTINCT row_no), count(DISTINCT col_no), CASE WHEN count(DISTINCT row_no) > 20 AND count(DISTINCT col_no) > 10 THEN format('grid_hallucination_{{}}x{{}}', count(DISTINCT row_no), count(DISTINCT col_no))
  WHEN count(*) FILTER (WHERE trim(coalesce(value, '')) = '') / count(*) > 0.7 THEN 'sparse_data' ELSE 'valid' END FROM ({_CELLS_TALL}) GROUP BY table_id""",
)
def _(t):
    cells = t.sql(_CELLS).unionByName(t.sql(_CELLS_TALL).withColumn("table_id", F.col("table_id") + 1000000))
    return layout.table_validity(cells).select("table_id", "n_rows", "n_cols", "verdict")


@query(
    "box_checks",
    f"""WITH s AS (SELECT page_id, count(*) AS shapes, count(*) FILTER (WHERE NOT (width_pt > 0 AND height_pt > 0)) AS zero_dimension, count(*) FILTER (WHERE left_pt < 0 OR top_pt < 0 OR left_pt + width_pt > 420 OR top_pt + height_pt > 700) AS out_of_bounds,
  count(*) FILTER (WHERE NOT (left_pt BETWEEN 0 AND 840 AND top_pt BETWEEN 0 AND 1400 AND width_pt > 0 AND width_pt <= 840 AND height_pt > 0 AND height_pt <= 1400)) AS insane, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty_text FROM boxes GROUP BY page_id),
o AS (SELECT page_id, count(*) AS k FROM ({_OVERLAPS}) GROUP BY page_id), j AS (SELECT s.*, coalesce(k, 0) AS "overlaps" FROM s LEFT JOIN o ON s.page_id = o.page_id)
SELECT page_id, shapes, zero_dimension, out_of_bounds, "overlaps", round((1 + ("overlaps" = 0)::INT + (zero_dimension = 0)::INT + (out_of_bounds = 0)::INT + (insane = 0)::INT + (empty_text = 0)::INT + (shapes <= 20)::INT) / 7, 6) AS score FROM j""",
)
def _(t):
    return layout.box_checks(t.boxes, 420.0, 700.0).select("page_id", "shapes", "zero_dimension", "out_of_bounds", "overlaps", "score")


_EVENTS = """SELECT CASE box_id % 3 WHEN 0 THEN 'fallback' WHEN 1 THEN 'font' ELSE 'collision' END AS kind, CASE WHEN box_id % 3 = 1 THEN text ELSE '' END AS name, page_id AS page,
  CASE WHEN box_id % 3 = 2 THEN box_id % 7 END AS pushes, CASE WHEN box_id % 3 = 2 THEN height_pt END AS max_push FROM boxes"""


@query("summary_rollup", f"SELECT kind, name, count(*) AS entries, count(DISTINCT page) AS pages, coalesce(sum(pushes), 0)::BIGINT AS pushes, round(coalesce(max(max_push), 0), 4) AS max_push FROM ({_EVENTS}) GROUP BY kind, name")
def _(t):
    return metrics.summary_rollup(t.sql(_EVENTS)).withColumn("max_push", F.round("max_push", 4))


@query("rollup_pages", f"SELECT DISTINCT kind, name, page FROM ({_EVENTS})")
def _(t):
    return metrics.rollup_pages(t.sql(_EVENTS))


_PAGE_STATS = "SELECT page_id % 500 AS doc_id, count(*) AS raw, count(DISTINCT text) AS merged FROM boxes GROUP BY page_id"


@query(
    "reduction_stats",
    f"SELECT doc_id, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(merged) AS BIGINT) AS merged, round((1 - sum(merged) / greatest(1, sum(raw))) * 100, 1) AS reduction_pct FROM ({_PAGE_STATS}) GROUP BY doc_id",
)
def _(t):
    return metrics.reduction_stats(t.sql(_PAGE_STATS))


@query(
    "reduction_total",
    f"SELECT CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(merged) AS BIGINT) AS merged, round(avg(p), 1) AS avg_reduction_pct FROM (SELECT sum(raw) AS raw, sum(merged) AS merged, round((1 - sum(merged) / greatest(1, sum(raw))) * 100, 1) AS p FROM ({_PAGE_STATS}) GROUP BY doc_id)",
)
def _(t):
    return metrics.reduction_total(metrics.reduction_stats(t.sql(_PAGE_STATS)))
