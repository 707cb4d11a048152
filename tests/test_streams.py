"""A stream over a log split into files ends where its batch twin ends."""

import os
from types import SimpleNamespace

import pandas as pd
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleanery.operators import dedup, jobs
from gleanery.plans.catalogue import load
from gleanery.plans.fixtures import Tables
from gleanery.streaming import drive, processors

from .oracle import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_log(spark, tmp_path_factory):
    """The event table as three files in time order, so state crosses micro-batches."""
    t = Tables(spark, SMALL)
    path = str(tmp_path_factory.mktemp("log") / "events")
    for n, (a, b) in enumerate([("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2025-01-01")]):
        t.events.filter(f"ts >= '{a}' AND ts < '{b}'").coalesce(1).write.parquet(f"{path}/{n}")
    return t, f"{path}/*"


def test_circuit(spark, split_log):
    t, path = split_log
    live = drive.run(t, "events", lambda s: processors.circuit_stream(t.over("calls", s)), "Append", path)
    twin = jobs.circuit_state(t.calls)
    cols = ["source", "event_id", "t", "from_state", "to_state"]
    assert sorted(map(tuple, live.select(*cols).collect())) == sorted(map(tuple, twin.select(*cols).collect()))


def test_admission_never_admits_more_load_than_the_limits(spark, split_log):
    t, path = split_log
    live = drive.run(t, "events", lambda s: processors.admission_stream(t.over("usage", s)), "Append", path)
    assert live.count() == t.usage.count()
    admitted = live.filter("allowed").join(t.usage, "event_id").groupBy(live["api_key"], F.to_date("ts")).agg(
        F.count("*").alias("n"), F.max("tier").alias("tier")
    )
    assert admitted.filter("n > 10000").count() == 0


def test_admission_counts_only_admitted_requests():
    limits = {"max_mb": 10, "max_pages": 10, "per_minute": 2, "per_day": 3, "concurrent": 5, "cost_limit": 0.0}
    state = processors.fresh_quota()
    ask = lambda t, mb=1.0: processors.decide(state, limits, t, mb, 1, 1.0, 0.0, False)[0]
    assert [ask(0, 99), ask(0), ask(1), ask(2), ask(120_000), ask(240_000), ask(86_400_000)] == [
        "file_too_large", "", "", "rate_exceeded_minute", "", "rate_exceeded_daily", "",
    ]


def test_late_rows_are_kept_apart(spark, tmp_path):
    """Three files out of order: late rows are those behind the files before, and none is lost."""
    files = [[(1, 100), (2, 500)], [(3, 450), (4, 399), (5, 2000), (6, None)], [(7, 1000), (8, 1900), (9, 5000)]]
    for n, rows in enumerate(files):
        made = spark.createDataFrame(rows, "event_id int, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
        made.coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
    on_time, late = drive.run_split(SimpleNamespace(spark=spark), "log", lambda s: s, 100, folder=f"{tmp_path}/log/*", files=1)
    assert sorted((r["event_id"], r["batch"]) for r in late.collect()) == [(4, 1), (7, 2)]
    assert sorted((r["event_id"], r["batch"]) for r in on_time.collect()) == [(1, 0), (2, 0), (3, 1), (5, 1), (6, 1), (8, 2), (9, 2)]


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    split = drive.LateSplit(spark, str(tmp_path), 10, "ts")
    batch = lambda *s: spark.createDataFrame([(x,) for x in s], "s long").select(F.timestamp_seconds("s").alias("ts"))
    split(batch(100, 200), 0)
    for _ in range(2):  # the second time as after a failure
        split(batch(185, 195, 900), 1)
    split(batch(195, 895), 2)
    rows = split.rows(batch(1).schema).select(F.unix_seconds("ts").alias("s"), "late", "batch").collect()
    assert sorted((r["batch"], r["s"], r["late"]) for r in rows) == [(0, 100, False), (0, 200, False), (1, 185, True), (1, 195, False), (1, 900, False), (2, 195, True), (2, 895, False)]


def test_dedup_stream_keeps_works_without_a_title(spark, tmp_path):
    rows = [(i, i, t, 2020, "Lee, A", d) for i, (t, d) in enumerate([(None, None), (None, None), ("", None), ("?!", None), ("A title", None), ("a title", None), (None, "10.1/a"), ("?", "10.1/A")])]
    works = spark.createDataFrame(rows, "work_id long, seq long, title string, year int, first_author string, doi string")
    works.coalesce(1).write.parquet(f"{tmp_path}/works")
    live = drive.run(SimpleNamespace(spark=spark), "works", processors.dedup_stream, "Append", f"{tmp_path}/works")
    kept = {r["work_id"] for r in live.select("work_id").collect()}
    assert kept == {0, 1, 2, 3, 4, 6} == {r["work_id"] for r in dedup.dedup_exact(works).collect()}


def test_quiet_jobs_are_forgotten(spark, tmp_path):
    """After the last expiry the state holds only what the end of the log could still bring back."""
    rows = [("a", 1, 0, "phase", "x"), ("a", 2, 1, "failure", None), ("a", 3, 2, "failure", None), ("b", 4, 2, "failure", None), ("c", 5, 3, "phase", "x"), ("c", 6, 4, "retry", None)]
    files = [rows[:3], rows[3:], [("d", 7, 40, "phase", "y")]]
    for n, part in enumerate(files):
        made = spark.createDataFrame([(j, e, (d + 100) * 86_400, k, p, 5, 1.0, "e") for j, e, d, k, p in part], "job_id string, event_id long, s long, kind string, phase string, size long, ms double, error string")
        made.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
    base, seen = str(tmp_path / "run"), []
    build = lambda s: processors.dead_letter_queue_stream(s, 2, 7)
    drive._to_the_end(SimpleNamespace(spark=spark), "log", build, "update", f"{tmp_path}/log/*", 1, base, lambda batch, _n: seen.extend(batch.collect()))
    assert [(r["job_id"], r["kind"], r["failures"], r["phases_completed"], r["size"], r["total_ms"]) for r in seen] == [("a", "dead", 2, 1, 5, 1.0), ("a", "expired", 2, 1, 5, 1.0)]
    held = spark.read.format("statestore").option("stateVarName", "entry").load(f"{base}/checkpoint").select("key.job_id").collect()
    assert [r["job_id"] for r in held] == ["d"]


QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def three_files(tmp_path_factory):
    """The small tables with the logs as three files each, in order of time."""
    folder = tmp_path_factory.mktemp("three")
    for name, order in (("events", "ts"), ("documents", "doc_id")):
        rows = pq.read_table(f"{SMALL}/{name}.parquet")
        rows = rows.take(pc.sort_indices(rows, [(order, "ascending")]))
        os.mkdir(folder / f"{name}.parquet")
        step = -(-len(rows) // 3)
        for n in range(3):
            path = folder / f"{name}.parquet" / f"{n}.parquet"
            pq.write_table(rows.slice(n * step, step), path)
            os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stream_") and n in ORACLES))
@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_its_sql_over_micro_batches(spark, three_files, monkeypatch, name, batches):
    monkeypatch.setattr(drive, "FILES_PER_TRIGGER", 3 // batches)
    verdict, rows = compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], three_files)
    assert verdict == "ok" and rows > 0


class Held:
    """The state of one bucket, outside Spark."""

    def __init__(self):
        self.rows, self.map = [], {}

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: bool(self.map), update=lambda _v: None)

    def getListState(self, *_):
        return SimpleNamespace(get=lambda: iter(self.rows), put=lambda rows: setattr(self, "rows", rows), clear=lambda: self.rows.clear())

    def getMapState(self, *_):
        return SimpleNamespace(containsKey=lambda k: k in self.map, updateValue=self.map.__setitem__)


def test_one_call_has_all_phases_of_a_bucket():
    machine, held, got = processors.PhaseProcessor(), Held(), []
    machine.init(held)
    rows = [("a", "x", 1, 10, "start"), ("b", "x", 2, 5, "start"), ("a", None, 3, 1, "start"), ("a", None, 4, 4, "end"), ("b", "x", 5, 9, "start"), ("c", "x", 6, 1, "end")]
    for part in (rows, [("a", "x", 7, 2, "end"), ("b", "x", 8, 20, "end"), ("b", "x", 9, 21, "end")]):
        pdf = pd.DataFrame([(*r[:4], f"phase_{r[4]}") for r in part], columns=["job_id", "phase", "event_id", "t", "status"])
        for out in machine.handleInputRows((0,), iter([pdf]), None):
            got += out[["start_id", "end_id", "duration_ms"]].values.tolist()
    assert sorted(got) == [[1, 7, -8], [3, 4, 3], [5, 8, 11]] and not held.rows


def test_one_call_has_all_keys_of_a_bucket():
    machine, held, got = processors.FirstSeenProcessor(["work_id", "seq"]), Held(), []
    machine.init(held)
    for part in ([(1, 5, "k"), (2, 3, "k"), (3, 4, "l")], [(4, 1, "k"), (5, 9, "m"), (6, 8, "m")]):
        frames = iter([pd.DataFrame([(*r, 0) for r in part], columns=["work_id", "seq", "_2", "_3"])])
        got += [i for out in machine.handleInputRows((0,), frames, None) for i in out["work_id"]]
    assert sorted(got) == [2, 3, 6]


def test_a_job_without_dead_letters_hands_back_no_frame():
    pdf = pd.DataFrame([(1, 1, "retry", "x", 1, 1.0, None)], columns=["t", "event_id", "kind", "phase", "size", "ms", "error"])
    machine = processors.DeadLetterQueueProcessor(2, 10)
    machine.handle = machine.state = SimpleNamespace(exists=lambda: False, clear=lambda: None)
    assert list(machine.handleInputRows(("a",), iter([pdf]), None)) == []
