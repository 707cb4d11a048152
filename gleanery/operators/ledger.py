"""Change management: state transitions, corrections, snapshots, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..session import cut_lineage
from .windows import first_per_key, one_per_key


def step_allowed(old: Column, new: Column) -> Column:
    """Same state, a new row, or the next state."""
    step = F.array(*[F.lit(f"{a}>{b}") for a, b in L.LEDGER_STEPS])
    return old.isNull() | (old == new) | F.array_contains(step, F.concat(old, F.lit(">"), new))


#: Updates of a key that are folded at a time.
FOLD = 256


def _step(states: list[str]) -> Column:
    """Flat table [state now, state wanted] -> state then, or -1 where the step is refused.

    0 is a row that does not exist, len(states) + 1 any state not in `states`; as a wish, 0 keeps the state.
    """
    n = len(states) + 2
    allowed = {(states.index(a) + 1, states.index(b) + 1) for a, b in L.LEDGER_STEPS}
    then = lambda now, want: (
        (now or -1) if want == 0 else -1 if want == n - 1 else want if now in (0, want) or (now, want) in allowed else -1
    )
    return F.array(*[F.lit(then(now, want)) for now in range(n) for want in range(n)])


def _code(state: Column, states: list[str]) -> Column:
    known = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i + 1))])
    return F.when(state.isNull(), 0).otherwise(F.coalesce(known[state], F.lit(len(states) + 1)))


def fold_updates(ledger: DataFrame, updates: DataFrame, key: str = "uuid", order: list[str] | None = None) -> DataFrame:
    """`updates` with `applied` and `state_before`, each judged on the state that the earlier ones of its key left.

    The updates of a key are cut, in `order`, into runs of FOLD. A run is first reduced to its effect on
    every state, those effects are chained per key, and then every run is judged from
    the state it begins with; so a key with most of the updates is spread over many tasks.
    """
    states = sorted({x for step in L.LEDGER_STEPS for x in step})
    n, table = len(states) + 2, _step(states)
    order = order or sorted(c for c in updates.columns if c != key)
    sort = [F.col(c).asc_nulls_first() for c in order]
    named = updates.filter(F.col(key).isNotNull()).withColumn("_row", F.struct(*updates.columns)).withColumn("_want", _code(F.col("state"), states))
    ranged = cut_lineage(named.repartitionByRange(F.col(key), *sort).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(key, "_part").orderBy(*sort)
    numbered = ranged.withColumn("_no", F.row_number().over(local)).withColumn("_run", ((F.col("_no") - 1) / FOLD).cast("int"))
    runs = numbered.groupBy(key, "_part", "_run").agg(F.sort_array(F.collect_list(F.struct("_no", "_want", "_row"))).alias("_updates"))
    runs = cut_lineage(runs)
    then = lambda now, want: F.element_at(table, now * n + want + 1)
    move = lambda now, u: F.when(then(now, u["_want"]) >= 0, then(now, u["_want"])).otherwise(now)
    effect = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda start: F.aggregate("_updates", start, move))
    chained = runs.select(key, "_part", "_run", effect.alias("_effect")).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_part", "_run", "_effect"))).alias("_chain")
    )
    begin = ledger.filter(F.col(key).isNotNull()).select(key, _code(F.col("state"), states).alias("_now"))
    walked = chained.join(begin, key, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    first = F.struct(F.col("_now").alias("now"), F.array().cast("array<int>").alias("starts"))
    walk = F.aggregate("_chain", first, lambda w, r: F.struct(F.element_at(r["_effect"], w["now"] + 1).alias("now"), F.concat(w["starts"], F.array(w["now"])).alias("starts")))
    starts = walked.select(key, F.explode(F.arrays_zip(F.col("_chain"), walk["starts"].alias("start"))).alias("z"))
    starts = starts.select(key, F.col("z._chain._part").alias("_part"), F.col("z._chain._run").alias("_run"), F.col("z.start").alias("_start"))
    zero = F.struct(F.col("_start").alias("now"), F.array().cast("array<struct<before:int,applied:boolean>>").alias("seen"))
    judge = F.aggregate("_updates", zero, lambda w, u: F.struct(
        move(w["now"], u).alias("now"), F.concat(w["seen"], F.array(F.struct(w["now"].alias("before"), (then(w["now"], u["_want"]) >= 0).alias("applied")))).alias("seen"),
    ))
    judged = runs.join(starts, [key, "_part", "_run"]).select(F.explode(F.arrays_zip(F.col("_updates"), judge["seen"].alias("seen"))).alias("z"))
    names = F.array(F.lit(None).cast("string"), *[F.lit(s) for s in states], F.lit(None).cast("string"))
    return judged.select("z._updates._row.*", F.element_at(names, F.col("z.seen.before") + 1).alias("state_before"), F.col("z.seen.applied").alias("applied"))


def upsert_state(ledger: DataFrame, updates: DataFrame, key: str = "uuid", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new ledger, rejected updates). A null in an update leaves the field as it is.

    Updates of one key are applied one after the other in `order` (by default that of their
    values); each that would be an illegal step is refused and reported, and the next one
    is judged on the state left. Of a field, the last applied value stays. A key the ledger has
    several times is updated in all its rows, from the least of their states. Updates without a key are left out.
    """
    fields = [c for c in ledger.columns if c not in (key, "state") and c in updates.columns]
    held = one_per_key(ledger.select(key, "state"), key)
    judged = cut_lineage(fold_updates(held, updates, key, order))
    order = order or sorted(c for c in updates.columns if c != key)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order]))).alias(f"_{c}")
    applied = judged.filter("applied").groupBy(key).agg(*[last(c) for c in ["state", *fields]])
    joined = ledger.join(applied, key, "full_outer")
    take = lambda c: F.coalesce(f"_{c}", c).alias(c)
    merged = joined.select(key, take("state"), *[take(c) if c in fields else F.col(c) for c in ledger.columns if c not in (key, "state")])
    rejected = judged.filter("NOT applied").select(key, F.col("state_before").alias("current_state"), F.col("state").alias("wanted_state"))
    return merged, rejected


def override_lock(df: DataFrame, now: str, days: int = 180, col: str = "last_modified") -> DataFrame:
    """Lock rows edited by hand within the period; what cannot be read is not locked."""
    at = F.try_to_timestamp(F.col(col).cast("string"))
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return df.withColumn("locked", F.coalesce(at > since, F.lit(False)))


def apply_corrections(ledger: DataFrame, snapshots: DataFrame, dry_run: bool = False, key: str = "uuid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new ledger, audit rows, rows without a snapshot).

    Approved rows take the fields of their JSON payload. The run is refused as a whole,
    every row left as it is, while any approved row has no snapshot; callers write
    nothing when the third table has rows.
    """
    approved = (F.col("state") == "APPROVED") & F.col("correction_json").isNotNull()
    missing = ledger.filter(approved).join(snapshots.select(key), key, "left_anti").select(key)
    blocked = missing.agg(F.count("*") > 0).scalar() if not dry_run else F.lit(False)
    payload = F.from_json("correction_json", "map<string,string>")
    act = approved & ~blocked
    marked = ledger.withColumn("_act", act).withColumn("_p", payload)
    go = F.col("_act") & F.lit(not dry_run)
    new = (
        marked.withColumn("title_lib", F.when(go, F.coalesce(F.col("_p")["title"], F.col("title_lib"))).otherwise(F.col("title_lib")))
        .withColumn("year_lib", F.when(go, F.coalesce(F.col("_p")["year"].try_cast("int"), F.col("year_lib"))).otherwise(F.col("year_lib")))
        .withColumn("authors_lib", F.when(go, F.coalesce(F.col("_p")["authors"], F.col("authors_lib"))).otherwise(F.col("authors_lib")))
        .withColumn("state", F.when(go, "PATCHED").otherwise(F.col("state")))
        .drop("_act", "_p")
    )
    audit = marked.filter("_act").select(
        key, F.lit("PATCH_DRY_RUN" if dry_run else "PATCH").alias("action"), F.col("correction_json").alias("request_body")
    )
    return new, audit, missing


def snapshot(df: DataFrame, path: str, version: str) -> str:
    """Write an immutable copy; an existing version is an error, not an overwrite."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def rollback(df: DataFrame, snap: DataFrame, done: DataFrame | None = None, key: str = "uuid") -> DataFrame:
    """Restore non-empty title, year and authors; ids in `done` are left alone."""
    restore = snap.select(key, F.col("title_lib").alias("_t"), F.col("year_lib").alias("_y"), F.col("authors_lib").alias("_a"))
    if done is not None:
        restore = restore.join(done.select(key).distinct(), key, "left_anti")
    return (
        df.join(restore, key, "left")
        .withColumn("title_lib", F.coalesce(F.nullif("_t", F.lit("")), "title_lib"))
        .withColumn("year_lib", F.coalesce(F.nullif("_y", F.lit(0)), "year_lib"))
        .withColumn("authors_lib", F.coalesce(F.nullif("_a", F.lit("")), "authors_lib"))
        .drop("_t", "_y", "_a")
    )


def verify_applied(df: DataFrame, payloads: DataFrame, key: str = "uuid") -> DataFrame:
    """Does every corrected field equal the value read back, after trimming?"""
    expected = payloads.select(key, F.from_json("correction_json", "map<string,string>").alias("_p"))
    actual = F.create_map(
        F.lit("title"), F.trim("title_lib"), F.lit("year"), F.col("year_lib").cast("string"), F.lit("authors"), F.trim("authors_lib")
    )
    joined = df.join(expected, key).withColumn("_now", actual)
    same = F.forall(F.map_entries("_p"), lambda e: F.coalesce(F.trim(e["value"]) == F.col("_now")[e["key"]], F.lit(False)))
    return joined.select(key, same.alias("verified"))


def resume(work: DataFrame, outcomes: DataFrame, key: str = "uuid") -> DataFrame:
    """Work that has no success yet; outcomes: key, ok, at (append-only)."""
    last = outcomes.groupBy(key).agg(F.max_by("ok", "at").alias("ok"))
    return work.join(last.filter("ok").select(key), key, "left_anti")


def outcome_lists(outcomes: DataFrame, key: str = "uuid") -> DataFrame:
    return outcomes.groupBy(key).agg(F.when(F.max_by("ok", "at"), "completed").otherwise("failed").alias("outcome"))


def cached_lookup(keys: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with the latest payload, keys still to fetch)."""
    latest = cache.groupBy(key).agg(F.max_by("payload", "cached_at").alias("payload"))
    joined = keys.join(latest.withColumn("_hit", F.lit(True)), key, "left")
    return joined.filter("_hit").drop("_hit"), joined.filter("_hit IS NULL").drop("_hit", "payload")


def screen(df: DataFrame, decisions: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Append log of screening decisions with the physical records they count for.

    decisions: paper_id, action (exclude | promote), reason, phase. `records` is the
    long table of `joins.source_records`; without it each decision counts one record.
    """
    log = df.join(decisions, "paper_id")
    if records is None:
        counted = log.withColumn("n_source_records", F.lit(1).cast("long"))
    else:
        per_paper = records.groupBy("paper_id").agg(F.count("*").alias("n_source_records"))
        counted = log.join(per_paper, "paper_id", "left").withColumn("n_source_records", F.coalesce("n_source_records", F.lit(1)))
    return counted.withColumn("phase", F.when(F.col("action") == "promote", "ta").otherwise(F.col("phase"))).withColumn(
        "reason", F.when(F.col("action") == "exclude", F.col("reason"))
    )


def screen_dual(df: DataFrame, a: str = "reviewer_a", b: str = "reviewer_b", third: str = "third") -> DataFrame:
    """Agreed decision, else the third reviewer's, else CONFLICT; uncertain ones go to full text."""
    decision = F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.coalesce(F.col(third), F.lit("CONFLICT")))
    return df.withColumn("decision", decision).withColumn("to_full_text", F.col("decision").isin("INCLUDE", "UNCERTAIN"))


def hash_sample(id_: Column, share: float) -> Column:
    """The same rows on every run: the first 32 bits of md5 as a fraction."""
    first = F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("double")
    return first / F.lit(4294967296.0) < share


def spot_check(first: DataFrame, second: DataFrame, fields: list[str], share: float = 0.30, key: str = "paper_id") -> DataFrame:
    """Per field: charted twice, and differing values, on a fixed sample."""
    picked = first.filter(hash_sample(F.col(key), share))
    pairs = lambda df, out: df.select(
        key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(out)) for f in fields]))
    )
    joined = pairs(picked, "_a").join(pairs(second, "_b"), [key, "field"])
    return joined.groupBy("field").agg(
        F.count("*").alias("charted"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("discrepancies")
    )


def eventual_expiry(df: DataFrame, now: str, ttl_seconds: int, col: str = "ts") -> DataFrame:
    """Rows not older than their time to live."""
    return df.filter(F.col(col) >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def review_queue(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("manually_modified"), F.desc("needs_correction"), "title_lib", "uuid")


def triage_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, verified): pending has no trial id or no verified one."""
    done = F.col("trial_id").isNotNull() & F.coalesce(F.col("trial_verified"), F.lit(False))
    return df.filter(~done), df.filter(done)


