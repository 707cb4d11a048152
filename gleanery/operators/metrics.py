"""Aggregates: tiers, gaps, funnels, agreement, quality checks, latency, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scores
from .windows import nearest_rank


def tier_distribution(df: DataFrame, tier: str = "peer_tier") -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n"))


def evidence_quality(df: DataFrame, tier: str = "peer_tier") -> DataFrame:
    """Mean tier weight, at most 1; 0 for no rows."""
    weight = scores.lookup(L.TIER_QUALITY, F.col(tier), 0.1)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.least(F.lit(1.0), F.sum(weight) / F.count("*")), F.lit(0.0)).alias("quality"))


def research_gaps(df: DataFrame, region: str | None = None, tier: str = "peer_tier", country: str = "country") -> DataFrame:
    """Gap rules over one aggregated row."""
    weight = scores.lookup(L.TIER_QUALITY, F.col(tier), 0.1)
    in_region = F.upper(F.coalesce(country, F.lit(""))) == (region or "").upper()
    facts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(tier) == t).alias(f"t{t}") for t in range(1, 7)],
        F.coalesce(F.least(F.lit(1.0), F.sum(weight) / F.count("*")), F.lit(0.0)).alias("quality"),
        F.count_if(in_region).alias("regional"),
    )
    c = F.col

    def gap(when: Column, kind: str, severity: str, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("gap"), F.lit(severity).alias("severity"), evidence.alias("present")))

    rules = [
        gap(
            (c("t3") == 0) & (c("t4") + c("t5") > 5), "no_rcts", "critical",
            F.format_string("%d observational studies, %d case series", "t4", "t5"),
        ),
        gap(
            (c("t1") + c("t2") == 0) & (c("n") > 10), "no_systematic_reviews", "warning",
            F.format_string("%d individual studies", "n"),
        ),
        gap(
            (c("quality") < 0.3) & (c("n") > 0), "low_evidence", "warning",
            F.format_string("%d case series or unclassified", c("t5") + c("t6")),
        ),
    ]
    if region and region not in ("US", "UK"):
        rules.append(
            gap((c("regional") == 0) & (c("n") > 5), "regional_gap", "warning", F.format_string("%d international studies", "n"))
        )
    return facts.select(F.inline(F.array_compact(F.array(*rules))))


def prisma_funnel(works: DataFrame, exclusions: DataFrame, promoted: DataFrame, n_duplicates: DataFrame, flags: DataFrame) -> DataFrame:
    """(stage, key, n) rows. exclusions: phase, reason, n_source_records. n_duplicates: one column `n`."""
    row = lambda df, stage, n, key=F.lit(""): df.select(F.lit(stage).alias("stage"), key.alias("key"), n.cast("long").alias("n"))
    by_source = row(works.groupBy("source").agg(F.count("*").alias("c")), "identified", F.col("c"), F.col("source"))
    reasons = row(exclusions.groupBy("reason").agg(F.count("*").alias("c")), "reason", F.col("c"), F.col("reason"))
    records = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("n_source_records"))), F.lit(0))
    out = exclusions.agg(
        records("ta").alias("ta"), records("fulltext").alias("ft"), F.count_if(F.col("phase") == "fulltext").alias("ft_rows")
    )
    n_promoted = promoted.agg(F.count("*").alias("promoted"))
    phases = out.withColumn("promoted", n_promoted.scalar())
    named = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), F.lit("").alias("key"), value.cast("long").alias("n"))
            for stage, value in [
                ("excluded_ta", F.col("ta")),
                ("promoted", F.col("promoted")),
                ("excluded_fulltext", F.col("ft")),
                ("included", F.greatest(F.lit(0), F.col("promoted") - F.col("ft_rows"))),
            ]
        ]
    )
    return (
        by_source.unionByName(row(n_duplicates, "duplicates_removed", F.col("n")))
        .unionByName(row(flags.agg(F.count("*").alias("c")), "shadow_records", F.col("c")))
        .unionByName(row(works.agg(F.count("*").alias("c")), "screened", F.col("c")))
        .unionByName(phases.select(F.inline(named)))
        .unionByName(reasons)
    )


def cardinality_plan(df: DataFrame, specs: dict[str, object], limit: int = L.SUPERSET_LIMIT, cols: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Count every spec's OR superset in one scan and choose how to fetch it."""
    from .filters import boolean_column, leaf_terms, searchable, superset_filter

    hay = df.select(searchable(*[F.col(c) for c in cols]).alias("_hay"))
    counts = hay.agg(*[F.count_if(boolean_column(superset_filter(s), F.col("_hay"))).alias(n) for n, s in specs.items()])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("spec"), F.col(n).alias("estimated"), F.lit(len(leaf_terms(s))).alias("n_terms"))
            for n, s in specs.items()
        ]
    )
    return counts.select(F.inline(rows)).withColumn(
        "strategy",
        F.when(F.col("estimated") <= limit, "direct").when(F.col("n_terms") >= 2, "doi_intersection").otherwise("user_alert"),
    )


def verification_summary(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers with a trial id: regional registry, other registry, none."""
    per_paper = ids.groupBy("work_id").agg(F.bool_or(scores.is_regional_registry(F.col("registry"))).alias("regional"))
    joined = papers.select("work_id").join(per_paper, "work_id", "left")
    return joined.agg(
        F.count("*").alias("papers"),
        F.count("regional").alias("with_trial_ids"),
        F.count_if(F.col("regional")).alias("regional"),
        F.count_if(~F.col("regional")).alias("verified"),
        F.count_if(F.col("regional").isNull()).alias("unverified"),
    )


def ledger_stats(df: DataFrame) -> DataFrame:
    """Rows per state, zero-filled, with corrections and approvals per state."""
    states = df.sparkSession.createDataFrame([(s,) for s in L.LEDGER_STATES], "state string")
    counts = df.groupBy("state").agg(
        F.count("*").alias("n"), F.count_if("needs_correction").alias("needs_correction"), F.count_if("approved").alias("approved")
    )
    return states.join(counts, "state", "left").na.fill(0)


def feedback_stats(df: DataFrame, pages: int = 20, issues: int = 5) -> DataFrame:
    """(section, key, n, sample): totals, ratings, categories, top pages, top issues with a sample."""
    sec = lambda frame, name, key, sample=F.lit(None).cast("string"): frame.select(
        F.lit(name).alias("section"), key.cast("string").alias("key"), F.col("n"), sample.alias("sample")
    )
    count = F.count("*").alias("n")
    by_category = df.groupBy("category").agg(
        count, F.min_by(F.substring("description", 1, 120), F.when(F.coalesce("description", F.lit("")) != "", F.col("seq"))).alias("sample")
    )
    # pages are counted before they are ordered; ties go to the smaller page
    per_page = df.select(F.explode("page_numbers").alias("page")).groupBy("page").agg(count)
    top_pages = per_page.orderBy(F.desc("n"), "page").limit(pages)
    top_issues = by_category.orderBy(F.desc("n"), "category").limit(issues)
    return (
        sec(df.agg(count), "total", F.lit(""))
        .unionByName(sec(df.groupBy("rating").agg(count), "rating", F.col("rating")))
        .unionByName(sec(by_category, "category", F.col("category")))
        .unionByName(sec(top_pages, "page", F.col("page")))
        .unionByName(sec(top_issues, "issue", F.col("category"), F.col("sample")))
    )


def latency_summary(df: DataFrame, keys: list[str], value: str, band: float = 1.0) -> DataFrame:
    """n, mean, max and the exact values at index n/2 and 0.95 n of the sorted group."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return base.join(nearest_rank(df, keys, value, {"p50": 0.5, "p95": 0.95}, band), keys)


def trace_summary(spans: DataFrame, trace: str = "trace_id") -> DataFrame:
    duration = F.col("end_ms") - F.col("start_ms")
    return spans.groupBy(trace).agg(
        (F.max("end_ms") - F.min("start_ms")).alias("total_ms"),
        F.count("*").alias("spans"),
        F.min(duration).alias("fastest_ms"),
        F.max(duration).alias("slowest_ms"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def pass_rate(df: DataFrame, passed: Column, threshold: float = 99.7, keys: tuple[str, ...] = ()) -> DataFrame:
    rate = F.round(F.count_if(passed) * 100.0 / F.count("*"), 4)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), rate.alias("rate")).withColumn("gate", F.col("rate") >= threshold)


def summary_rollup(events: DataFrame) -> DataFrame:
    """Per kind and name: entries and distinct pages, pushes and the largest push.

    events: kind (fallback | font | collision), name, page, pushes, max_push. Pages are
    counted through a (name, page) aggregate, not gathered into one list.
    """
    per_page = events.groupBy("kind", "name", "page").agg(
        F.count("*").alias("entries"), F.sum("pushes").alias("pushes"), F.max("max_push").alias("max_push")
    )
    return per_page.groupBy("kind", "name").agg(
        F.sum("entries").alias("entries"),
        F.count("*").alias("pages"),
        F.coalesce(F.sum("pushes"), F.lit(0)).alias("pushes"),
        F.coalesce(F.max("max_push"), F.lit(0.0)).alias("max_push"),
    )


def rollup_pages(events: DataFrame) -> DataFrame:
    """The page list behind `summary_rollup`, long: one row per kind, name and page."""
    return events.select("kind", "name", "page").distinct()


def reduction_stats(pages: DataFrame) -> DataFrame:
    """Per document: raw and merged blocks, reduction in percent (one decimal)."""
    return pages.groupBy("doc_id").agg(F.sum("raw").alias("raw"), F.sum("merged").alias("merged")).withColumn(
        "reduction_pct", F.round((1 - F.col("merged") / F.greatest(F.lit(1), F.col("raw"))) * 100, 1)
    )


def reduction_total(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.sum("raw").alias("raw"), F.sum("merged").alias("merged"), F.round(F.avg("reduction_pct"), 1).alias("avg_reduction_pct")
    )


def modal_value(df: DataFrame, group: list[str], value: str, default: float = 12.0) -> DataFrame:
    """Most frequent value per group, the smaller one on ties; `default` where all are null."""
    counts = df.groupBy(*group, value).agg(F.count(value).alias("_n"))
    best = F.max_by(F.col(value), F.struct("_n", (-F.col(value)).alias("v")))
    return counts.groupBy(*group).agg(F.coalesce(best, F.lit(default)).alias("modal"))


def cohen_kappa(df: DataFrame, a: str, b: str, id_: str, sample_of: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Agreement of two raters beyond chance, on all rows or on one row in `sample_of`.

    The sample is by md5 of the id, so it is the same rows on every run. The table of
    decisions is aggregated first; what follows works on a handful of cells.
    """
    if sample_of:
        first = F.conv(F.substring(F.md5(F.col(id_).cast("string")), 1, 8), 16, 10).cast("long")
        df = df.filter(first % sample_of == 0)
    cells = df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ends = cells.select(
        *keys, F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")),
                                 F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("e")
    )
    labels = ends.groupBy(*keys, "e.label").agg(F.sum("e.na").alias("na"), F.sum("e.nb").alias("nb"))
    chance = labels.groupBy(*keys).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    joined = total.join(chance, list(keys)) if keys else total.withColumn("chance", chance.scalar())
    po = F.col("same") / F.col("n")
    pe = F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return joined.select(
        *keys, "n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa")
    )


def frequency_tables(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n) for several dimensions in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def evidence_map(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Cross-tabulation; naming the column values spares a pass over the data."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def gap_matrix(df: DataFrame, row: str, col: str, col_values: list, thin: int, counted: Column | None = None) -> DataFrame:
    """Cells of the evidence map with fewer than `thin` studies, zero cells included."""
    base = df.filter(counted) if counted is not None else df
    counts = base.groupBy(row, col).agg(F.count("*").alias("n"))
    grid = df.select(row).distinct().select(row, F.explode(F.array(*[F.lit(v) for v in col_values])).alias(col))
    cells = grid.join(counts, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0)).alias("n"))
    return cells.filter(F.col("n") < thin).withColumn("gap", F.when(F.col("n") == 0, "none").otherwise("thin"))


def qc_checks(raw: DataFrame, processed: DataFrame, manifest: DataFrame, required: list[str]) -> DataFrame:
    """(check, value, passed). manifest: source, n_records, content_hash."""
    n_raw = raw.agg(F.count("*").alias("n_raw"))
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    done = processed.agg(
        F.count("*").alias("n_done"),
        (F.count_if(full) / F.count("*")).alias("complete"),
        (F.count_if(F.coalesce("source", F.lit("")) != "") / F.count("*")).alias("tagged"),
    )
    from .textops import multiset_hash

    per_source = raw.groupBy("source").agg(F.count("*").alias("n"), multiset_hash(F.col("record_hash")).alias("h"))
    batches = manifest.join(per_source, "source", "full_outer").agg(
        F.count_if(F.coalesce(F.col("n") == F.col("n_records"), F.lit(False))).alias("counted"),
        F.count_if(F.coalesce(F.col("h") == F.col("content_hash"), F.lit(False))).alias("hashed"),
        F.count("n_records").alias("listed"),
        F.count_if(F.col("n").isNotNull() & F.col("n_records").isNotNull()).alias("present"),
        F.count("*").alias("seen"),
    )
    as_row = lambda frame: frame.select(F.struct(*frame.columns)).scalar()
    one = n_raw.withColumn("d", as_row(done)).withColumn("b", as_row(batches)).select("n_raw", "d.*", "b.*")
    c = F.col
    share = lambda a, b: F.round(c(a) / c(b), 6)
    checks = [
        ("record_count", share("counted", "seen"), c("counted") == c("seen")),
        ("hash_match", share("hashed", "seen"), c("hashed") == c("seen")),
        ("all_records_parsed", share("n_done", "n_raw"), c("n_done") == c("n_raw")),
        ("metadata_complete", F.round("complete", 6), c("complete") > 0.95),
        ("provenance_tagged", F.round("tagged", 6), c("tagged") == 1.0),
        ("batches_present", share("present", "listed"), c("present") == c("listed")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), ok.alias("passed")) for n, v, ok in checks])
    return one.select(F.inline(rows))


def batch_total(manifests: DataFrame) -> DataFrame:
    """Per search: exported total against the displayed count, and batches that hit the cap."""
    return manifests.groupBy("search_id").agg(
        F.count("*").alias("batches"),
        F.sum("exported").alias("exported"),
        F.max("displayed").alias("displayed"),
        F.count_if(F.col("exported") >= F.col("export_cap")).alias("capped_batches"),
    ).withColumn("complete", F.col("exported") == F.col("displayed"))
