"""Entity resolution: exact, fuzzy, hierarchical; all in rounds of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import text
from ..session import cut_lineage
from .components import connected_components
from .title_join import EditDistance, JaroWinkler, title_pairs
from .windows import first_per_key


def dedup_exact(df: DataFrame, doi: str = "doi", title: str = "title", year: str = "year", author: str = "first_author", seq: str = "seq") -> DataFrame:
    """First row per DOI, then first row per title/year/surname hash among those.

    A title without a letter or digit is no title: such rows are all kept.
    """
    keyed = df.withColumn("_doi", F.nullif(text.norm_doi(F.col(doi)), F.lit(""))).withColumn(
        "_hash", F.when(text.norm_title(F.col(title)) != "", text.dedup_hash(F.col(title), F.col(year), F.col(author)))
    )
    by_doi = first_per_key(keyed, ["_doi"], [seq])
    return first_per_key(by_doi, ["_hash"], [seq]).drop("_doi", "_hash")


# --- Candidate generation -----------------------------------------------------------

BANDS, ROWS_PER_BAND = 16, 3


def title_shingles(norm: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter title is its own shingle."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(norm) - n))
    # letters are reached by place; `substring` walks a long title from its beginning each time
    cut = lambda letters: F.transform(starts, lambda i: F.concat_ws("", *[F.get(letters, i + k) for k in range(n)]))
    grams = F.get(F.transform(F.array(F.split(norm, "")), cut), F.lit(0))
    return F.array_distinct(F.when(norm.isNull(), F.array(F.lit(None).cast("string"))).otherwise(grams))


def block_keys(df: DataFrame, norm: str = "norm", bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """One row per (record, block): MinHash bands over title trigrams, for callers that want likely pairs only.

    `similar_pairs` and `title_lev_pairs` are complete and do not use them. Titles that share most trigrams meet in some band with a chance of
    1 - (1 - J^rows)^bands for trigram overlap J; unrelated titles do not meet.
    """
    shingles = title_shingles(F.col(norm))
    base = F.transform(shingles, lambda s: F.xxhash64(s))

    def signature(seed: int) -> Column:
        return F.array_min(F.transform(F.col("_base"), lambda h: F.xxhash64(h, F.lit(seed))))

    keys = F.array(*[F.xxhash64(F.lit(b), *[signature(b * rows + r) for r in range(rows)]) for b in range(bands)])
    return df.withColumn("_base", base).withColumn("block", F.explode(F.array_distinct(keys))).drop("_base")


def _prepared(df: DataFrame) -> DataFrame:
    """id, seq, year, normalised title, surname, title entities."""
    return df.select(
        F.col("work_id").alias("id"),
        "seq",
        "year",
        "source",
        text.norm_title(F.col("title")).alias("norm"),
        text.surname(F.col("first_author")).alias("author"),
        text.entities(F.col("title")).alias("ent"),
    )


def _earlier(a: str, b: str) -> Column:
    return F.col(f"{a}.seq") < F.col(f"{b}.seq")


def _first_titles(df: DataFrame) -> DataFrame:
    """The first work of each title and year; works without a title are all kept."""
    return first_per_key(_prepared(df), [F.nullif("norm", F.lit("")), "year"], ["seq"])


def _described(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Scored id pairs with what a verdict needs of their two works. Only works that have a pair are joined."""
    side = lambda n: rows.select(F.col("id").alias(f"{n}_id"), F.struct("seq", "year", "author", "ent").alias(n))
    a, b = F.col("left"), F.col("right")
    return pairs.join(side("left"), "left_id").join(side("right"), "right_id").select(
        "left_id", "right_id", a["seq"].alias("left_seq"), b["seq"].alias("right_seq"),
        (a["year"] == b["year"]).alias("year_match"),
        ((a["author"] != "") & (a["author"] == b["author"])).alias("author_match"),
        text.entity_conflict(a["ent"], b["ent"]).alias("conflict"), "similarity",
    )


def similar_pairs(df: DataFrame, floor: float = L.GREY_SIMILARITY) -> DataFrame:
    """Pairs of works (earlier, later) within one year whose titles score at least `floor`: all of them.

    Works with the same normalised title and year are represented by the first of
    them: the others score exactly the same. Entities are only compared for pairs that score,
    and equal titles of neighbouring years meet by equi-join.
    """
    rows = cut_lineage(_first_titles(df))
    near = _described(title_pairs(rows, JaroWinkler(floor)), rows)
    titled = rows.filter("norm <> ''")
    a = titled.select("norm", F.col("year").alias("_year"), F.struct(rows.columns).alias("a"))
    b = titled.select("norm", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("_year"), F.struct(rows.columns).alias("b"))
    same = a.join(b, ["norm", "_year"]).filter(_earlier("a", "b"))
    equal = same.select(
        F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.seq").alias("left_seq"), F.col("b.seq").alias("right_seq"),
        (F.col("a.year") == F.col("b.year")).alias("year_match"),
        ((F.col("a.author") != "") & (F.col("a.author") == F.col("b.author"))).alias("author_match"),
        F.lit(False).alias("conflict"),
        F.lit(1.0).alias("similarity"),
    )
    return near.unionByName(equal)


def title_duplicates(pairs: DataFrame, threshold: float = L.MERGE_SIMILARITY) -> DataFrame:
    """Pairs that are the same title: close enough and no conflicting entities."""
    return pairs.filter((F.col("similarity") >= threshold) & ~F.col("conflict"))


def greedy_keep(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids dropped by "first wins": a row falls iff an earlier *kept* row is its neighbour.

    Each round keeps the undecided rows without an undecided earlier neighbour and
    drops the later neighbours of the kept ones. The result equals the sequential
    loop. `nodes(id)` is only used for its schema of ids that have edges.
    """
    live = cut_lineage(edges.select("left_id", "right_id"))
    dropped_all = None
    while not live.isEmpty():
        waiting = live.select(F.col("right_id").alias("left_id")).distinct()
        kept = live.select("left_id").distinct().join(waiting, "left_id", "left_anti")
        dropped = cut_lineage(live.join(kept, "left_id", "left_semi").select("right_id").distinct())
        dropped_all = dropped if dropped_all is None else cut_lineage(dropped_all.unionByName(dropped))
        gone_right = live.join(dropped, "right_id", "left_anti")
        gone_left = gone_right.join(dropped.select(F.col("right_id").alias("left_id")), "left_id", "left_anti")
        live = cut_lineage(gone_left)
    ids = nodes.select("id").limit(0) if dropped_all is None else dropped_all.select(F.col("right_id").alias("id"))
    return ids


def dedup_fuzzy(df: DataFrame, pairs: DataFrame | None = None, threshold: float = L.MERGE_SIMILARITY) -> DataFrame:
    """Drop every work whose title duplicates an earlier kept work within one year."""
    rows = _prepared(df)
    pairs = similar_pairs(df, threshold) if pairs is None else pairs
    dropped = greedy_keep(title_duplicates(pairs, threshold), rows)
    first = _first_titles(df)
    kept = first.select("id").join(dropped, "id", "left_anti")
    return df.join(kept.withColumnRenamed("id", "work_id"), "work_id", "left_semi")


def shadow_pairs(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Possible duplicates for a human: grey-zone similarity and a second signal.

    The earlier row is a kept one and comes before the later row's first duplicate,
    as in a scan that stops at the first hit; `later_dropped` marks later rows that
    the fuzzy pass removes.
    """
    pairs = cut_lineage(similar_pairs(df) if pairs is None else pairs)
    duplicates = title_duplicates(pairs)
    rows = _prepared(df)
    dropped = greedy_keep(duplicates, rows)
    kept_left = duplicates.join(dropped.withColumnRenamed("id", "left_id"), "left_id", "left_anti")
    first_hit = kept_left.groupBy("right_id").agg(F.min("left_seq").alias("_hit"))
    grey = pairs.filter(
        (F.col("similarity") >= L.GREY_SIMILARITY)
        & (F.col("similarity") < L.MERGE_SIMILARITY)
        & (F.col("year_match") | F.col("author_match"))
    )
    gone = dropped.withColumn("later_dropped", F.lit(True)).withColumnRenamed("id", "right_id")
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("title_similarity_"), F.format_number("similarity", 3)),
            F.when(F.col("year_match"), "year_match"),
            F.when(F.col("author_match"), "author_match"),
        )
    )
    return (
        grey.join(dropped.withColumnRenamed("id", "left_id"), "left_id", "left_anti")
        .join(first_hit, "right_id", "left")
        .filter("_hit IS NULL OR left_seq < _hit")
        .join(gone, "right_id", "left")
        .select("left_id", "right_id", "similarity", reasons.alias("reasons"), F.coalesce("later_dropped", F.lit(False)).alias("later_dropped"))
    )


def dedup_stats(before: DataFrame, after_exact: DataFrame, after_fuzzy: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row of totals; each input is only counted."""
    parts = [("total_before", before), ("total_exact", after_exact), ("total_after", after_fuzzy), ("quarantined", quarantined)]
    counts = None
    for name, frame in parts:
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        counts = one if counts is None else counts.unionByName(one)
    wide = counts.agg(*[F.max(F.when(F.col("k") == name, F.col("n"))).alias(name) for name, _ in parts])
    return wide.withColumn("fuzzy_removed", F.col("total_exact") - F.col("total_after")).withColumn(
        "duplicates_removed", F.col("total_before") - F.col("total_after")
    )


def dedup_hierarchical(df: DataFrame, levels: list[tuple[str, Column]], fuzzy: DataFrame | None = None, id_: str = "work_id", seq: str = "seq") -> DataFrame:
    """Duplicate groups over ordered key levels; every row stays, flagged.

    levels: (name, key column), strongest first; a null key matches nothing.
    `fuzzy(left_id, right_id)` pairs do not merge: they only mark rows for review.
    """
    keyed = df.select(F.col(id_).alias("id"), *[c.alias(f"_k{n}") for n, (_, c) in enumerate(levels)])
    stacked = keyed.select(
        "id",
        F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"_k{n}").alias("key")) for n in range(len(levels))])).alias("e"),
    ).select("id", "e.level", "e.key").filter("key IS NOT NULL")
    # link each row to the smallest id of its key: a star, linear in the rows
    least = stacked.groupBy("level", "key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    linked = stacked.join(least, ["level", "key"]).select("id", "level", "least")
    linked = cut_lineage(linked)
    edges = linked.filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    groups = connected_components(edges)
    matched = linked.groupBy("id").agg(F.min("level").alias("_level"))
    names = F.element_at(F.array(*[F.lit(n) for n, _ in levels]), F.col("_level") + 1)
    joined = (
        df.join(groups.select(F.col("node").alias(id_), F.col("component").alias("_group")), id_, "left")
        .join(matched.select(F.col("id").alias(id_), names.alias("matched_level")), id_, "left")
        .withColumn("group_id", F.coalesce("_group", id_))
    )
    # the canonical row is the earliest of its group: an aggregate, not a window over a hot group
    canonical = joined.groupBy("group_id").agg(F.min_by(id_, seq).alias("canonical_id"), F.count("*").alias("group_size"))
    out = joined.drop("_group").join(canonical, "group_id").withColumn("is_canonical", F.col(id_) == F.col("canonical_id"))
    out = out.withColumn("is_duplicate", ~F.col("is_canonical"))
    if fuzzy is not None:
        ids = fuzzy.select(F.col("left_id").alias(id_)).unionByName(fuzzy.select(F.col("right_id").alias(id_))).distinct()
        out = out.join(ids.withColumn("needs_review", F.lit(True)), id_, "left").withColumn(
            "needs_review", F.coalesce("needs_review", F.lit(False))
        )
    return out


def title_lev_pairs(df: DataFrame, floor: float = L.HIERARCHY_SIMILARITY, cover: bool = False) -> DataFrame:
    """Level 5 of the hierarchy: works within one year whose normalised titles are > `floor` alike by edit distance.

    Of equal titles of a year only the first is looked at; equal ones of neighbouring years are pairs.
    With `cover` some pairs are left out, but no work that has one: enough to mark works for review.
    """
    rows = cut_lineage(_first_titles(df))
    near = title_pairs(rows, EditDistance(floor), cover=cover).select("left_id", "right_id")
    titled = rows.filter("norm <> ''").select("norm", "year", "id", "seq")
    later = titled.select("norm", F.explode(F.array(F.col("year") - 1, F.col("year") + 1)).alias("year"), F.col("id").alias("right_id"), F.col("seq").alias("right_seq"))
    same = titled.join(later, ["norm", "year"]).filter("seq < right_seq")
    return near.unionByName(same.select(F.col("id").alias("left_id"), "right_id"))


def doi_intersection(works: DataFrame, hits: DataFrame, n_terms: int) -> DataFrame:
    """Works whose DOI is in the result set of every term. hits: term, doi."""
    every = (
        hits.select("term", F.lower("doi").alias("_doi")).filter("_doi IS NOT NULL").distinct()
        .groupBy("_doi").agg(F.count("*").alias("_terms")).filter(F.col("_terms") == n_terms)
    )
    return works.withColumn("_doi", F.lower("doi")).join(every.select("_doi"), "_doi", "left_semi").drop("_doi")


def companion_reports(df: DataFrame, dataset: str, content: str, rank: str, order: str = "seq") -> DataFrame:
    """One primary per dataset; the rest are duplicates (same content) or companions.

    `rank` orders authority, peer-reviewed first. Content repeats of an earlier report
    of the dataset are duplicates (E6), other analyses are companions (E7).
    """
    place = F.struct(F.col(rank), F.col(order))
    # a report of no known dataset is its own dataset
    own = F.concat(F.lit("own:"), F.col(order).cast("string"))
    known = df.withColumn("_set", F.coalesce(F.concat(F.lit("set:"), F.col(dataset).cast("string")), own)).withColumn(
        "_content", F.coalesce(F.col(content).cast("string"), F.lit(""))
    )
    primary = known.groupBy("_set").agg(F.min(place).alias("_primary"))
    first_of_content = known.groupBy("_set", "_content").agg(F.min(place).alias("_first"))
    out = known.join(primary, "_set").join(first_of_content, ["_set", "_content"])
    return out.withColumn(
        "report_role", F.when(place == F.col("_primary"), "primary").when(place != F.col("_first"), "duplicate").otherwise("companion")
    ).withColumn("exclusion", F.when(F.col("report_role") == "duplicate", "E6").when(F.col("report_role") == "companion", "E7")).drop(
        "_set", "_content", "_primary", "_first"
    )
