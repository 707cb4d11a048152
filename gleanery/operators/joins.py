"""Joins and lookups between works, authority records, registries and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .windows import one_per_key


def enrich_by_doi(works: DataFrame, facts: DataFrame) -> DataFrame:
    """Open-access facts by DOI; the old URL stays where the new one is null.

    Of several facts about a DOI the least counts, so works never multiply. Works without a DOI get a private key, so they do not meet in one task.
    """
    keyed = works.withColumn("_key", F.coalesce(F.lower("doi"), F.concat(F.lit("no-doi:"), F.col("work_id").cast("string"))))
    known = facts.select(
        F.lower("doi").alias("_key"),
        F.col("is_oa").alias("_is_oa"),
        F.col("oa_status").alias("_status"),
        F.col("oa_url").alias("_url"),
        F.col("license").alias("oa_license"),
        F.col("repository").alias("oa_repository"),
        F.col("version").alias("oa_version"),
    )
    joined = keyed.join(one_per_key(known, "_key"), "_key", "left")
    return (
        joined.withColumn("oa_resolved", F.col("_status").isNotNull())
        .withColumn("is_oa", F.coalesce("_is_oa", "is_oa"))
        .withColumn("oa_status", F.coalesce("_status", F.lit("unknown")))
        .withColumn("full_text_url", F.coalesce("_url", "full_text_url"))
        .drop("_key", "_is_oa", "_status", "_url")
    )


def verify_works(manifest: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """One class per row of the manifest: not_found, retracted, revised or verified.

    manifest: doi, abstract_hash, cached_abstract. crossref: doi, type, title,
    abstract. openalex: doi, type, abstract (already decoded). Of several authority
    rows of one DOI a retraction counts, else the least. Rows without a DOI get a key of their own,
    so they do not meet in one task.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    a = crossref.select(
        F.lower("doi").alias("doi"), F.lit(True).alias("in_a"), F.col("type").alias("a_type"),
        F.col("title").alias("a_title"), F.col("abstract").alias("a_abstract"),
    )
    b = openalex.select(
        F.lower("doi").alias("doi"), F.lit(True).alias("in_b"), F.col("type").alias("b_type"), F.col("abstract").alias("b_abstract")
    )
    a_gone = (
        low(F.col("a_type")).contains("retraction") | low(F.col("a_title")).contains("retraction") | low(F.col("a_title")).contains("retracted")
    )
    b_gone = low(F.col("b_type")).contains("retraction")
    a = one_per_key(a, "doi", [~a_gone]).withColumnRenamed("doi", "_doi")
    b = one_per_key(b, "doi", [~b_gone]).withColumnRenamed("doi", "_doi")
    own = F.concat(F.lit("no-doi:"), F.xxhash64(*manifest.columns).cast("string"))
    keyed = manifest.withColumn("doi", F.lower("doi")).withColumn("_doi", F.coalesce("doi", own))
    joined = keyed.join(a, "_doi", "left").join(b, "_doi", "left")
    retracted = a_gone | b_gone
    fresh = F.when(F.coalesce("a_abstract", F.lit("")) != "", text.strip_markup(F.col("a_abstract"))).otherwise(F.col("b_abstract"))
    fresh_hash = text.abstract_hash(fresh)
    revised = (
        (F.coalesce(fresh, F.lit("")) != "")
        & (F.coalesce("cached_abstract", F.lit("")) != "")
        & (fresh_hash != F.col("abstract_hash"))
        & (fresh_hash != "")
    )
    return joined.withColumn(
        "verdict",
        F.when(F.col("in_a").isNull() & F.col("in_b").isNull(), "not_found")
        .when(retracted, "retracted")
        .when(revised, "revised")
        .otherwise("verified"),
    ).select(*manifest.columns, "verdict")


# Substring joins meet on this many characters; DOI tails are the distinctive part.
KEY_LENGTH = 8


def clean_lookup(ledger: DataFrame, clean: DataFrame) -> DataFrame:
    """(uuid, cite_key) by DOI equality, else by the DOI inside a longer DOI text.

    A text that contains the DOI contains its last characters too, so the texts are
    cut into pieces of that length and met by equality; the plain substring test
    then decides. A DOI shorter than the piece is met as a whole. Equal reference
    texts are merged first, so a repeated one costs one row.
    """
    asked = ledger.select("uuid", "doi").filter("doi IS NOT NULL AND doi <> ''")
    refs = (
        clean.filter("doi IS NOT NULL AND doi <> ''").groupBy(F.col("doi").alias("ref_doi")).agg(F.min("cite_key").alias("cite_key"))
    )
    equal = asked.join(refs, F.col("doi") == F.col("ref_doi")).select("uuid", "cite_key")
    rest = asked.join(refs.select(F.col("ref_doi").alias("doi")), "doi", "left_anti")

    def pieces(sizes: Column) -> Column:
        of_size = lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("ref_doi") - n + 1)), lambda i: F.substring(F.col("ref_doi"), i, n)
        )
        return F.array_distinct(F.flatten(F.transform(sizes, of_size)))

    def contained(part: DataFrame, key: Column, sizes: Column) -> DataFrame:
        cut = refs.withColumn("_key", F.explode(pieces(sizes)))
        met = part.withColumn("_key", key).join(cut, "_key").filter(F.col("ref_doi").contains(F.col("doi")))
        return met.select("uuid", "cite_key")

    long_ = contained(rest.filter(F.length("doi") >= KEY_LENGTH), F.right("doi", F.lit(KEY_LENGTH)), F.array(F.lit(KEY_LENGTH)))
    short = contained(rest.filter(F.length("doi") < KEY_LENGTH), F.col("doi"), F.sequence(F.lit(1), F.lit(KEY_LENGTH - 1)))
    inside = long_.unionByName(short).groupBy("uuid").agg(F.min("cite_key").alias("cite_key"))
    return equal.withColumn("matched_by", F.lit("equal")).unionByName(inside.withColumn("matched_by", F.lit("contained")))


def authority_diff(ledger: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """Field-wise difference between library and authority metadata.

    ledger: uuid, title_lib, title_auth, year_lib, year_auth, authors_lib,
    authors_auth. clean (optional): uuid, title, year, authors; it beats the
    authority columns as a whole wherever it has a row.
    """
    if clean is not None:
        side = one_per_key(clean.select("uuid", "title", "year", "authors"), "uuid").select(
            "uuid", F.lit(True).alias("_clean"), F.col("title").alias("_t"), F.col("year").alias("_y"), F.col("authors").alias("_a")
        )
        ledger = ledger.join(side, "uuid", "left")
        pick = lambda mine, other: F.when(F.col("_clean"), F.col(mine)).otherwise(F.col(other))
        ledger = (
            ledger.withColumn("title_auth", pick("_t", "title_auth"))
            .withColumn("year_auth", pick("_y", "year_auth"))
            .withColumn("authors_auth", pick("_a", "authors_auth"))
            .withColumn("authority", F.when(F.col("_clean"), "clean").otherwise("crossref"))
            .drop("_clean", "_t", "_y", "_a")
        )
    else:
        ledger = ledger.withColumn("authority", F.lit("crossref"))

    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    title_off = (
        given("title_auth")
        & (text.diff_title(F.col("title_lib")) != text.diff_title(F.col("title_auth")))
        & ~text.title_equiv(F.col("title_lib"), F.col("title_auth"))
    )
    year_off = F.col("year_auth").isNotNull() & (F.col("year_auth") != 0) & ~F.col("year_lib").eqNullSafe(F.col("year_auth"))
    mine, theirs = text.author_set(F.col("authors_lib")), text.author_set(F.col("authors_auth"))
    authors_off = (F.size(theirs) > 0) & (mine != theirs)

    def correction(field: str, off: Column, current: str, proposed: str) -> Column:
        return F.when(
            off,
            F.struct(
                F.lit(field).alias("field"),
                F.col(current).cast("string").alias("current"),
                F.col(proposed).cast("string").alias("proposed"),
                F.col("authority").alias("source"),
            ),
        )

    fixes = F.array_compact(
        F.array(
            correction("title", title_off, "title_lib", "title_auth"),
            correction("year", year_off, "year_lib", "year_auth"),
            correction("authors", authors_off, "authors_lib", "authors_auth"),
        )
    )
    return (
        ledger.withColumn("corrections", fixes)
        .withColumn("needs_correction", F.size("corrections") > 0)
        .withColumn(
            "correction_json",
            F.when(
                F.col("needs_correction"),
                F.to_json(F.map_from_entries(F.transform("corrections", lambda x: F.struct(x["field"], x["proposed"])))),
            ),
        )
    )


def year_band_pairs(left: DataFrame, k: int = 1, key: list[str] | None = None, id_: str = "work_id", year: str = "year") -> DataFrame:
    """Pairs of one key whose years differ by at most k, as an equi-join on year.

    One side is copied to the 2k+1 years it may meet; each pair then meets in
    exactly one year, so nothing has to be made distinct. `key` should be
    selective: it decides how many rows can meet.
    """
    keys = list(key or [])
    a = left.select(*keys, F.col(id_).alias("left_id"), F.col(year).alias("left_year"))
    b = left.select(*keys, F.col(id_).alias("right_id"), F.col(year).alias("right_year"))
    reach = b.withColumn("_year", F.explode(F.sequence(F.col("right_year") - k, F.col("right_year") + k)))
    return a.withColumn("_year", F.col("left_year")).join(reach, [*keys, "_year"]).filter("left_id < right_id").drop("_year")


def verify_trials(ids: DataFrame, registry: DataFrame, works: DataFrame, available: bool = True) -> DataFrame:
    """Check NCT ids against a registry table (trial_id, brief_title).

    Titles of every script are compared; a blank title is none and neither verifies nor refutes.
    """
    asked = ids.filter("registry = 'NCT'").join(works.select("work_id", "title"), "work_id", "left")
    joined = asked.join(one_per_key(registry.withColumnRenamed("brief_title", "registry_title"), "trial_id"), "trial_id", "left")
    both = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("registry_title", F.lit(""))) != "")
    match = both & text.registry_title_match(F.col("title"), F.col("registry_title"))
    found = F.col("in_registry").isNotNull()
    return joined.select(
        "work_id",
        "trial_id",
        F.when(F.lit(not available), "unavailable")
        .when(~found, "not_found")
        .when(match, "verified")
        .when(both, "mismatch")
        .otherwise("verified")
        .alias("status"),
        F.when(F.lit(not available), 0.0)
        .when(~found, 0.9)
        .when(match, 1.0)
        .when(both, 0.5)
        .otherwise(0.8)
        .alias("confidence"),
    )


def new_since(current: DataFrame, fetched: DataFrame, since_year: int, id_: str = "record_key") -> DataFrame:
    """Fetched rows from `since_year` on that the session does not hold yet."""
    return fetched.filter(F.col("year") >= since_year).join(current.select(id_).distinct(), id_, "left_anti")


def reconcile(current: DataFrame, imported: DataFrame, mode: str, keys: tuple[str, ...] = ("kind", "paper_id")) -> DataFrame:
    """Merge (append what is unseen) or replace a session's rows of every kind."""
    if mode == "replace":
        return imported
    if mode != "merge":
        raise ValueError("mode is merge or replace")
    unseen = imported.join(current.select(*keys).distinct(), list(keys), "left_anti")
    return current.unionByName(unseen, allowMissingColumns=True)


def reconcile_stats(current: DataFrame, imported: DataFrame, keys: tuple[str, ...] = ("kind", "paper_id")) -> DataFrame:
    """Per kind: imported rows, new ones, existing ones."""
    mark = current.select(*keys, F.lit(True).alias("_here")).distinct()
    return imported.join(mark, list(keys), "left").groupBy("kind").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_here").isNull()).alias("new"),
        F.count_if(F.col("_here").isNotNull()).alias("existing"),
    )


def source_records(papers: DataFrame, flags: DataFrame) -> DataFrame:
    """Physical records behind each paper, one row each: its own and its flagged partners.

    A flag belongs to a paper by id or by title. The result is long, so no partner list is
    ever held in one row, and it grows with the square of a shared title. Those pairs are not
    made distinct, which would hold them in a task: both sides of the title join are, a partner
    with the paper's own id is left to the join by id, and only papers under several titles
    (or without an id) can repeat a pair.
    """
    cols = ["paper_id", "source", "source_id"]
    own = papers.select("paper_id", "source", F.col("paper_id").cast("string").alias("source_id"), F.col("title").alias("_title"))
    flag = flags.select(
        F.col("paired_id").cast("string").alias("source_id"), F.col("paired_source").alias("source"), F.col("paired_title").alias("_title")
    ).distinct()
    by_id = own.select("paper_id", "source_id").join(flag.select("source_id", "source"), "source_id")
    titles = own.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("_title").alias("_title"), F.max("_title").alias("_last"))
    others = F.col("source_id").isNull() | (F.col("source_id") != F.col("paper_id").cast("string"))
    by_title = titles.filter("_title = _last").join(flag, "_title").filter(others)
    unsure = own.join(titles.filter("_title <> _last").select("paper_id"), "paper_id", "left_semi").unionByName(own.filter("paper_id IS NULL"))
    repeated = unsure.select("paper_id", "_title").distinct().join(flag, "_title")
    few = own.select(*cols).unionByName(by_id.select(*cols)).unionByName(repeated.select(*cols)).distinct()
    return few.unionByName(by_title.select(*cols))


def screening_subject(screen: DataFrame, works: DataFrame, trials: DataFrame, registry_result: DataFrame, equity: DataFrame) -> DataFrame:
    """Adjudication rows: the paper must exist; trial, registry and equity results are attached.

    Each side gives one row per paper, the least where there are several.
    """
    of = lambda df, *cols: one_per_key(df.select(F.col("work_id").alias("paper_id"), *cols), "paper_id")
    return (
        screen.join(of(works, "title", "country"), "paper_id")
        .join(of(trials, "trial_id"), "paper_id", "left")
        .join(of(registry_result, F.col("status").alias("trial_status")), "paper_id", "left")
        .join(of(equity, "adjusted_score"), "paper_id", "left")
        .withColumn("score", F.coalesce("adjusted_score", "score"))
        .drop("adjusted_score")
    )


def intersect_ids(*sets: DataFrame, id_: str = "id") -> DataFrame:
    """Ids present in every set."""
    tagged = None
    for n, one in enumerate(sets):
        part = one.select(id_).distinct().withColumn("_set", F.lit(n))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(id_).agg(F.count("*").alias("_sets")).filter(F.col("_sets") == len(sets)).select(id_)


def except_ids(a: DataFrame, b: DataFrame, id_: str = "id") -> DataFrame:
    return a.select(id_).distinct().join(b.select(id_).distinct(), id_, "left_anti")


def union_sources(frames: dict[str, DataFrame | Exception], schema: str) -> tuple[DataFrame, dict[str, str]]:
    """All source results in one table, and the sources that failed with their error."""
    errors = {name: str(f) for name, f in frames.items() if isinstance(f, Exception)}
    good = [f.withColumn("source", F.lit(name)) for name, f in frames.items() if not isinstance(f, Exception)]
    if not good:
        raise ValueError("no source answered: " + "; ".join(f"{k}: {v}" for k, v in errors.items()))
    out = good[0]
    for other in good[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out, errors


def append_first_wins(existing: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first writer per key, unless the key is already stored."""
    from .windows import first_per_key

    first = first_per_key(new, keys, order)
    if existing is None:
        return first
    stored = existing.select(*keys).distinct()
    same = [first[k].eqNullSafe(stored[k]) for k in keys]
    return first.join(stored, same, "left_anti")
