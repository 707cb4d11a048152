"""Filters and predicates over works, pages, calls and protocol texts."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scores, text

# --- Boolean conditions -----------------------------------------------------------
# A condition is a term (str) or a tuple ("and" | "or", part, ...) / ("not", part).


def all_of(*parts):
    return ("and", *parts)


def any_of(*parts):
    return ("or", *parts)


def none_of(*parts):
    return ("not", parts[0] if len(parts) == 1 else ("or", *parts))


def boolean_column(spec, haystack: Column) -> Column:
    """Fold a condition into one Column; `haystack` is already lower case."""
    if isinstance(spec, str):
        return haystack.contains(spec.lower())
    kind, *parts = spec
    if kind == "not":
        return ~boolean_column(parts[0], haystack)
    return reduce(and_ if kind == "and" else or_, (boolean_column(p, haystack) for p in parts))


def searchable(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def boolean_filter(df: DataFrame, spec, cols: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Exact AND/OR/NOT over case-insensitive containment."""
    return df.filter(boolean_column(spec, searchable(*[F.col(c) for c in cols])))


def has_and(spec) -> bool:
    return not isinstance(spec, str) and (spec[0] == "and" or any(has_and(p) for p in spec[1:]))


def superset_filter(spec):
    """Relax every AND to OR: what to ask of a source that cannot intersect."""
    if isinstance(spec, str):
        return spec
    kind, *parts = spec
    return ("or" if kind == "and" else kind, *[superset_filter(p) for p in parts])


def leaf_terms(spec) -> list[str]:
    return [spec] if isinstance(spec, str) else [t for p in spec[1:] for t in leaf_terms(p)]


def excluded_terms(spec) -> list[str]:
    """Leaves under a NOT, lower case."""
    if isinstance(spec, str):
        return []
    if spec[0] == "not":
        return [t.lower() for t in leaf_terms(spec[1])]
    return [t for p in spec[1:] for t in excluded_terms(p)]


def phrases(spec) -> list[str]:
    """Distinct leaves (ignoring case), multi-word ones quoted."""
    seen: dict[str, str] = {}
    for term in leaf_terms(spec):
        seen.setdefault(term.lower(), f'"{term}"' if len(term.split()) > 1 else term)
    return list(seen.values())


def exclude_terms(df: DataFrame, terms: list[str], col: str = "title") -> DataFrame:
    if not terms:
        return df
    listed = F.array(*[F.lit(t.lower()) for t in terms])
    return df.filter(~text.let(F.lower(F.coalesce(F.col(col), F.lit(""))), lambda low: F.exists(listed, lambda t: low.contains(t))))


# --- Record filters ----------------------------------------------------------------


def search_filters(df: DataFrame, **wanted) -> DataFrame:
    """All fourteen search filters; each is a plain predicate the scan can take over."""
    col = F.col
    rules = {
        "date_from": lambda v: col("year") >= v,
        "date_to": lambda v: col("year") <= v,
        "publication_types": lambda v: col("type").isin(v),
        "peer_reviewed_only": lambda v: col("peer_reviewed") if v else None,
        "study_designs": lambda v: col("study_design").isin(v),
        "languages": lambda v: col("language").isin(v),
        "open_access_only": lambda v: col("is_oa") if v else None,
        "countries": lambda v: col("country").isin(v),
        "disciplines": lambda v: F.arrays_overlap(col("disciplines"), F.array(*[F.lit(x) for x in v])),
        "authors": lambda v: F.exists(
            F.array(*[F.lit(x.lower()) for x in v]), lambda a: F.lower(col("first_author")).contains(a)
        ),
        "institutions": lambda v: F.exists(
            F.array(*[F.lit(x.lower()) for x in v]), lambda a: F.lower(col("publisher")).contains(a)
        ),
        "journal_issn": lambda v: F.regexp_replace(col("issn"), "-", "") == v.replace("-", ""),
        "doi": lambda v: text.norm_doi(col("doi")) == text.norm_doi(F.lit(v)),
        "pmid": lambda v: col("pmid") == v,
    }
    unknown = set(wanted) - set(rules)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for name, value in wanted.items():
        condition = rules[name](value) if value is not None else None
        if condition is not None:
            df = df.filter(condition)
    return df


def incomplete_reason(title: Column, year: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", "no title").when(
        year.isNull() | (year == 0), "no year"
    )


def drop_incomplete(df: DataFrame, title: str = "title", year: str = "year") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with a reason)."""
    marked = df.withColumn("reject_reason", incomplete_reason(F.col(title), F.col(year)))
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


_KIND_ORDER = {"host": 0, "publisher": 1, "issn": 2}


def _ranked(entries, threshold: float) -> list[tuple[int, int, str, str, float]]:
    """(kind order, ordinal, kind, pattern, confidence) of the entries that count, strongest first."""
    return sorted((_KIND_ORDER[k], n, k, p, float(c)) for n, (k, p, c) in enumerate(entries) if c >= threshold)


def _plain_issn(issn: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(issn, F.lit("")), "-", ""))


def _hit(ranked, doi: Column, publisher: Column, issn: Column) -> Column:
    """Struct (order, ordinal, field, pattern, confidence) of the first entry that matches, else null."""
    host, low, plain = text.host_of(doi), F.lower(F.coalesce(publisher, F.lit(""))), _plain_issn(issn)

    def test(kind: str, pattern: str) -> Column:
        if kind == "publisher":
            return low.contains(pattern)
        if kind == "issn":
            return plain == pattern.replace("-", "").lower()
        return host.rlike("(?i)^" + pattern.replace("*", ".*") + "$") if "*" in pattern else host == pattern

    out = F.lit(None).cast("struct<o:int,n:int,field:string,pattern:string,confidence:double>")
    for o, n, kind, pattern, confidence in reversed(ranked):
        found = F.struct(F.lit(o).alias("o"), F.lit(n).alias("n"), F.lit(kind).alias("field"), F.lit(pattern).alias("pattern"), F.lit(confidence).alias("confidence"))
        out = F.when(test(kind, pattern), found).otherwise(out)
    return out


def predatory_match(entries, doi: Column, publisher: Column, issn: Column, threshold: float = L.PREDATORY_CONFIDENCE) -> Column:
    """Struct (field, pattern, confidence) of the first hit: host, publisher, ISSN; else null.

    One branch per entry; `quarantine` takes lists of any length.
    """
    hit = _hit(_ranked(entries, threshold), doi, publisher, issn)
    return F.when(hit.isNotNull(), F.struct(hit["field"].alias("field"), hit["pattern"].alias("pattern"), hit["confidence"].alias("confidence")))


def _looked_up(df: DataFrame, value: Column, exact, name: str) -> DataFrame:
    """df with the entry whose key equals `value` as struct `name`; rows without a value get a key of their own."""
    shape = "key string, o int, n int, field string, pattern string, confidence double"
    table = df.sparkSession.createDataFrame([(key, *e) for key, e in exact], shape).select(F.col("key").alias("_key"), F.struct("o", "n", "field", "pattern", "confidence").alias(name))
    own = F.concat(F.lit("none:"), F.monotonically_increasing_id().cast("string"))
    keyed = df.withColumn("_key", F.coalesce(F.nullif(value, F.lit("")), own))
    return keyed.join(table.groupBy("_key").agg(F.min(name).alias(name)), "_key", "left").drop("_key")


def quarantine(
    df: DataFrame, entries: list[tuple[str, str, float]], doi: str = "doi", publisher: str = "publisher", issn: str = "issn",
    threshold: float = L.PREDATORY_CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """(clean rows, log of the rows held back).

    Exact hosts and ISSNs of the list are met by equi-join, so it may be long; only host
    wildcards and publisher texts, which need a test per entry, are part of the expression.
    """
    issn_col = F.col(issn) if issn in df.columns else F.lit(None).cast("string")
    ranked = _ranked(entries, threshold)
    hosts = [(e[3], e) for e in ranked if e[2] == "host" and "*" not in e[3]]
    issns = [(e[3].replace("-", "").lower(), e) for e in ranked if e[2] == "issn"]
    loose = [e for e in ranked if e[2] == "publisher" or (e[2] == "host" and "*" in e[3])]
    marked = _looked_up(df, text.host_of(F.col(doi)), hosts, "_host") if hosts else df.withColumn("_host", _hit([], F.lit(None), F.lit(None), F.lit(None)))
    marked = _looked_up(marked, _plain_issn(issn_col), issns, "_issn") if issns and issn in df.columns else marked.withColumn("_issn", _hit([], F.lit(None), F.lit(None), F.lit(None)))
    first = F.array_min(F.array_compact(F.array("_host", "_issn", _hit(loose, F.col(doi), F.col(publisher), issn_col))))
    marked = marked.withColumn("predatory", first).drop("_host", "_issn")
    log = marked.filter("predatory IS NOT NULL").select(
        F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title"),
        F.col(doi).alias("doi"),
        F.col(publisher).alias("publisher"),
        F.col("predatory.field").alias("matched_field"),
        F.col("predatory.confidence").alias("confidence"),
        F.col("source"),
    )
    return marked.filter("predatory IS NULL").drop("predatory"), log


def validate_pages(df: DataFrame, page_size: int = L.PAGE_SIZE) -> DataFrame:
    """One verdict per (source, page): rows carry title, doi, hit_count; an empty page has one null row."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    present = F.col("record_no").isNotNull()
    pages = df.groupBy("source", "page").agg(
        F.count_if(present).alias("n"),
        F.coalesce(F.bool_or(present & blank("title") & blank("doi")), F.lit(False)).alias("corrupt"),
        F.max("hit_count").alias("hit_count"),
    )
    final = (F.col("n") <= page_size) & (F.col("page") * page_size >= F.col("hit_count"))
    short = F.col("n") < page_size * 0.5
    return pages.select(
        "source",
        "page",
        "n",
        F.when((F.col("n") == 0) & (F.col("page") == 1), "Empty first page")
        .when(F.col("corrupt"), "Result missing both title and DOI")
        .when(~final & short, "Truncated page")
        .otherwise("valid")
        .alias("verdict"),
    )


def schema_violations(df: DataFrame) -> Column:
    """Names of the record rules a row breaks."""
    low, high = L.YEAR_RANGE
    rules = {
        "title required": F.coalesce(F.length("title"), F.lit(0)) < 1,
        "year out of range": F.col("year").isNull() | ~F.col("year").between(low, high),
        "unknown publication type": ~F.coalesce(F.col("publication_type").isin(L.PUBLICATION_TYPES), F.lit(False)),
        "negative citations": F.coalesce(F.col("citations") < 0, F.lit(False)),
        "bad url": F.col("full_text_url").isNotNull() & F.try_parse_url("full_text_url", F.lit("HOST")).isNull(),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def validate_schema(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("violations", schema_violations(df))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def protocol_gate(df: DataFrame, col: str = "text") -> DataFrame:
    """Methodology keywords (at least 3 of 5) and at least one declared database."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))

    def mentioned(body: Column, keyword: str) -> Column:
        spellings = F.array(*[F.lit(s) for s in [keyword, *L.PROTOCOL_KEYWORDS[keyword]]])
        return F.exists(spellings, lambda s: body.contains(s))

    names = list(L.PROTOCOL_KEYWORDS)
    found = text.let(low, lambda body: F.array_compact(F.array(*[F.when(mentioned(body, k), F.lit(k)) for k in names])))
    databases = F.array_compact(
        F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in L.PROTOCOL_DATABASES.items()])
    )
    everything = F.array(*[F.lit(k) for k in names])
    enough, declared = F.size("keywords") >= 3, F.size("databases") >= 1
    return (
        df.withColumn("keywords", found)
        .withColumn("databases", databases)
        .withColumn("text_hash", F.sha2(F.coalesce(F.col(col), F.lit("")), 256))
        .withColumn("valid", enough & declared)
        .withColumn(
            "warnings",
            F.concat(
                F.transform(F.array_except(everything, F.col("keywords")), lambda k: F.concat(F.lit("Missing keyword: "), k)),
                F.when(enough & ~declared, F.array(F.lit("possible generic padding"))).otherwise(F.array().cast("array<string>")),
            ),
        )
        .withColumn(
            "rejection_reason",
            F.when(~enough, "insufficient keywords").when(~declared, "no database declared"),
        )
    )


def export_gate(statuses: DataFrame, requests: DataFrame) -> DataFrame:
    """Decide each export request (search_id, mode, format) from its source statuses."""
    failed = F.col("source").isin(L.APEX_SOURCES) & (F.col("status") == "error")
    health = statuses.groupBy("search_id").agg(F.bool_or(failed).alias("apex_failed"))
    joined = requests.join(health, "search_id", "left").withColumn("apex_failed", F.coalesce("apex_failed", F.lit(False)))
    systematic = F.col("apex_failed") & (F.col("mode") == "systematic_review")
    evidence = F.col("apex_failed") & (F.col("mode") == "evidence")
    reference_file = F.col("format").isin("ris", "csv")
    return joined.select(
        "search_id",
        "mode",
        "format",
        (~(systematic | (evidence & reference_file))).alias("allowed"),
        F.when(evidence & reference_file, "pdf").alias("downgrade_to"),
        (evidence).alias("watermarked"),
        F.when(systematic, "apex source lock: systematic review")
        .when(evidence & reference_file, "apex source lock: evidence")
        .when(evidence, "watermarked export")
        .otherwise("all sources operational")
        .alias("reason"),
    )


def expire(df: DataFrame, now: Column, schema_version: int, expires: str = "expires_at", version: str = "schema_version") -> DataFrame:
    """Rows still readable at `now`: not expired and not of an older schema."""
    return df.filter((F.col(expires).isNull() | (F.col(expires) > now)) & (F.coalesce(version, F.lit(1)) >= schema_version))


def term_status(df: DataFrame, approved: DataFrame, existing: DataFrame, rejected: DataFrame) -> DataFrame:
    """REJECTED > APPROVED > EXISTING > EXPERIMENTAL > CANDIDATE; lists have one column `term`.

    Experimental are wildcards and proximity; a word that only begins like an operator (nearest) is neither.
    """
    key = F.lower(F.trim("term"))
    out = df.withColumn("term_key", key)
    for name, listed in (("is_rejected", rejected), ("is_approved", approved), ("is_existing", existing)):
        marks = listed.select(key.alias("term_key")).distinct().withColumn(name, F.lit(True))
        out = out.join(marks, "term_key", "left")
    novel = F.col("term").rlike("[*?~]") | F.col("term").rlike(L.PROXIMITY_TERM_PATTERN)
    return out.withColumn(
        "status",
        F.when(F.col("is_rejected"), "REJECTED")
        .when(F.col("is_approved"), "APPROVED")
        .when(F.col("is_existing"), "EXISTING")
        .when(novel, "EXPERIMENTAL")
        .otherwise("CANDIDATE"),
    ).drop("term_key", "is_rejected", "is_approved", "is_existing")


def watermark_missing(df: DataFrame, degraded: list[str]) -> DataFrame:
    """Facts that may be missing because their source was degraded, as a map column."""
    facts = [f for s in degraded for f in L.SOURCE_FACTS.get(s, [])]
    marks = scores.literal_map(dict.fromkeys(facts, True)) if facts else F.lit(None).cast("map<string,boolean>")
    return df.withColumn("watermarks", marks)
