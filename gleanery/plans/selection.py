"""Catalogue: filters, joins, set operations, ranking and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scores, text
from ..operators import dedup, filters, jobs, joins, ledger as ledger_ops, metrics, textops, windows
from .records import _export_requests, _named_sources, md5
from .registry import lit, listed, query, re_all, sql_author, sql_doi, sql_hash, sql_map, sql_surname, sql_title, sql_trim

SPEC = filters.all_of("the", filters.any_of("and", "for"), filters.none_of("zebra"))
HAY = "lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')))"


def sql_spec(spec, hay: str = HAY) -> str:
    if isinstance(spec, str):
        return f"contains({hay}, {lit(spec.lower())})"
    kind, *parts = spec
    if kind == "not":
        return f"(NOT {sql_spec(parts[0], hay)})"
    return "(" + f" {kind.upper()} ".join(sql_spec(p, hay) for p in parts) + ")"


# --- Filters -----------------------------------------------------------------------------


@query("boolean_filter", f"SELECT work_id, title FROM works WHERE {sql_spec(SPEC)}")
def _(t):
    return filters.boolean_filter(t.works, SPEC).select("work_id", "title")


@query(
    "superset_filter",
    """SELECT work_id, contains(h, 'the') AND (contains(h, 'and') OR contains(h, 'for')) AND NOT contains(h, 'zebra') AS exact
FROM (SELECT work_id, lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))) AS h FROM works)
WHERE contains(h, 'the') OR contains(h, 'and') OR contains(h, 'for') OR NOT contains(h, 'zebra')""",
)
def _(t):
    wide = filters.boolean_filter(t.works, filters.superset_filter(SPEC))
    exact = filters.boolean_column(SPEC, filters.searchable(F.col("title"), F.col("abstract")))
    return wide.select("work_id", exact.alias("exact"))


@query("exclude_terms", "SELECT work_id FROM works WHERE NOT contains(lower(title), 'malaysia') AND NOT contains(lower(title), 'guideline')")
def _(t):
    spec = filters.all_of("the", filters.none_of("Malaysia", "guideline"))
    return filters.exclude_terms(t.works, filters.excluded_terms(spec)).select("work_id")


@query(
    "search_filters",
    f"""SELECT work_id FROM works WHERE year >= 2005 AND year <= 2020 AND type IN ('clinical-trial', 'cohort-study', 'systematic-review', 'meta-analysis', 'report')
AND is_oa AND country IN ('en', 'de') AND contains(lower(publisher), 'publisher')""",
)
def _(t):
    wanted = dict(
        date_from=2005, date_to=2020, open_access_only=True, countries=["en", "de"], institutions=["Publisher"],
        publication_types=["clinical-trial", "cohort-study", "systematic-review", "meta-analysis", "report"],
    )
    return filters.search_filters(t.works, **wanted).select("work_id")


@query(
    "search_by_identity",
    f"SELECT work_id FROM works WHERE {sql_doi('doi')} = '10.1003/w3' OR (contains(lower(first_author), 'müller') AND is_oa)",
)
def _(t):
    by_doi = filters.search_filters(t.works, doi="doi:10.1003/W3")
    by_author = filters.search_filters(t.works, authors=["Müller"], open_access_only=True)
    return by_doi.unionByName(by_author).select("work_id").distinct()


_RAW_YEAR = "coalesce(TRY_CAST(year_str AS INT), publication_year, TRY_CAST(nullif(regexp_extract(sortpubdate, '(\\d{4})', 1), '') AS INT))"


@query(
    "drop_incomplete",
    f"""SELECT seq, CASE WHEN coalesce(title, '') = '' THEN 'no title' WHEN year IS NULL THEN 'no year' ELSE '' END AS reason
FROM (SELECT seq, coalesce(nullif(title, ''), title_alt) AS title, {_RAW_YEAR} AS year FROM works_raw)""",
)
def _(t):
    from ..sources.readers import normalize_works

    good, bad = filters.drop_incomplete(normalize_works(t.works_raw))
    return good.select("seq", F.lit("").alias("reason")).unionByName(bad.select("seq", F.col("reject_reason").alias("reason")))


_HOST = "CASE WHEN starts_with(lower(u), 'http') THEN regexp_extract(lower(u), '^https?://([^/?#:]+)', 1) WHEN contains(u, '/') THEN split_part(lower(u), '/', 1) END"


@query(
    "quarantine",
    """SELECT work_id, CASE WHEN contains(lower(publisher), 'sample bad press') THEN 'publisher' END AS matched_field,
       CAST(CASE WHEN contains(lower(publisher), 'sample bad press') THEN 0.95 END AS DOUBLE) AS confidence
FROM works""",
)
def _(t):
    hit = filters.predatory_match(L.PREDATORY_SAMPLE, F.col("doi"), F.col("publisher"), F.lit(None).cast("string"))
    return t.works.select("work_id", hit.alias("h")).select("work_id", F.col("h.field").alias("matched_field"), F.col("h.confidence").alias("confidence"))


@query(
    "quarantine_hosts",
    f"""SELECT page_id, CASE WHEN h LIKE 'www.%' THEN 'host' WHEN h LIKE '%.org' THEN 'host' WHEN contains(url, 'news') THEN 'publisher' WHEN page_id % 5 = 0 THEN 'issn' END AS matched_field
FROM (SELECT page_id, url, {_HOST.replace('(u)', '(url)').replace('(u,', '(url,')} AS h FROM pages)""",
)
def _(t):
    """URL hosts by wildcard, then publisher text, then ISSN; entries under the threshold do not count."""
    entries = [("host", "www.*", 0.9), ("host", "*.org", 0.7), ("publisher", "news", 0.8), ("publisher", "a", 0.5), ("issn", "1234-567x", 0.9)]
    issn = F.when(F.col("page_id") % 5 == 0, "1234-567X")
    hit = filters.predatory_match(entries, F.col("url"), F.col("url"), issn)
    return t.pages.select("page_id", hit["field"].alias("matched_field"))


@query(
    "host_of",
    f"SELECT page_id, {_HOST.replace('(u)', '(url)').replace('(u,', '(url,')} AS host, CASE WHEN page_id % 2 = 0 THEN '10.1234' END AS doi_prefix FROM pages",
)
def _(t):
    doi = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.1234/J."), F.col("page_id").cast("string"))).otherwise("no-doi")
    return t.pages.select("page_id", text.host_of(F.col("url")).alias("host"), text.host_of(doi).alias("doi_prefix"))


@query(
    "validate_pages",
    """WITH recs AS (SELECT source, CAST(event_id // 24 + 1 AS BIGINT) AS page, CASE WHEN latency_ms > 0.5 THEN event_id END AS record_no,
  CASE WHEN ok THEN search_id END AS title, CASE WHEN latency_ms > 20 THEN 'd' END AS doi, CAST(400 AS INT) AS hit_count FROM calls),
p AS (SELECT source, page, count(record_no) AS n, coalesce(bool_or(title IS NULL AND doi IS NULL) FILTER (WHERE record_no IS NOT NULL), false) AS corrupt FROM recs GROUP BY ALL)
SELECT source, page, n, CASE WHEN n = 0 AND page = 1 THEN 'Empty first page' WHEN corrupt THEN 'Result missing both title and DOI'
  WHEN NOT (n <= 4 AND page * 4 >= 400) AND n < 2 THEN 'Truncated page' ELSE 'valid' END AS verdict FROM p""",
)
def _(t):
    c = F.col
    recs = t.calls.select(
        "source", (F.floor(c("event_id") / 24) + 1).alias("page"), F.when(c("latency_ms") > 0.5, c("event_id")).alias("record_no"),
        F.when(c("ok"), c("search_id")).alias("title"), F.when(c("latency_ms") > 20, "d").alias("doi"), F.lit(400).alias("hit_count"),
    )
    return filters.validate_pages(recs, page_size=4)


@query(
    "validate_schema",
    f"""SELECT work_id, concat_ws(',', CASE WHEN length(title) < 1 THEN 'title required' END, CASE WHEN year + 80 NOT BETWEEN 1900 AND 2100 THEN 'year out of range' END,
  CASE WHEN NOT coalesce(replace(type, '-', '_') IN ({listed(L.PUBLICATION_TYPES)[1:-1]}), false) THEN 'unknown publication type' END) AS violations FROM works""",
)
def _(t):
    shaped = t.works.select(
        "work_id", "title", (F.col("year") + 80).alias("year"), F.replace("type", F.lit("-"), F.lit("_")).alias("publication_type"), "citations", F.col("doi").alias("full_text_url")
    )
    good, bad = filters.validate_schema(shaped)
    return good.select("work_id", F.lit("").alias("violations")).unionByName(bad.select("work_id", F.array_join("violations", ",").alias("violations")))


# the documents are general prose, so the check runs with everyday words in place of the review terms
def _keyword_hits(hay: str) -> str:
    tests = [
        f"CASE WHEN {' OR '.join(f'contains({hay}, {lit(s)})' for s in [k, *alts])} THEN {lit(k)} END" for k, alts in L.PROTOCOL_KEYWORDS.items()
    ]
    return "list_filter([" + ", ".join(tests) + "], lambda x: x IS NOT NULL)"


_PROTOCOL_TEXT = """concat(text, CASE WHEN doc_id % 2 = 0 THEN ' Inclusion criteria. Literature search. Risk of bias.' ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN ' We searched MEDLINE and PubMed.' WHEN doc_id % 3 = 1 THEN ' Scopus database.' ELSE '' END)"""


@query(
    "protocol_gate",
    f"""WITH d AS (SELECT doc_id, {_PROTOCOL_TEXT} AS body FROM documents),
k AS (SELECT doc_id, {_keyword_hits('lower(body)')} AS kw, (CASE WHEN regexp_matches(lower(body), {lit(L.PROTOCOL_DATABASES['PubMed'])}) THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(lower(body), {lit(L.PROTOCOL_DATABASES['Scopus'])}) THEN 1 ELSE 0 END) AS db, sha256(body) AS text_hash FROM d)
SELECT doc_id, array_to_string(kw, ',') AS keywords, CAST(db AS INT) AS databases, len(kw) >= 3 AND db >= 1 AS valid, text_hash,
  CASE WHEN len(kw) < 3 THEN 'insufficient keywords' WHEN db < 1 THEN 'no database declared' END AS rejection_reason FROM k""",
)
def _(t):
    body = F.concat(
        F.col("text"), F.when(F.col("doc_id") % 2 == 0, " Inclusion criteria. Literature search. Risk of bias.").otherwise(""),
        F.when(F.col("doc_id") % 3 == 0, " We searched MEDLINE and PubMed.").when(F.col("doc_id") % 3 == 1, " Scopus database.").otherwise(""),
    )
    gated = filters.protocol_gate(t.documents.select("doc_id", body.alias("text")))
    return gated.select("doc_id", F.array_join("keywords", ",").alias("keywords"), F.size("databases").alias("databases"), "valid", "text_hash", "rejection_reason")


@query(
    "export_gate",
    """WITH h AS (SELECT search_id, bool_or(source IN ('s0', 's1') AND status = 'error') AS bad FROM calls GROUP BY search_id),
r AS (SELECT * FROM h, (VALUES ('evidence'), ('systematic_review'), ('discovery')) m(mode), (VALUES ('ris'), ('csv'), ('json'), ('pdf')) f(format))
SELECT search_id, mode, format, NOT (bad AND (mode = 'systematic_review' OR (mode = 'evidence' AND format IN ('ris', 'csv')))) AS allowed,
  CASE WHEN bad AND mode = 'evidence' AND format IN ('ris', 'csv') THEN 'pdf' END AS downgrade_to, bad AND mode = 'evidence' AS watermarked FROM r""",
)
def _(t):
    requests = _export_requests(t).select("search_id", "mode", "format")
    return filters.export_gate(_named_sources(t), requests).drop("reason")


@query(
    "expire",
    """SELECT event_id FROM calls WHERE ts + INTERVAL 1 DAY > CAST('2024-01-20' AS TIMESTAMP) AND page >= 2""",
)
def _(t):
    aged = t.calls.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 DAY")).withColumn("schema_version", F.col("page"))
    return filters.expire(aged, F.lit("2024-01-20").cast("timestamp"), 2).select("event_id")


_PHRASES = sorted((p for p in L.DOMAIN_PHRASES if " " in p), key=lambda p: (-len(p), p))
_QUERY_TEXT = "concat(CASE WHEN turn % 3 = 0 THEN 'tear film and \"dry eye\" ' WHEN turn % 3 = 1 THEN 'night driving difficulty ' ELSE '' END, text)"


@query(
    "domain_query",
    f"""SELECT conv_id, turn, {' OR '.join(f'contains(lower(q), {lit(k)})' for k in L.DOMAIN_KEYWORDS)} AS in_domain,
  md5(regexp_replace(q, {lit('(?i)"?(' + '|'.join(_PHRASES) + ')"?')}, '"\\1"', 'g')) AS quoted_md5 FROM (SELECT conv_id, turn, {_QUERY_TEXT} AS q FROM chat)""",
)
def _(t):
    q = F.concat(F.when(F.col("turn") % 3 == 0, 'tear film and "dry eye" ').when(F.col("turn") % 3 == 1, "night driving difficulty ").otherwise(""), F.col("text"))
    return t.chat.select("conv_id", "turn", q.alias("q")).select(
        "conv_id", "turn", text.is_domain_query(F.col("q")).alias("in_domain"), md5(text.quote_phrases(F.col("q"))).alias("quoted_md5")
    )


@query(
    "term_status",
    """WITH w AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN concat(split_part(text, ' ', 1), '*') ELSE split_part(text, ' ', 1) END AS term FROM documents),
a AS (SELECT DISTINCT lower(trim(split_part(text, ' ', 2))) AS k FROM documents WHERE lang = 'en'), e AS (SELECT DISTINCT lower(trim(split_part(text, ' ', 3))) AS k FROM documents WHERE lang = 'de'),
r AS (SELECT DISTINCT lower(trim(split_part(text, ' ', 2))) AS k FROM documents WHERE lang = 'fr')
SELECT term, CASE WHEN lower(trim(term)) IN (SELECT k FROM r) THEN 'REJECTED' WHEN lower(trim(term)) IN (SELECT k FROM a) THEN 'APPROVED' WHEN lower(trim(term)) IN (SELECT k FROM e) THEN 'EXISTING'
 WHEN regexp_matches(term, '[*?~]') THEN 'EXPERIMENTAL' ELSE 'CANDIDATE' END AS status FROM w""",
)
def _(t):
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    terms = t.documents.select(F.when(F.col("doc_id") % 7 == 0, F.concat(word(1), F.lit("*"))).otherwise(word(1)).alias("term")).distinct()
    by = lambda lang, n: t.documents.filter(F.col("lang") == lang).select(word(n).alias("term"))
    return filters.term_status(terms, by("en", 2), by("de", 3), by("fr", 2)).select("term", "status")


@query(
    "detect_features",
    """SELECT conv_id, turn, contains(text, '*') AS has_star, contains(text, '?') AS has_qmark, contains(text, '$') OR contains(text, '#') AS has_dollar_hash,
  regexp_matches(concat(' ', upper(text), ' '), '\\bOR\\b') AS has_or FROM chat""",
)
def _(t):
    return t.chat.select("conv_id", "turn", text.detect_features(F.col("text")).alias("f")).select("conv_id", "turn", "f.has_star", "f.has_qmark", "f.has_dollar_hash", "f.has_or")


@query(
    "detect_features_all",
    f"""SELECT conv_id, turn, contains(text, '*') AS has_star, contains(text, '?') AS has_qmark, contains(text, '$') OR contains(text, '#') AS has_dollar_hash,
  regexp_matches(text, {lit(L.PROXIMITY_PATTERN)}) AS has_proximity, regexp_matches(text, {lit(L.FIELD_PATTERN)}) AS has_field, regexp_matches(text, {lit(L.MESH_PATTERN)}) AS has_mesh,
  regexp_matches(concat(' ', upper(text), ' '), '\\bOR\\b') AS has_or, regexp_matches(concat(' ', upper(text), ' '), '\\bNOT\\b') OR regexp_matches(text, '(^|\\s)-["\\w]') AS has_not,
  contains(text, '*') AND regexp_matches(lower(text), '\\[ *(ti|tiab|ad) *:~\\d+ *\\]') AS proximity_truncation_conflict FROM chat""",
)
def _(t):
    return t.chat.select("conv_id", "turn", text.detect_features(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


# --- Joins -------------------------------------------------------------------------------


def _facts(t):
    """Open-access facts for every second DOI, made from the works."""
    return t.sql("""SELECT lower(doi) AS doi, true AS is_oa, 'gold' AS oa_status, CASE WHEN max(work_id) % 2 = 0 THEN concat('http://oa/', CAST(max(work_id) AS STRING)) END AS oa_url,
  'cc-by' AS license, 'repo' AS repository, 'published' AS version FROM works WHERE doi IS NOT NULL AND seq % 2 = 0 GROUP BY lower(doi)""")


@query(
    "enrich_by_doi",
    """WITH f AS (SELECT lower(doi) AS d, max(work_id) AS m FROM works WHERE doi IS NOT NULL AND seq % 2 = 0 GROUP BY lower(doi))
SELECT work_id, CASE WHEN d IS NOT NULL THEN true ELSE is_oa END AS is_oa, CASE WHEN d IS NOT NULL THEN 'gold' ELSE 'unknown' END AS oa_status,
  coalesce(CASE WHEN m % 2 = 0 THEN concat('http://oa/', CAST(m AS STRING)) END, 'http://old') AS full_text_url, CASE WHEN d IS NOT NULL THEN 'cc-by' END AS oa_license
FROM works LEFT JOIN f ON lower(works.doi) = f.d""",
)
def _(t):
    out = joins.enrich_by_doi(t.works.withColumn("full_text_url", F.lit("http://old")), _facts(t))
    return out.select("work_id", "is_oa", "oa_status", "full_text_url", "oa_license")


@query(
    "verify_works",
    f"""WITH own AS (SELECT work_id, lower(doi) AS doi, regexp_replace(abstract, '[<>]', '', 'g') AS plain FROM works WHERE doi IS NOT NULL),
a AS (SELECT doi, min(work_id % 11 <> 0) AS fine, arg_min(raw, (work_id % 11 <> 0, CASE WHEN work_id % 11 = 0 THEN 'RETRACTED: x' ELSE 'x' END, raw)) AS raw
  FROM (SELECT *, CASE WHEN work_id % 4 = 1 THEN '<p>new text</p>' ELSE concat('<jats>', plain, '</jats>') END AS raw FROM own WHERE work_id % 7 <> 0) GROUP BY doi),
b AS (SELECT doi, min(work_id % 13 <> 0) AS fine, arg_min(plain, (work_id % 13 <> 0, plain)) AS raw FROM own WHERE work_id % 5 <> 0 GROUP BY doi),
m AS (SELECT work_id, plain, a.doi IS NULL AND b.doi IS NULL AS absent, NOT coalesce(a.fine, true) OR NOT coalesce(b.fine, true) AS gone,
  CASE WHEN a.doi IS NOT NULL THEN regexp_replace(a.raw, '<[^>]*>', '', 'g') ELSE b.raw END AS fresh FROM own LEFT JOIN a ON own.doi = a.doi LEFT JOIN b ON own.doi = b.doi)
SELECT work_id, CASE WHEN absent THEN 'not_found' WHEN gone THEN 'retracted'
  WHEN fresh <> '' AND plain <> '' AND sha256({sql_trim('lower(fresh)')}) <> sha256({sql_trim('lower(plain)')}) THEN 'revised' ELSE 'verified' END AS verdict FROM m""",
)
def _(t):
    """Authority copies of the works: some absent, some retracted, some with a new abstract."""
    own = t.works.filter("doi IS NOT NULL")
    manifest = own.select("work_id", "doi", text.abstract_hash(F.col("abstract")).alias("abstract_hash"), F.col("abstract").alias("cached_abstract"))
    w = F.col("work_id")
    crossref = own.filter(w % 7 != 0).select(
        "doi", F.lit("journal-article").alias("type"), F.when(w % 11 == 0, "RETRACTED: x").otherwise("x").alias("title"),
        F.when(w % 4 == 1, "<p>new text</p>").otherwise(F.concat(F.lit("<jats>"), F.regexp_replace("abstract", "[<>]", ""), F.lit("</jats>"))).alias("abstract"),
    )
    openalex = own.filter(w % 5 != 0).select("doi", F.when(w % 13 == 0, "retraction").otherwise("article").alias("type"), F.col("abstract"))
    plain = manifest.withColumn("abstract_hash", text.abstract_hash(F.regexp_replace("cached_abstract", "[<>]", "")))
    shown = joins.verify_works(plain, crossref, openalex.withColumn("abstract", F.regexp_replace("abstract", "[<>]", "")))
    return shown.select("work_id", "verdict")


def _dt(e: str) -> str:
    return f"trim({re_all(re_all(f'lower(coalesce({e}, chr(0)))', '[^\\p{L}\\p{N}_\\s]', ''), '\\s+', ' ')})"


def _sql_equiv(a: str, b: str) -> str:
    wa, wb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    overlap = f"len(list_intersect({wa}, {wb})) / greatest(len({wa}), len({wb}))"
    return f"({a} = {b} OR contains({b}, {a}) OR contains({a}, {b}) OR ({a} <> '' AND {b} <> '' AND {overlap} > 0.85))"


_SETS = "list_sort(list_distinct([trim(x) for x in string_split(lower(coalesce({}, '')), ',') if trim(x) <> '']))"


@query(
    "authority_diff",
    f"""WITH n AS (SELECT *, {_dt('title_lib')} AS a, {_dt('title_auth')} AS b, {_SETS.format('authors_lib')} AS sa, {_SETS.format('authors_auth')} AS sb FROM ledger),
d AS (SELECT uuid, coalesce(title_auth, '') <> '' AND a <> b AND NOT (title_lib <> '' AND {_sql_equiv('a', 'b')}) AS t, year_lib <> year_auth AS y, len(sb) > 0 AND sa <> sb AS au FROM n)
SELECT uuid, concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN y THEN 'year' END, CASE WHEN au THEN 'authors' END) AS fields, t OR y OR au AS needs_correction FROM d""",
)
def _(t):
    out = joins.authority_diff(t.ledger)
    return out.select("uuid", F.array_join(F.transform("corrections", lambda c: c["field"]), ",").alias("fields"), "needs_correction")


@query(
    "authority_diff_clean",
    """SELECT uuid, CASE WHEN state = 'DIFFED' THEN 'clean' ELSE 'crossref' END AS authority,
  CASE WHEN state = 'DIFFED' THEN year_lib <> 2001 ELSE year_lib <> year_auth END AS year_off FROM ledger""",
)
def _(t):
    clean = t.ledger.filter("state = 'DIFFED'").select("uuid", F.col("title_lib").alias("title"), F.lit(2001).alias("year"), F.col("authors_lib").alias("authors"))
    out = joins.authority_diff(t.ledger, clean)
    return out.select("uuid", "authority", F.exists("corrections", lambda c: c["field"] == "year").alias("year_off"))


@query(
    "clean_lookup",
    """WITH l AS (SELECT uuid, CASE WHEN uuid % 3 = 0 THEN concat('10.1/abc', CAST(uuid AS STRING)) WHEN uuid % 3 = 1 THEN concat('10.2/', CAST(uuid AS STRING), 'zz') ELSE '10.9' END AS doi FROM ledger),
r AS (SELECT concat('k', lpad(CAST(uuid AS STRING), 8, '0')) AS cite_key, CASE WHEN uuid % 2 = 0 THEN concat('10.1/abc', CAST(uuid AS STRING)) ELSE concat('https://doi.org/10.2/', CAST(uuid AS STRING), 'zz#x') END AS doi FROM ledger),
eq AS (SELECT l.uuid, min(cite_key) AS cite_key FROM l JOIN r ON l.doi = r.doi GROUP BY l.uuid),
inn AS (SELECT l.uuid, min(cite_key) AS cite_key FROM l JOIN r ON contains(r.doi, l.doi) WHERE l.uuid NOT IN (SELECT uuid FROM eq) GROUP BY l.uuid)
SELECT uuid, cite_key, 'equal' AS matched_by FROM eq UNION ALL SELECT uuid, cite_key, 'contained' FROM inn""",
)
def _(t):
    u = F.col("uuid")
    s = u.cast("string")
    asked = t.ledger.select(
        "uuid", F.when(u % 3 == 0, F.concat(F.lit("10.1/abc"), s)).when(u % 3 == 1, F.concat(F.lit("10.2/"), s, F.lit("zz"))).otherwise("10.9").alias("doi")
    )
    refs = t.ledger.select(
        F.concat(F.lit("k"), F.lpad(s, 8, "0")).alias("cite_key"),
        F.when(u % 2 == 0, F.concat(F.lit("10.1/abc"), s)).otherwise(F.concat(F.lit("https://doi.org/10.2/"), s, F.lit("zz#x"))).alias("doi"),
    )
    return joins.clean_lookup(asked, refs)


@query(
    "year_band_pairs",
    f"""SELECT a.work_id AS left_id, b.work_id AS right_id, a.year AS left_year, b.year AS right_year FROM works a JOIN works b
ON md5(a.abstract) = md5(b.abstract) AND abs(a.year - b.year) <= 1 AND a.work_id < b.work_id""",
)
def _(t):
    keyed = t.works.withColumn("abstract_key", md5(F.col("abstract")))
    return joins.year_band_pairs(keyed, 1, ["abstract_key"]).drop("abstract_key")


@query(
    "title_equivalence",
    f"""SELECT uuid, title_lib <> '' AND coalesce(title_auth, '') <> '' AND {_sql_equiv('a', 'b')} AS same,
  round(CASE WHEN c = d THEN 1.0 WHEN contains(c, d) OR contains(d, c) THEN 0.95 ELSE len(list_intersect(list_distinct(string_split(c, ' ')), list_distinct(string_split(d, ' ')))) / greatest(len(list_distinct(string_split(c, ' '))), len(list_distinct(string_split(d, ' ')))) END, 6) AS similarity
FROM (SELECT uuid, title_lib, title_auth, {_dt('title_lib')} AS a, {_dt('title_auth')} AS b, trim({re_all(re_all("lower(title_lib)", '[^a-z0-9\\s]', ''), '\\s+', ' ')}) AS c,
  trim({re_all(re_all("lower(coalesce(title_auth, ''))", '[^a-z0-9\\s]', ''), '\\s+', ' ')}) AS d FROM ledger)""",
)
def _(t):
    a, b = F.col("title_lib"), F.col("title_auth")
    return t.ledger.select("uuid", text.title_equiv(a, b).alias("same"), F.round(text.trial_title_similarity(a, b), 6).alias("similarity"))


def _registry(t):
    """Registry entries for the trial ids of two works in three; titles equal, cut, other or missing."""
    trials = textops.trial_ids(t.works, ["title"])
    title = F.when(F.col("work_id") % 5 == 0, F.lit("")).when(F.col("work_id") % 5 == 1, F.substring("title", 1, 30)).when(F.col("work_id") % 5 == 2, F.col("title")).otherwise("some other trial")
    return trials.join(t.works, "work_id").filter("work_id % 9 <> 0").select("trial_id", title.alias("brief_title"), F.lit(True).alias("in_registry"))


_TRIAL_SQL = """SELECT work_id, regexp_extract(title, 'NCT[0-9]{8}$') AS trial_id, CASE WHEN work_id % 9 = 0 THEN 'not_found' WHEN work_id % 5 IN (0, 1, 2) THEN 'verified' ELSE 'mismatch' END AS status,
  CAST(CASE WHEN work_id % 9 = 0 THEN 0.9 WHEN work_id % 5 = 0 THEN 0.8 WHEN work_id % 5 IN (1, 2) THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM works WHERE regexp_matches(title, 'NCT[0-9]{8}$')"""


@query("verify_trials", _TRIAL_SQL)
def _(t):
    return joins.verify_trials(textops.trial_ids(t.works, ["title"]), _registry(t), t.works)


@query("trial_lookup_status", f"SELECT status, count(*) AS n FROM ({_TRIAL_SQL}) GROUP BY status")
def _(t):
    checked = joins.verify_trials(textops.trial_ids(t.works, ["title"]), _registry(t), t.works)
    return checked.groupBy("status").agg(F.count("*").alias("n"))


_KEY = "coalesce(doi, concat_ws('-', title, source))"


def _keyed(t):
    return t.works.withColumn("record_key", text.record_id(F.lit(None).cast("string"), F.col("doi"), F.col("title"), F.col("source")))


@query("new_since", f"SELECT work_id FROM works WHERE year >= 2010 AND {_KEY} NOT IN (SELECT {_KEY} FROM works WHERE is_oa)")
def _(t):
    keyed = _keyed(t)
    return joins.new_since(keyed.filter("is_oa"), keyed, 2010).select("work_id")


_SESSION = """SELECT 'paper' AS kind, work_id AS paper_id, title FROM works WHERE {0} UNION ALL SELECT 'bookmark', work_id, NULL FROM works WHERE {0} AND citations > 500
UNION ALL SELECT 'exclusion', work_id, NULL FROM works WHERE {0} AND citations < 100 UNION ALL SELECT 'promotion', work_id, NULL FROM works WHERE {0} AND type = 'report'"""
_MINE, _THEIRS = _SESSION.format("year < 2015"), _SESSION.format("year > 2010")


@query(
    "reconcile_merge",
    f"""WITH c AS ({_MINE}), i AS ({_THEIRS})
SELECT kind, paper_id FROM c UNION ALL SELECT kind, paper_id FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.kind = i.kind AND c.paper_id = i.paper_id)""",
)
def _(t):
    return joins.reconcile(t.sql(_MINE), t.sql(_THEIRS), "merge").select("kind", "paper_id")


@query(
    "reconcile_stats",
    f"""WITH c AS ({_MINE}), i AS ({_THEIRS}) SELECT i.kind, count(*) AS total, count(*) FILTER (WHERE c.paper_id IS NULL) AS new, count(c.paper_id) AS existing
FROM i LEFT JOIN c ON c.kind = i.kind AND c.paper_id = i.paper_id GROUP BY i.kind""",
)
def _(t):
    return joins.reconcile_stats(t.sql(_MINE), t.sql(_THEIRS))


_FLAGS = """SELECT work_id + 7 AS paired_id, concat('p', source) AS paired_source, title AS paired_title FROM works WHERE type IS NULL
UNION ALL SELECT work_id AS paired_id, 'dup' AS paired_source, 'no such title' AS paired_title FROM works WHERE type = 'guideline'"""


@query(
    "source_records",
    f"""WITH f AS ({_FLAGS}) SELECT work_id AS paper_id, source, CAST(work_id AS STRING) AS source_id FROM works
UNION SELECT w.work_id, f.paired_source, CAST(f.paired_id AS STRING) FROM works w JOIN f ON f.paired_id = w.work_id OR f.paired_title = w.title""",
)
def _(t):
    return joins.source_records(t.works.select(F.col("work_id").alias("paper_id"), "source", "title"), t.sql(_FLAGS))


@query(
    "screening_subject",
    """SELECT s.paper_id, w.country, CASE WHEN regexp_matches(w.title, 'NCT[0-9]{8}') THEN regexp_extract(w.title, 'NCT[0-9]{8}') END AS trial_id,
  CASE WHEN w.country = 'de' THEN 0.9 ELSE 0.5 END::DOUBLE AS score FROM screening s JOIN works w ON s.paper_id = w.work_id""",
)
def _(t):
    trials = textops.trial_ids(t.works, ["title"])
    results = joins.verify_trials(trials, _registry(t), t.works)
    equity = t.works.filter("country = 'de'").select("work_id", F.lit(0.9).alias("adjusted_score"))
    out = joins.screening_subject(t.screening.withColumn("score", F.lit(0.5)), t.works, windows.primary_trial(trials), results, equity)
    return out.select("paper_id", "country", "trial_id", "score")


# --- Sets, order, pages ------------------------------------------------------------------


@query("union_sources", "SELECT work_id AS id, CASE WHEN country = 'en' THEN 'a' ELSE 'b' END AS source, CASE WHEN country = 'en' THEN title END AS title FROM works")
def _(t):
    rows = t.works.select(F.col("work_id").alias("id"), "title", (F.col("country") == "en").alias("en"))
    out, _errors = joins.union_sources({"a": rows.filter("en").drop("en"), "b": rows.filter("NOT en").drop("en", "title"), "c": TimeoutError("no answer")}, "id long, title string")
    return out.select("id", "source", "title")


@query("intersect_ids", "SELECT work_id AS id FROM works WHERE is_oa AND year > 2008 AND contains(lower(abstract), 'the')")
def _(t):
    ids = lambda cond: t.works.filter(cond).select(F.col("work_id").alias("id"))
    return joins.intersect_ids(ids("is_oa"), ids("year > 2008"), ids("contains(lower(abstract), 'the')"))


@query("except_ids", "SELECT work_id AS id FROM works WHERE is_oa AND NOT year > 2008")
def _(t):
    ids = lambda cond: t.works.filter(cond).select(F.col("work_id").alias("id"))
    return joins.except_ids(ids("is_oa"), ids("year > 2008"))


@query("page", "SELECT work_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM works) WHERE rn > 20 AND rn <= 30")
def _(t):
    return windows.page(t.works, 3, L.PAGE_SIZE).select("work_id", "source")


@query("page_plan", "SELECT source, count(*) AS hits, CAST(least(ceil(count(*) / 10.0), 4) AS BIGINT) AS pages, ceil(count(*) / 10.0) > 4 AS cut FROM works GROUP BY source")
def _(t):
    return windows.page_plan(t.works, L.PAGE_SIZE, 4)


@query("page_numbers", "SELECT work_id, row_number() OVER (PARTITION BY source ORDER BY seq) AS row_no FROM works")
def _(t):
    """Every row's place within its source, in chunks of arrival order."""
    return windows.numbered(t.works, ["source"], ["seq"], F.floor(F.col("seq") / 250)).select("work_id", "row_no")


@query("first_per_key", "SELECT work_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(doi) ORDER BY seq) AS rn FROM works) WHERE doi IS NULL OR rn = 1")
def _(t):
    return windows.first_per_key(t.works, [F.lower("doi")], ["seq"]).select("work_id")


@query("review_queue", "SELECT uuid, title_lib, year_lib <> year_auth AS needs_correction FROM ledger ORDER BY state = 'PATCHED' DESC, year_lib <> year_auth DESC, title_lib, uuid")
def _(t):
    marked = t.ledger.withColumn("manually_modified", F.col("state") == "PATCHED").withColumn("needs_correction", F.col("year_lib") != F.col("year_auth"))
    return ledger_ops.review_queue(marked).select("uuid", "title_lib", "needs_correction")


@query(
    "triage_split",
    "SELECT work_id, CASE WHEN regexp_matches(title, 'NCT[0-9]{8}') AND is_oa THEN 'verified' ELSE 'pending' END AS list FROM works",
)
def _(t):
    ids = windows.primary_trial(textops.trial_ids(t.works, ["title"])).select("work_id", "trial_id")
    pending, verified = ledger_ops.triage_split(t.works.join(ids, "work_id", "left").withColumn("trial_verified", F.col("is_oa")))
    return pending.select("work_id", F.lit("pending").alias("list")).unionByName(verified.select("work_id", F.lit("verified").alias("list")))


# --- Ranking and classification ----------------------------------------------------------

NOW = 2024


def _sql_tier() -> str:
    """Rows (peer, grey, kind, origin, confidence) by the strongest signal."""
    body = "lower(concat(coalesce(title, ''), ' ', coalesce(abstract, '')))"
    grey = "CASE " + " ".join(f"WHEN regexp_matches({body}, {lit(p)}) THEN {g}" for p, g in L.GREY_TEXT_PATTERNS) + " END"
    inst = " OR ".join(f"contains(lower(publisher), {lit(i)})" for i in L.INSTITUTIONS)
    return f"""SELECT work_id, CAST(CASE WHEN gt IS NOT NULL THEN 6 WHEN pt IS NOT NULL THEN pt ELSE 6 END AS INT) AS peer_tier,
  CAST(CASE WHEN pt IS NOT NULL THEN gt WHEN tg IS NOT NULL THEN tg WHEN inst THEN 3 END AS INT) AS grey_tier,
  CASE WHEN pt IS NOT NULL THEN type WHEN tg IS NOT NULL THEN 'inferred_from_text' WHEN inst THEN 'institutional_publication' ELSE 'unclassified' END AS document_type,
  CAST(CASE WHEN gt IS NOT NULL THEN 0.9 WHEN pt IS NOT NULL THEN 0.85 WHEN tg IS NOT NULL THEN 0.6 WHEN inst THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence
FROM (SELECT work_id, type, {sql_map(L.PUBLISHER_TYPE_TIERS, 'type')} AS pt, {sql_map(L.PUBLISHER_TYPE_GREY, 'type')} AS gt, {grey} AS tg, ({inst}) AS inst FROM works)"""


def tiered(works):
    return works.withColumn(
        "tier", scores.classify_tier(F.col("type"), None, F.col("title"), F.col("abstract"), F.col("publisher"))
    )


@query("classify_tier", _sql_tier())
def _(t):
    return tiered(t.works).select("work_id", "tier.peer_tier", "tier.grey_tier", "tier.document_type", "tier.confidence")


@query(
    "classify_index_types",
    """SELECT work_id, CAST(CASE work_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 6 END AS INT) AS peer_tier, CAST(CASE WHEN work_id % 4 = 0 THEN 1 END AS INT) AS grey_tier,
  CASE work_id % 4 WHEN 0 THEN 'Practice Guideline' WHEN 1 THEN 'Meta-Analysis' WHEN 2 THEN 'Review' ELSE 'Journal Article' END AS document_type,
  CAST(CASE WHEN work_id % 4 = 0 THEN 0.85 ELSE 0.8 END AS DOUBLE) AS confidence FROM works""",
)
def _(t):
    """Index types: a grey type first, else the best tier, the earliest type among equals."""
    lists = [["Journal Article", "Practice Guideline", "Meta-Analysis"], ["Clinical Trial", "Meta-Analysis"], ["Review", "Journal Article"], ["Unknown Kind"]]
    types = F.element_at(F.array(*[F.array(*[F.lit(x) for x in l]) for l in lists]), (F.col("work_id") % 4 + 1).cast("int"))
    tier = scores.classify_tier(F.lit(None).cast("string"), types, F.col("title"), F.col("abstract"), F.col("publisher"))
    return t.works.select("work_id", tier.alias("tier")).select("work_id", "tier.peer_tier", "tier.grey_tier", "tier.document_type", "tier.confidence")


@query(
    "tier_label",
    f"SELECT peer_tier, grey_tier, {sql_map(L.TIER_LABELS, 'peer_tier')} AS peer_label, {sql_map(L.GREY_LABELS, 'grey_tier')} AS grey_label, count(*) AS n FROM ({_sql_tier()}) GROUP BY ALL",
)
def _(t):
    flat = tiered(t.works).select("tier.peer_tier", "tier.grey_tier")
    return flat.groupBy("peer_tier", "grey_tier", scores.tier_label(F.col("peer_tier")).alias("peer_label"), scores.grey_label(F.col("grey_tier")).alias("grey_label")).agg(F.count("*").alias("n"))


_RECENCY = "CAST(CASE WHEN 2024 - year <= 1 THEN 1.0 WHEN 2024 - year <= 3 THEN 0.8 WHEN 2024 - year <= 5 THEN 0.6 WHEN 2024 - year <= 10 THEN 0.4 ELSE 0.2 END AS DOUBLE)"
_CITED = "CASE WHEN citations > 0 AND m > 0 THEN least(1.0, ln(1 + citations) / ln(1 + m)) ELSE 0.0 END"
_DESIGN = {"systematic-review": "systematic_review", "meta-analysis": "meta_analysis", "clinical-trial": "rct", "cohort-study": "cohort", "report": "review"}
_JOURNAL = "CASE {0} WHEN 0 THEN 'The Ocular Surface' WHEN 1 THEN 'BMJ Open' WHEN 2 THEN 'Cornea' WHEN 3 THEN '' ELSE 'Journal of Rivers' END"


def _sql_journal(e: str) -> str:
    low = f"lower(trim({e}))"
    return f"CAST(CASE WHEN {e} = '' THEN 0.0 " + " ".join(f"WHEN contains({low}, {lit(n)}) OR contains({lit(n)}, {low}) THEN {s}" for n, s in L.JOURNAL_SCORES) + " ELSE 0.0 END AS DOUBLE)"


@query("recency_score", f"SELECT work_id, {_RECENCY} AS score FROM works")
def _(t):
    return t.works.select("work_id", scores.recency_score(F.col("year"), NOW).alias("score"))


def cited(works):
    """Citation score against the largest count, which is one aggregated value."""
    most = works.agg(F.max("citations")).scalar()
    return works.withColumn("citation_impact", scores.citation_score(F.col("citations"), most))


@query("citation_score", f"SELECT work_id, round({_CITED}, 6) AS score FROM works, (SELECT max(citations) AS m FROM works)")
def _(t):
    return cited(t.works).select("work_id", F.round("citation_impact", 6).alias("score"))


@query("journal_score", f"SELECT work_id, {_sql_journal(_JOURNAL.format('work_id % 5'))} AS score FROM works")
def _(t):
    name = F.element_at(F.array(*[F.lit(x) for x in ["The Ocular Surface", "BMJ Open", "Cornea", "", "Journal of Rivers"]]), (F.col("work_id") % 5 + 1).cast("int"))
    return t.works.select("work_id", scores.journal_score(name).alias("score"))


@query("design_score", f"SELECT work_id, CAST({sql_map({k: L.DESIGN_SCORES[v] for k, v in _DESIGN.items()}, 'type', '0.2')} AS DOUBLE) AS score FROM works")
def _(t):
    return t.works.select("work_id", scores.design_score(scores.lookup(_DESIGN, F.col("type"))).alias("score"))


_COUNTRY = {"en": "GB", "fr": "my", "de": "XX", "es": "IN"}


@query("geo_score", "SELECT work_id, CAST(CASE country WHEN 'en' THEN 0.4 WHEN 'fr' THEN 1.0 WHEN 'es' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS score FROM works")
def _(t):
    return t.works.select("work_id", scores.geo_score(scores.lookup(_COUNTRY, F.col("country"))).alias("score"))


def open_score():
    license_ = F.when(F.col("work_id") % 4 == 0, "CC-BY 4.0")
    signals = scores.openness_signals(F.col("is_oa"), F.col("doi"), F.col("title"), F.col("abstract"), license_)
    bad = filters.predatory_match(L.PREDATORY_SAMPLE, F.col("doi"), F.col("publisher"), F.lit(None).cast("string")).isNotNull()
    return scores.openness(signals, bad)


@query(
    "openness",
    """SELECT work_id, round(CASE WHEN publisher = 'Sample Bad Press' THEN greatest(-2.0, s * -2.0) ELSE least(1.0, s) END, 6) AS score FROM (SELECT work_id, publisher,
  CAST(CASE WHEN is_oa THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(title, '(?i)code\\s+(available|at|on|in)') OR regexp_matches(abstract, '(?i)code\\s+(available|at|on|in)\\s+(github|gitlab|bitbucket)') THEN 0.25 ELSE 0 END
  + CASE WHEN regexp_matches(title, '(?i)data\\s+(available|at|on|in|set)') OR regexp_matches(abstract, '(?i)data\\s+(available|at|on|in)\\s+(figshare|dryad|zenodo)') THEN 0.20 ELSE 0 END
  + CASE WHEN work_id % 4 = 0 THEN 0.10 ELSE 0 END + CASE WHEN doi IS NOT NULL THEN 0.10 ELSE 0 END AS DOUBLE) AS s FROM works)""",
)
def _(t):
    return t.works.select("work_id", F.round(open_score(), 6).alias("score"))


def scored(works, mode: str = "systematic_review"):
    """Composite score of each work; the dimensions nothing computes are inputs and count 0 here."""
    zero = F.lit(0.0)
    dims = {
        "relevance": zero, "semantic_similarity": zero, "keyword_match": zero, "journal_quality": zero,
        "peer_review": F.when(F.col("type").isNotNull(), 1.0).otherwise(0.0),
        "study_design": scores.design_score(scores.lookup(_DESIGN, F.col("type"))),
        "citation_impact": F.col("citation_impact"),
        "recency": scores.recency_score(F.col("year"), NOW),
        "oa_availability": F.when(F.col("is_oa"), 1.0).otherwise(0.0),
    }
    return cited(works).withColumn("score", scores.composite(dims, L.MODE_WEIGHTS[mode]))


def sql_composite(mode: str, source: str = "works") -> str:
    w = L.MODE_WEIGHTS[mode]
    design = f"CAST({sql_map({k: L.DESIGN_SCORES[v] for k, v in _DESIGN.items()}, 'type', '0.2')} AS DOUBLE)"
    total = f"(CASE WHEN type IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * {w['peer_review']}::DOUBLE + {design} * {w['study_design']}::DOUBLE + ({_CITED}) * {w['citation_impact']}::DOUBLE + {_RECENCY} * {w['recency']}::DOUBLE + (CASE WHEN is_oa THEN 1.0 ELSE 0.0 END)::DOUBLE * {w['oa_availability']}::DOUBLE"
    return f"SELECT {source}.*, floor(({total}) * 1000 + 0.5) / 1000.0 AS score FROM {source}, (SELECT max(citations) AS m FROM {source})"


for _mode in L.MODE_WEIGHTS:

    @query(f"composite_{_mode}", f"SELECT work_id, round(score, 3) AS score FROM ({sql_composite(_mode)})")
    def _(t, mode=_mode):
        return scored(t.works, mode).select("work_id", F.round("score", 3).alias("score"))


@query("top_k", f"SELECT work_id, round(score, 3) AS score FROM ({sql_composite('clinical')}) ORDER BY score DESC, seq LIMIT {L.MAX_RESULTS}")
def _(t):
    return windows.top_k(scored(t.works, "clinical"), L.MAX_RESULTS, [F.desc("score"), F.col("seq")]).select("work_id", F.round("score", 3).alias("score"))


@query(
    "top_k_per_source",
    f"SELECT work_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, seq) AS rn FROM ({sql_composite('clinical')})) WHERE rn <= 5",
)
def _(t):
    return windows.top_k(scored(t.works, "clinical"), 5, [F.desc("score"), F.col("seq")], ["source"]).select("work_id", "source")


_FROZEN = scores.freeze_weights(L.MODE_WEIGHTS["evidence"], ["crossref", "pubmed"])


# two sources take relevance, keywords, citations and journal out; peer review 0.15 and recency 0.05 are left of 0.5
@query(
    "freeze_weights",
    f"""SELECT work_id, round(floor(((CASE WHEN type IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.3::DOUBLE + {_RECENCY} * 0.1::DOUBLE) * 1000 + 0.5) / 1000.0, 3) AS score FROM works""",
)
def _(t):
    """Composite under weights frozen while two sources are degraded."""
    dims = dict.fromkeys(L.DIMENSIONS, F.lit(0.0)) | {
        "peer_review": F.when(F.col("type").isNotNull(), 1.0).otherwise(0.0),
        "recency": scores.recency_score(F.col("year"), NOW), "citation_impact": F.lit(1.0),
    }
    return t.works.select("work_id", F.round(scores.composite(dims, _FROZEN), 3).alias("score"))


@query(
    "retraction_penalty",
    "SELECT work_id, round(CASE work_id % 6 WHEN 0 THEN citations * 0.01 WHEN 1 THEN citations * 0.3 WHEN 2 THEN citations * 0.9 ELSE citations END::DOUBLE, 4) AS score FROM works",
)
def _(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ["retraction", "expression_of_concern", "correction", "other"]]), F.least(F.col("work_id") % 6 + 1, F.lit(4)).cast("int"))
    out = scores.retraction_penalty(F.col("citations").cast("double"), F.col("work_id") % 6 < 4, kind)
    return t.works.select("work_id", F.round(out, 4).alias("score"))


@query(
    "equity_override",
    """SELECT work_id, round(CASE WHEN hit THEN (0.2 / 0.3) / tot ELSE 0.2 END, 6) AS citation_impact, round(CASE WHEN hit THEN 0.3 * 1.3 / tot ELSE 0.3 END, 6) AS keyword_match, hit AS applied,
  CASE WHEN NOT hit THEN 'No override needed' WHEN country = 'fr' THEN 'Equity override: MY, same-region:MY — ' ELSE 'Equity override: IN — ' END
  || CASE WHEN NOT hit THEN '' WHEN work_id % 4 = 1 THEN 'unverified regional trial with local registry' ELSE 'region-matched evidence boost' END AS reason
FROM (SELECT work_id, country, country IN ('fr', 'es') AND NOT is_oa AS hit, (0.2 / 0.3 + 0.3 * 1.3 + 0.1 / 0.2 + 0.4 * 1.2)::DOUBLE AS tot FROM works)""",
)
def _(t):
    base = {"citation_impact": 0.2, "keyword_match": 0.3, "journal_quality": 0.1, "recency": 0.4}
    out = scores.equity_override(
        scores.literal_map(base), F.when(F.col("country") == "fr", "MY").otherwise(scores.lookup(_COUNTRY, F.col("country"))), F.col("is_oa"), F.col("work_id") % 4 == 1, "MY"
    )
    shown = t.works.select("work_id", out.alias("o"))
    return shown.select(
        "work_id", F.round(F.col("o.scores")["citation_impact"], 6).alias("citation_impact"), F.round(F.col("o.scores")["keyword_match"], 6).alias("keyword_match"),
        F.col("o.applied").alias("applied"), F.col("o.reason").alias("reason"),
    )
