"""Catalogue: sources, sinks and record normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import text
from ..operators import filters, joins, ledger as ledger_ops, textops
from ..sources import readers, writers
from .registry import lit, listed, query, re_all, sql_author, sql_doi, sql_hash, sql_surname, sql_title, sql_trim


def md5(c):
    return F.md5(c.cast("binary"))


# --- Sources ---------------------------------------------------------------------------


@query(
    "source_json_general",
    """SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, CAST(2000 + doc_id % 25 AS INT) AS year,
       CASE WHEN doc_id % 2 = 0 THEN concat('10.1/a', CAST(doc_id AS STRING)) END AS doi, 'Anna Lee' AS first_author,
       CAST(n_chars AS BIGINT) AS citations, doc_id % 3 = 0 AS is_oa, lang AS type FROM documents""",
)
def _(t):
    """Mixed spellings of one record, one JSON text per row, through the general field map."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    year = (F.lit(2000) + F.col("doc_id") % 25).cast("int")
    doi = F.concat(F.lit("10.1/a"), F.col("doc_id").cast("string"))
    spelled = F.when(
        F.col("doc_id") % 2 == 0,
        F.to_json(F.struct(
            title.alias("title"), year.cast("string").alias("year"), doi.alias("DOI"),
            F.array(F.struct(F.lit("Anna Lee").alias("name"))).alias("authors"), F.col("n_chars").alias("cited_by_count"),
            (F.col("doc_id") % 3 == 0).alias("is_oa"), F.col("lang").alias("type"),
        )),
    ).otherwise(
        F.to_json(F.struct(
            F.array(title).alias("title"), F.struct(F.array(F.array(year, F.lit(5))).alias("date-parts")).alias("published"),
            F.array(F.struct(F.lit("Anna").alias("given"), F.lit("Lee").alias("family"))).alias("author"),
            F.col("n_chars").alias("citationCount"), F.struct((F.col("doc_id") % 3 == 0).alias("is_oa")).alias("open_access"),
            F.col("lang").alias("publicationType"),
        )),
    )
    raw = t.documents.select(F.col("doc_id").alias("seq"), spelled.alias("value"))
    return readers.normalize_records(raw, "openalex").select("seq", "title", "year", "doi", "first_author", "citations", "is_oa", "type")


@query(
    "source_json_by_source",
    """SELECT doc_id AS seq, s.source, split_part(text, chr(10), 1) AS title, CAST(2000 + doc_id % 25 AS INT) AS year,
       concat('10.2/b', CAST(doc_id AS STRING)) AS doi, lang AS journal,
       CASE s.source WHEN 'doaj' THEN true WHEN 'eric' THEN doc_id % 2 = 0 WHEN 'core' THEN doc_id % 2 = 0 ELSE false END AS is_oa,
       CASE WHEN s.source = 'eric' THEN doc_id % 4 = 1 ELSE false END AS peer_reviewed
FROM documents, (VALUES ('core'), ('doaj'), ('eric'), ('scopus')) s(source)""",
)
def _(t):
    """The four source-specific field maps over records spelled as each source does."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    year = (F.lit(2000) + F.col("doc_id") % 25).cast("int")
    doi = F.concat(F.lit("10.2/b"), F.col("doc_id").cast("string"))
    even = F.col("doc_id") % 2 == 0
    bodies = {
        "core": F.struct(title.alias("title"), year.alias("yearPublished"), doi.alias("doi"), F.struct(F.col("lang").alias("name")).alias("journal"), even.alias("openAccess")),
        "doaj": F.struct(
            title.alias("title"), year.cast("string").alias("year"), F.struct(F.col("lang").alias("title")).alias("journal"),
            F.array(F.struct(F.lit("eissn").alias("type"), F.lit("1").alias("id")), F.struct(F.lit("doi").alias("type"), doi.alias("id"))).alias("identifier"),
        ),
        "eric": F.struct(
            F.array(title).alias("title"), F.array(year.cast("string")).alias("publicationyear"), F.array(doi).alias("doi"), F.array("lang").alias("source"),
            F.when(~even, F.array(F.when(F.col("doc_id") % 4 == 1, "Y").otherwise("N"))).alias("peerreviewed"),
        ),
        "scopus": F.struct(
            title.alias("dc:title"), F.concat(year.cast("string"), F.lit("-03-01")).alias("prism:coverDate"), doi.alias("prism:doi"), F.col("lang").alias("prism:publicationName"),
        ),
    }
    frames = [
        readers.normalize_records(t.documents.select(F.col("doc_id").alias("seq"), F.to_json(b).alias("value")), s)
        for s, b in bodies.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("seq", "source", "title", "year", "doi", "journal", "is_oa", "peer_reviewed")


@query(
    "bibtex_entries",
    f"""SELECT concat('k', CAST(doc_id AS STRING)) AS cite_key, 'article' AS entry_type,
       trim({re_all('split_part(text, chr(10), 1)', '[{}]', '')}) AS title,
       CASE WHEN doc_id % 2 = 0 THEN 'Müller A, Lee W' ELSE 'Smith' END AS authors_normalized,
       CAST(2000 + doc_id % 25 AS INT) AS year_normalized,
       CASE doc_id % 3 WHEN 0 THEN '10.5/x' WHEN 1 THEN concat('10.7/', CAST(doc_id AS STRING)) ELSE '' END AS doi
FROM documents""",
)
def _(t):
    """Entries rendered from the documents and parsed back."""
    title = F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[{}]", ""))
    year = (F.lit(2000) + F.col("doc_id") % 25).cast("string")
    entry = F.concat(
        F.lit("@Article{k"), F.col("doc_id").cast("string"), F.lit(",\n  title = {"), title, F.lit("},\n  author = {"),
        F.when(F.col("doc_id") % 2 == 0, "Müller, Anna and Wei Lee").otherwise("Smith"), F.lit("},\n  "),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("year = {"), year)).otherwise(F.concat(F.lit("date = {"), year, F.lit("-01-02"))), F.lit("}"),
        F.when(F.col("doc_id") % 3 == 0, ",\n  doi = {10.5/x}")
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit(",\n  url = {https://doi.org/10.7/"), F.col("doc_id").cast("string"), F.lit("}")))
        .otherwise(""),
    )
    parsed = readers.parse_bibtex(t.documents.select(entry.alias("value")))
    return parsed.select("cite_key", "entry_type", "title", "authors_normalized", "year_normalized", "doi")


def _flat(e: str) -> str:
    return re_all(e, "\\r?\\n", " ")


@query(
    "ris_round_trip",
    f"""SELECT work_id, trim({_flat('title')}) AS title, first_author AS author, year, coalesce({sql_doi('doi')}, '') AS doi, publisher FROM works""",
)
def _(t):
    """Works to RIS text and back."""
    ris = writers.to_ris(t.works, "client")
    back = readers.parse_ris(ris)
    return back.select("work_id", "title", F.get("authors", F.lit(0)).alias("author"), "year", F.coalesce("doi", F.lit("")).alias("doi"), "publisher")


@query(
    "ris_records",
    f"""SELECT work_id, md5(concat_ws(chr(10), concat('TY  - ', CASE WHEN contains(lower(coalesce(type, 'JOUR')), 'journal') THEN 'JOUR' ELSE 'JOUR' END),
       CASE WHEN title <> '' THEN concat('TI  - ', title) END, concat('AU  - ', first_author), concat('PY  - ', CAST(year AS STRING)),
       CASE WHEN doi IS NOT NULL THEN concat('DO  - ', doi) END, CASE WHEN abstract <> '' THEN concat('AB  - ', abstract) END, concat('PB  - ', publisher), 'ER  - ')) AS ris_md5
FROM works""",
)
def _(t):
    return writers.to_ris(t.works).select("work_id", md5(F.col("value")).alias("ris_md5"))


@query(
    "csv_export",
    f"""SELECT work_id, md5(concat_ws(',', {", ".join(
        "concat(chr(34), replace(" + e + ", chr(34), concat(chr(34), chr(34))), chr(34))" if e != "CAST(year AS STRING)" else e
        for e in ["replace(title, chr(10), ' ')", "first_author", "CAST(year AS STRING)", "''", "coalesce(doi, '')", "coalesce(type, '')", "replace(abstract, chr(10), ' ')", "''", "source"]
    )})) AS line_md5 FROM works""",
)
def _(t):
    rows = writers.to_csv(t.works)
    return rows.select("work_id", md5(writers.csv_line(rows)).alias("line_md5"))


@query(
    "review_csv",
    """SELECT CAST(uuid AS STRING) AS uuid, CAST(0 AS INT) AS approved, title_lib, coalesce(title_auth, '') AS title_auth, CAST(year_lib AS STRING) AS year_lib,
       CAST(year_lib <> year_auth AS INT) AS needs_correction FROM ledger WHERE state = 'DIFFED'""",
)
def _(t):
    marked = t.ledger.withColumn("needs_correction", F.col("year_lib") != F.col("year_auth")).withColumn("correction_json", F.lit(None).cast("string"))
    return writers.to_review_csv(marked).select("uuid", "approved", "title_lib", "title_auth", "year_lib", "needs_correction")


@query(
    "json_export",
    """SELECT work_id, title, CAST(year AS STRING) AS year, coalesce(doi, '') AS doi, coalesce(type, '') AS kind, (SELECT count(*) FROM works) AS papers FROM works""",
)
def _(t):
    header, rows = writers.to_json_export(t.works, "2024-02-01T00:00:00Z", "partial sources")
    field = lambda n: F.get_json_object("value", f"$.{n}")
    count = header.select(F.get_json_object("value", "$.count").cast("long")).scalar()
    return rows.select(
        "work_id", field("title").alias("title"), field("year").alias("year"), F.coalesce(field("doi"), F.lit("")).alias("doi"),
        field("publicationType").alias("kind"), count.alias("papers"),
    )


@query(
    "append_first_wins",
    """WITH stored AS (SELECT DISTINCT search_id, source, page FROM calls WHERE ts < CAST('2024-01-10' AS TIMESTAMP)),
first AS (SELECT *, row_number() OVER (PARTITION BY search_id, source, page ORDER BY ts, event_id) AS rn FROM calls WHERE ts >= CAST('2024-01-10' AS TIMESTAMP))
SELECT f.event_id, f.search_id, f.source, f.page FROM first f LEFT JOIN stored s ON f.search_id = s.search_id AND f.source = s.source AND f.page = s.page
WHERE f.rn = 1 AND s.search_id IS NULL""",
)
def _(t):
    split = F.lit("2024-01-10").cast("timestamp")
    new = joins.append_first_wins(
        t.calls.filter(F.col("ts") < split), t.calls.filter(F.col("ts") >= split), ["search_id", "source", "page"], ["ts", "event_id"]
    )
    return new.select("event_id", "search_id", "source", "page")


@query(
    "reviewed_rows",
    f"""SELECT CAST(uuid AS STRING) AS uuid, state IN ('APPROVED', 'PATCHED', 'FETCHED') AS approved, '' AS reviewer_notes FROM ledger""",
)
def _(t):
    """Approvals read back from a review table, marks spelled as people spell them."""
    mark = F.when(F.col("state") == "APPROVED", " yes").when(F.col("state") == "PATCHED", "1").when(F.col("state") == "FETCHED", "TRUE").otherwise("0")
    rows = t.ledger.select(F.concat(F.lit(" "), F.col("uuid").cast("string")).alias("uuid"), mark.alias("approved"), F.lit(None).cast("string").alias("reviewer_notes"))
    return readers.reviewed_rows(rows)


_HEX = "md5(CAST({} AS STRING))"
_UUID_SQL = lambda e: "concat_ws('-', " + ", ".join(f"substr({e}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


@query(
    "citation_ids",
    f"""SELECT doc_id, {_UUID_SQL("md5(CAST(doc_id AS STRING))")} AS uuid FROM documents
UNION SELECT doc_id, {_UUID_SQL("md5(concat('x', CAST(doc_id AS STRING)))")} FROM documents
UNION SELECT doc_id, {_UUID_SQL("md5(concat('y', CAST(doc_id AS STRING)))")} FROM documents""",
)
def _(t):
    """Ids in plain attributes and in base64 citation tags of XML made from the documents."""
    uuid = lambda c: F.concat_ws("-", *[F.substring(F.md5(c.cast("binary")), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    key = F.col("doc_id").cast("string")
    a, b, c = uuid(key), uuid(F.concat(F.lit("x"), key)), uuid(F.concat(F.lit("y"), key))
    body = F.to_json(F.struct(F.concat(F.lit("ACME_CITATION_"), b).alias("citationID"), F.array(F.struct(b.alias("id"), F.struct(c.alias("id")).alias("itemData"))).alias("citationItems")))
    tag = F.regexp_replace(F.base64(body.cast("binary")), r"[\s=]", "")
    xml = F.concat(F.lit('<w:p>{"id": "'), a, F.lit('"} <w:tag w:val="ACME_CITATION_v3_v1_'), tag, F.lit('"/>'), F.col("text"), F.lit("</w:p>"))
    return readers.extract_citation_ids(t.documents.select("doc_id", xml.alias("xml")))


@query("file_inventory")
def _(t):
    """Files of the data folder itself, by the evidence ladder."""
    return readers.duplicate_files(t.spark, t.folder).select("name", "type", "length", "verdict")


@query(
    "export_audit",
    """WITH req AS (SELECT search_id, m.mode, f.format, count(*) AS result_count, max(CASE WHEN source IN ('s0', 's1') AND status = 'error' THEN 1 ELSE 0 END) AS bad
  FROM calls, (VALUES ('evidence'), ('systematic_review'), ('discovery')) m(mode), (VALUES ('ris'), ('csv'), ('json'), ('pdf')) f(format) GROUP BY ALL)
SELECT search_id, format, CASE WHEN ok THEN 'complete' ELSE 'blocked' END AS status, watermarked, CASE WHEN ok THEN result_count ELSE 0 END AS result_count
FROM (SELECT *, NOT (bad = 1 AND (mode = 'systematic_review' OR (mode = 'evidence' AND format IN ('ris', 'csv')))) AS ok, bad = 1 AND mode = 'evidence' AS watermarked FROM req)""",
)
def _(t):
    requests = _export_requests(t)
    decisions = filters.export_gate(_named_sources(t), requests.select("search_id", "mode", "format"))
    audit = writers.export_audit(requests, decisions)
    return audit.select("search_id", "format", "status", "watermarked", "result_count")


def _named_sources(t):
    name = F.when(F.col("source") == "s0", "pubmed").when(F.col("source") == "s1", "scopus").otherwise(F.col("source"))
    return t.calls.withColumn("source", name)


def _export_requests(t):
    per_search = t.calls.groupBy("search_id").agg(F.count("*").alias("result_count"), F.max("ts").alias("created_at"))
    each = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    return per_search.select("*", each("mode", ["evidence", "systematic_review", "discovery"])).select("*", each("format", ["ris", "csv", "json", "pdf"]))


# --- Normalising functions ---------------------------------------------------------------


@query("norm_title", f"SELECT work_id, {sql_title('title')} AS norm FROM works")
def _(t):
    return t.works.select("work_id", text.norm_title(F.col("title")).alias("norm"))


@query("norm_author", f"SELECT work_id, {sql_author('first_author')} AS author, {sql_surname('first_author')} AS surname FROM works")
def _(t):
    return t.works.select("work_id", text.norm_author(F.col("first_author")).alias("author"), text.surname(F.col("first_author")).alias("surname"))


@query("norm_doi", f"SELECT seq, {sql_doi('doi_any')} AS doi FROM works_raw")
def _(t):
    return t.works_raw.select("seq", text.norm_doi(F.col("doi_any")).alias("doi"))


@query("dedup_hash", f"SELECT work_id, {sql_hash()} AS dedup_hash, sha256({sql_doi('doi')}) AS doi_hash FROM works")
def _(t):
    return t.works.select(
        "work_id", text.dedup_hash(F.col("title"), F.col("year"), F.col("first_author")).alias("dedup_hash"), text.doi_hash(F.col("doi")).alias("doi_hash")
    )


_YEAR = "coalesce(TRY_CAST(year_str AS INT), publication_year, TRY_CAST(nullif(regexp_extract(sortpubdate, '(\\d{4})', 1), '') AS INT))"


@query("extract_year", f"SELECT seq, {_YEAR} AS year FROM works_raw")
def _(t):
    year = text.extract_year(text.leading_int(F.col("year_str")), F.col("publication_year"), text.year_in(F.col("sortpubdate")))
    return t.works_raw.select("seq", year.alias("year"))


@query("inverted_abstract", f"SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, {sql_title('text')} AS text FROM documents)")
def _(t):
    """Texts turned into {word: positions} and back."""
    words = t.documents.select("doc_id", F.split(text.norm_title(F.col("text")), " ").alias("words"))
    inverted = words.select("doc_id", text.inverted_abstract(F.col("words")).alias("inverted"))
    return inverted.select("doc_id", md5(text.decode_inverted_abstract(F.col("inverted"))).alias("text_md5"))


@query("strip_markup", f"SELECT page_id, md5({sql_trim(re_all('html', '<[^>]*>', ''))}) AS text_md5 FROM pages")
def _(t):
    return t.pages.select("page_id", md5(text.strip_markup(F.col("html"))).alias("text_md5"))


@query(
    "normalize_works",
    f"SELECT seq, source, coalesce(nullif(title, ''), title_alt) AS title, {_YEAR} AS year, {sql_doi('doi_any')} AS doi FROM works_raw",
)
def _(t):
    return readers.normalize_works(t.works_raw)


@query("compact", "SELECT work_id, source, title, year, doi FROM works")
def _(t):
    return readers.compact(t.works).select("work_id", "source", "title", "year", "doi")


@query("watermark_missing", "SELECT work_id, 'cr_license,cr_references,pm_abstract,pm_mesh' AS missing FROM works")
def _(t):
    marked = filters.watermark_missing(t.works, ["crossref", "pubmed"])
    return marked.select("work_id", F.array_join(F.array_sort(F.map_keys("watermarks")), ",").alias("missing"))


@query(
    "authors_bib",
    """SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'Lee W' WHEN 1 THEN 'van Gogh V' ELSE 'Plato' END, ', ', 'Author', ' ', upper(substr(lang, 1, 1))) AS authors,
       CASE doc_id % 3 WHEN 0 THEN 'Wei|Lee' WHEN 1 THEN 'Vincent|Gogh' ELSE '|Plato' END AS first_name_last FROM documents""",
)
def _(t):
    """BibTeX author lists to short names, and comma lists to first and last names."""
    case = lambda a, b, c: F.when(F.col("doc_id") % 3 == 0, a).when(F.col("doc_id") % 3 == 1, b).otherwise(c)
    bib = F.concat(case("Lee, Wei", "van Gogh, Vincent", "Plato"), F.lit(" and "), F.col("lang"), F.lit(" Author"))
    people = text.format_authors(F.concat(case("Wei Lee", "Vincent Gogh", "Plato"), F.lit(", "), F.col("lang")))
    return t.documents.select(
        "doc_id", text.norm_authors_bib(bib).alias("authors"),
        F.concat_ws("|", F.get(people, F.lit(0))["first_name"], F.get(people, F.lit(0))["last_name"]).alias("first_name_last"),
    )


def _sql_sanitize(e: str) -> str:
    out = f"coalesce({e}, '')"
    for pattern, to in L.SANITIZE_STEPS:
        out = re_all(out, pattern, to) if "\n" not in to else f"regexp_replace({out}, {lit(pattern)}, concat(chr(10), chr(10)), 'g')"
    return sql_trim(out)


@query(
    "sanitize_chat",
    f"""SELECT conv_id, turn, md5(clean) AS clean_md5, regexp_matches(clean, {lit(L.INJECTION_PATTERN)}) AS flagged,
       md5(regexp_replace(clean, {lit(L.INJECTION_PATTERN)}, '[REDACTED]', 'g')) AS redacted_md5 FROM (SELECT conv_id, turn, {_sql_sanitize('text')} AS clean FROM chat)""",
)
def _(t):
    clean = t.chat.select("conv_id", "turn", text.sanitize_text(F.col("text")).alias("clean"))
    return clean.select(
        "conv_id", "turn", md5(F.col("clean")).alias("clean_md5"), text.flag_injection(F.col("clean")).alias("flagged"),
        md5(text.redact_injection(F.col("clean"))).alias("redacted_md5"),
    )


@query("sanitize_documents", f"SELECT doc_id, md5({_sql_sanitize('text')}) AS clean_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", md5(text.sanitize_text(F.col("text"))).alias("clean_md5"))


@query(
    "service_payloads",
    """SELECT work_id, title, CASE WHEN work_id % 2 = 0 THEN 'Lee W, Plato' ELSE '' END AS authors, year, source AS journal, coalesce(doi, '') AS doi, 'crossref' AS service FROM works
UNION ALL SELECT work_id, title, 'Lee W, Plato', year, source, coalesce(doi, ''), 'library' FROM works""",
)
def _(t):
    """Payloads of the two metadata services, built from the works and read back."""
    people = lambda last, first: F.array(F.struct(F.lit("Wei").alias(first), F.lit("Lee").alias(last)), F.struct(F.lit(None).cast("string").alias(first), F.lit("Plato").alias(last)))
    date = F.struct(F.array(F.array("year", F.lit(1))).alias("date-parts"))
    remote = F.to_json(F.struct(
        F.array("title").alias("title"), F.when(F.col("work_id") % 2 == 0, people("family", "given")).alias("author"), date.alias("published-print"),
        F.array("source").alias("container-title"), F.col("doi").alias("DOI"),
    ))
    local = F.to_json(F.struct("title", people("last_name", "first_name").alias("authors"), "year", "source", F.struct("doi").alias("identifiers")))
    cols = ["work_id", "title", "authors", "year", "journal", "doi"]
    a = readers.crossref_fields(t.works.select("work_id", remote.alias("payload"))).select(*cols, F.lit("crossref").alias("service"))
    b = readers.library_fields(t.works.select("work_id", local.alias("payload"))).select(*cols, F.lit("library").alias("service"))
    return a.unionByName(b)


@query("record_id", "SELECT work_id, coalesce(doi, concat_ws('-', title, source)) AS record_key FROM works")
def _(t):
    key = text.record_id(F.lit(None).cast("string"), F.col("doi"), F.col("title"), F.col("source"))
    return t.works.select("work_id", key.alias("record_key"))


FINGERPRINT_SPEC = filters.all_of("the", filters.any_of("and", "for"))


@query(
    "query_fingerprint",
    f"""WITH facts AS (SELECT (SELECT count(*) FROM works) AS cardinality,
  (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT {sql_doi('doi')} AS d FROM works WHERE doi IS NOT NULL ORDER BY d LIMIT 3)) AS top_dois)
SELECT {lit(textops.spec_shape(FINGERPRINT_SPEC))} AS shape, cardinality, top_dois,
  sha256(concat_ws('|', {lit(textops.spec_shape(FINGERPRINT_SPEC))}, 'core,openalex', 'MY', CAST(cardinality AS STRING), top_dois)) AS fingerprint FROM facts""",
)
def _(t):
    return textops.query_fingerprint(t.works, FINGERPRINT_SPEC, ["openalex", "core"], "my")
