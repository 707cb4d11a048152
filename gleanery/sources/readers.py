"""Readers: landed bibliographic files to tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import text

# --- JSON records of the bibliographic sources ----------------------------------------


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _first(v: str, *paths: str, kind: str = "string") -> Column:
    """First non-null among paths; each may hold a scalar or an array of scalars."""
    tries = []
    for p in paths:
        tries += [_get(v, p + "[0]", kind), _get(v, p, kind)]
    return F.coalesce(*tries)


def _name(a: Column) -> Column:
    g = lambda path: F.try_variant_get(a, path, "string")
    return F.coalesce(
        g("$.name"), g("$.display_name"), g("$.author.display_name"),
        F.when(g("$.given").isNotNull() & g("$.family").isNotNull(), F.concat_ws(" ", g("$.given"), g("$.family"))),
        g("$.Name"), F.when(F.schema_of_variant(a) == "STRING", g("$")), F.lit("Unknown"),
    )


def _names(*paths: str) -> Column:
    arrays = [_get("v", p, "array<variant>") for p in paths]
    return F.transform(F.coalesce(*arrays, F.array().cast("array<variant>")), _name)


def _year() -> Column:
    number = lambda p: _get("v", p, "int")
    words = lambda p: text.year_in(_get("v", p))
    return text.extract_year(
        number("$.year"), text.leading_int(_get("v", "$.year")), number("$.publication_year"), number("$.pubYear"),
        *[number(f"$['{k}']['date-parts'][0][0]") for k in ("published", "published_print", "published-print", "published-online")],
        words("$.sortpubdate"), words("$.pubdate"),
    )


def _abstract() -> Column:
    plain = F.when(F.schema_of_variant(_get("v", "$.abstract", "variant")) == "STRING", _get("v", "$.abstract"))
    inverted = F.coalesce(
        _get("v", "$.abstract_inverted_index", "map<string,array<int>>"), _get("v", "$.abstract", "map<string,array<int>>")
    )
    return F.coalesce(plain, F.when(inverted.isNotNull(), text.decode_inverted_abstract(inverted)))


def _general() -> dict[str, Column]:
    return {
        "title": _first("v", "$.title", "$.Title"),
        "authors": _names("$.authors", "$.authorships", "$.author"),
        "year": _year(),
        "doi": F.coalesce(_get("v", "$.DOI"), _get("v", "$.doi"), _get("v", "$.externalIds.DOI")),
        "journal": F.coalesce(_get("v", "$.source"), _first("v", "$.container_title", "$.containerTitle"), F.lit("")),
        "abstract": _abstract(),
        "citations": F.coalesce(*[_get("v", f"$.{k}", "long") for k in ("cited_by_count", "citationCount", "is_referenced_by_count")], F.lit(0)),
        "is_oa": F.coalesce(
            _get("v", "$.is_oa", "boolean"),
            F.when(_get("v", "$.openAccessPdf", "variant").isNotNull() & ~F.is_variant_null(_get("v", "$.openAccessPdf", "variant")), True),
            _get("v", "$.open_access.is_oa", "boolean"), F.lit(False),
        ),
        "full_text_url": F.coalesce(_get("v", "$.openAccessPdf.url"), _get("v", "$.best_oa_location.pdf_url")),
        "type": F.coalesce(_get("v", "$.type"), _get("v", "$.publicationType")),
        "publisher": _get("v", "$.publisher"),
        "pmid": F.coalesce(_get("v", "$.uid"), _get("v", "$.pmid")),
    }


def _core() -> dict[str, Column]:
    return _general() | {
        "authors": _names("$.authors"),
        "year": F.coalesce(_get("v", "$.yearPublished", "int"), _get("v", "$.createdYear", "int")),
        "doi": _get("v", "$.doi"),
        "journal": _get("v", "$.journal.name"),
        "citations": F.coalesce(_get("v", "$.citationCount", "long"), F.lit(0)),
        "is_oa": F.coalesce(_get("v", "$.openAccess", "boolean"), F.lit(False)),
        "full_text_url": F.coalesce(_get("v", "$.downloadUrl"), _get("v", "$.openAccessPdf.url")),
        "type": _get("v", "$.type"),
    }


def _doaj() -> dict[str, Column]:
    listed = lambda p: F.coalesce(_get("v", p, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    dois = F.filter(listed("$.identifier"), lambda i: (i["type"] == "doi") & (F.coalesce(i["id"], F.lit("")) != ""))
    links = F.filter(listed("$.link"), lambda i: i["type"].isin("fulltext", "pdf") & (F.coalesce(i["url"], F.lit("")) != ""))
    return _general() | {
        "authors": F.filter(
            F.transform(F.coalesce(_get("v", "$.author", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.try_variant_get(a, "$.name", "string")),
            lambda n: n.isNotNull(),
        ),
        "year": text.leading_int(_get("v", "$.year")),
        "doi": F.get(dois, F.lit(0))["id"],
        "journal": F.coalesce(_get("v", "$.journal.title"), _get("v", "$.journal.name")),
        "citations": F.lit(0).cast("long"),
        "is_oa": F.lit(True),
        "full_text_url": F.get(links, F.lit(0))["url"],
        "type": F.lit("article"),
    }


def _eric() -> dict[str, Column]:
    return _general() | {
        "title": _first("v", "$.title"),
        "authors": F.coalesce(_get("v", "$.author", "array<string>"), F.array().cast("array<string>")),
        "year": text.leading_int(_first("v", "$.publicationyear")),
        "doi": _first("v", "$.doi"),
        "journal": _first("v", "$.source"),
        "abstract": _first("v", "$.abstract"),
        "citations": F.lit(0).cast("long"),
        "is_oa": _get("v", "$.peerreviewed", "variant").isNull(),
        "full_text_url": _first("v", "$.url"),
        "type": _first("v", "$.pubtype"),
        "publisher": _first("v", "$.source"),
    }


def _scopus() -> dict[str, Column]:
    return _general() | {
        "title": _get("v", "$['dc:title']"),
        "authors": F.array_compact(F.array(_get("v", "$['dc:creator']"))),
        "year": text.year_in(_get("v", "$['prism:coverDate']")),
        "doi": _get("v", "$['prism:doi']"),
        "journal": _get("v", "$['prism:publicationName']"),
        "abstract": _get("v", "$['dc:description']"),
        "citations": F.coalesce(_get("v", "$['citedby-count']", "long"), F.lit(0)),
        "is_oa": F.lit(False),
        "full_text_url": _get("v", "$.link[0]['@href']"),
        "type": F.lit(None).cast("string"),
    }


FIELD_MAPS = {"core": _core, "doaj": _doaj, "eric": _eric, "scopus": _scopus}


def normalize_records(raw: DataFrame, source: str, col: str = "value") -> DataFrame:
    """Raw JSON text of one source to flat works columns; unreadable rows have a null title."""
    fields = FIELD_MAPS.get(source, _general)()
    parsed = raw.withColumn("v", F.try_parse_json(col))
    keep = [c for c in raw.columns if c != col]
    return parsed.select(
        *keep, F.lit(source).alias("source"), *[c.alias(n) for n, c in fields.items()],
        F.get(fields["authors"], F.lit(0)).alias("first_author"),
        (F.coalesce(F.upper(_first("v", "$.peerreviewed")), F.lit("")) == "Y").alias("peer_reviewed"),
    )


def read_source_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One JSON record per line."""
    return normalize_records(spark.read.text(path), source)


def compact(works: DataFrame) -> DataFrame:
    """Light payload: the abstract is dropped, so the scan never reads it."""
    return works.drop("abstract")


def normalize_works(raw: DataFrame) -> DataFrame:
    """One flat record from the spellings title/title_alt, year_str/publication_year/sortpubdate, doi_any."""
    return raw.select(
        "seq",
        "source",
        F.coalesce(F.nullif("title", F.lit("")), "title_alt").alias("title"),
        text.extract_year(text.leading_int(F.col("year_str")), F.col("publication_year"), text.year_in(F.col("sortpubdate"))).alias("year"),
        text.norm_doi(F.col("doi_any")).alias("doi"),
    )


# --- Reference files -----------------------------------------------------------------


def parse_bibtex(entries: DataFrame, col: str = "value") -> DataFrame:
    """One row per entry text (`@type{key, field={value}, ...`)."""
    head = r"@(\w+)\s*\{([^,]+),"
    pairs = F.transform(
        F.regexp_extract_all(F.col(col), F.lit(r"(\w+\s*=\s*\{[^}]*\})"), F.lit(1)),
        lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\w+)", 1)).alias("k"), F.trim(F.regexp_extract(p, r"\{([^}]*)\}", 1)).alias("v")),
    )
    # the last value of a repeated field wins
    value = lambda name: F.element_at(F.filter(F.col("_pairs"), lambda p: p["k"] == name), -1)["v"]
    at = lambda name: F.try_element_at(F.filter(F.col("_pairs"), lambda p: p["k"] == name), F.lit(-1))["v"]
    url_doi = F.when(at("url").contains("doi.org"), F.element_at(F.split(at("url"), "doi.org/"), -1))
    found = entries.filter(F.col(col).rlike(head)).withColumn("_pairs", pairs)
    return found.select(
        F.trim(F.regexp_extract(col, head, 2)).alias("cite_key"),
        F.lower(F.regexp_extract(col, head, 1)).alias("entry_type"),
        *[at(n).alias(n) for n in ("title", "author", "year", "journal", "volume", "pages", "abstract")],
        F.coalesce(F.trim(at("doi")), url_doi, F.lit("")).alias("doi"),
        text.norm_authors_bib(at("author")).alias("authors_normalized"),
        F.when(at("year").isNotNull(), text.year_in(at("year"))).otherwise(text.year_in(at("date"))).alias("year_normalized"),
        F.lower(F.trim(F.coalesce(at("title"), F.lit("")))).alias("title_normalized"),
    )


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries end with a brace on its own line, so that is the record separator: a large file is split."""
    return parse_bibtex(spark.read.option("lineSep", "\n}").text(path))


RIS_LINE = r"(?m)^([A-Z][A-Z0-9]{1,3})\s*- (.*)$"


def parse_ris(records: DataFrame, col: str = "value") -> DataFrame:
    """Tagged records (RIS, NBIB) to rows; tags come in the order of the file."""
    lines = F.regexp_extract_all(F.col(col), F.lit(r"(?m)^([A-Z][A-Z0-9]{1,3}\s*- .*)$"), F.lit(1))
    pairs = F.transform(
        lines, lambda l: F.struct(F.trim(F.regexp_extract(l, r"^([A-Z0-9]+)", 1)).alias("k"), F.trim(F.regexp_extract(l, r"^[A-Z0-9]+\s*- (.*)$", 1)).alias("v"))
    )
    every = lambda *names: F.transform(F.filter(F.col("_p"), lambda p: p["k"].isin(list(names))), lambda p: p["v"])
    one = lambda *names: F.get(every(*names), F.lit(0))
    keep = [c for c in records.columns if c != col]
    return (
        records.withColumn("_p", pairs).filter(F.size("_p") > 0)
        .select(
            *keep, one("TY", "PT").alias("type"), one("TI", "T1").alias("title"), every("AU", "A1").alias("authors"),
            text.year_in(one("PY", "Y1", "DP")).alias("year"), one("JO", "T2", "JT").alias("journal"),
            text.norm_doi(one("DO", "LID")).alias("doi"), one("PMID").alias("pmid"), one("AB", "N2").alias("abstract"),
            every("KW", "OT").alias("keywords"), one("PB").alias("publisher"), one("UR").alias("url"),
        )
    )


def read_ris(spark: SparkSession, path: str, database: str) -> DataFrame:
    """Records end with the ER tag; each row carries its file and database as provenance."""
    records = spark.read.option("lineSep", "\nER  - ").text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    return parse_ris(records).withColumn("database", F.lit(database))


def ingest_reviewed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Approvals read back from a review file; rows without an id are skipped."""
    return reviewed_rows(spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path))


def reviewed_rows(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.trim(F.coalesce("uuid", F.lit(""))) != "")
        .select(F.trim("uuid").alias("uuid"), F.trim(F.coalesce("approved", F.lit(""))).isin(L.APPROVED_MARKS).alias("approved"), F.coalesce("reviewer_notes", F.lit("")).alias("reviewer_notes"))
    )


# --- Citation ids in document XML -----------------------------------------------------

UUID = r"[a-f0-9\-]{36}"
TAG_SCHEMA = "citationID string, citationItems array<struct<id:string,itemData:struct<id:string>>>, manualOverride struct<citeprocText:string>"


def extract_citation_ids(xml: DataFrame, col: str = "xml", tag: str = "CITATION") -> DataFrame:
    """Distinct citation ids of each XML text, one row each.

    Ids come from plain attributes and from base64 citation tags (`<vendor>_CITATION_v3_...`).
    """
    plain = [rf'"id"\s*:\s*"({UUID})"', rf'\w+[_-]id\s*[:=]\s*"({UUID})"', rf'guid\s*[:=]\s*"({UUID})"']
    direct = F.array_union(
        F.array_union(*[F.regexp_extract_all(F.col(col), F.lit(p), F.lit(1)) for p in plain[:2]]),
        F.regexp_extract_all(F.col(col), F.lit(plain[2]), F.lit(1)),
    )
    tags = F.regexp_extract_all(F.col(col), F.lit(rf'w:tag\s*w:val\s*=\s*"\w*{tag}_v\d+_([^"]+)"'), F.lit(1))

    def ids(t: Column) -> Column:
        body = F.regexp_replace(t, r"^v\d+_", "")
        padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
        decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
        data = F.from_json(decoded, TAG_SCHEMA)
        items = F.coalesce(data["citationItems"], F.array().cast("array<struct<id:string,itemData:struct<id:string>>>"))
        found = F.concat(
            F.array(F.regexp_extract(data["citationID"], rf"{tag}_({UUID})$", 1)),
            F.transform(items, lambda i: i["id"]),
            F.transform(items, lambda i: i["itemData"]["id"]),
            F.when(data.isNull() | data["citationItems"].isNull(), F.regexp_extract_all(decoded, F.lit(plain[0]), F.lit(1))).otherwise(F.array().cast("array<string>")),
            F.coalesce(F.regexp_extract_all(data["manualOverride"]["citeprocText"], F.lit(plain[0]), F.lit(1)), F.array().cast("array<string>")),
        )
        return F.filter(found, lambda i: i.isNotNull() & i.rlike(f"^{UUID}$"))

    everything = F.array_union(direct, F.flatten(F.transform(tags, ids)))
    keep = [c for c in xml.columns if c != col]
    return xml.select(*keep, F.explode(F.array_distinct(everything)).alias("uuid"))


# --- File inventory ------------------------------------------------------------------


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, type, size and time of every file, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("type"), "length", "modificationTime"
    )


#: Larger files are hashed in the pieces that Spark splits text files into.
WHOLE_FILE = 64 << 20
#: File endings that Spark's text reader would unpack; files of such a size are read whole.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"


def _line_hashes(batches):
    """(file, at, sha256) of each piece of a file, from its lines in order."""
    now, digest = None, None
    for batch in batches:
        for line, *piece in zip(*(c.to_pylist() for c in batch.columns)):
            if piece != now:
                if now:
                    yield pa.RecordBatch.from_pydict({"file": [now[0]], "at": [now[1]], "part": [digest.hexdigest()]})
                now, digest = piece, hashlib.sha256()
            digest.update(line + b"\n")
    if now:
        yield pa.RecordBatch.from_pydict({"file": [now[0]], "at": [now[1]], "part": [digest.hexdigest()]})


def content_hashes(spark: SparkSession, path: str, small: list[int], large: list[int]) -> DataFrame:
    """(path, sha256) of the files of these sizes; others are not opened.

    A file of a `large` size is no row: it is read line by line, and its hash is that of the hashes of
    its pieces. Files of one size are cut at the same places, and lines with the size give the
    contents, so equal hashes mean equal files; such a hash is not the file's own SHA-256.
    """
    files = spark.read.option("recursiveFileLookup", True)
    size = F.col("_metadata.file_size")
    binary = files.format("binaryFile").load(path)
    own = binary.filter(size.isin(small)).select("path", F.sha2("content", 256).alias("sha256"))
    if not large:
        return own
    lines = files.option("lineSep", "\n").format("text").load(path).filter(size.isin(large)).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    pieces = lines.mapInArrow(_line_hashes, "file STRING, at BIGINT, part STRING")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: F.concat_ws(":", p["at"].cast("string"), p["part"]))
    hashed = pieces.groupBy("file").agg(F.sha2(F.array_join(parts, ","), 256).alias("sha256"))
    names = binary.select("path", F.col("_metadata.file_path").alias("file"))
    return own.unionByName(names.join(hashed, "file").select("path", "sha256"))


def duplicate_files(spark: SparkSession, path: str, inventory: DataFrame | None = None, whole: int = WHOLE_FILE) -> DataFrame:
    """Evidence ladder: sizes first, contents hashed only where a size is shared.

    The shared sizes pass through the driver, which has listed every file of the folder anyway.
    """
    inv = file_inventory(spark, path) if inventory is None else inventory
    at_once = F.max((F.col("length") <= whole) | F.lower("name").rlike(PACKED)).alias("at_once")
    shared = inv.groupBy("length").agg(F.count("*").alias("n"), at_once).filter("n > 1").collect()
    hashed = content_hashes(spark, path, [r["length"] for r in shared if r["at_once"]], [r["length"] for r in shared if not r["at_once"]])
    same_hash = hashed.groupBy("sha256").agg(F.count("*").alias("same_content"))
    same_name = inv.groupBy("name", "type").agg(F.count("*").alias("same_name"))
    known = hashed.join(same_hash, "sha256")
    return (
        inv.join(known, "path", "left").join(same_name, ["name", "type"])
        .withColumn(
            "verdict",
            F.when(F.col("same_content") > 1, "VERIFIED IDENTICAL")
            .when(F.col("same_name") > 1, "DIFFERENT VERSION")
            .otherwise("UNIQUE/POTENTIALLY UNIQUE"),
        )
        .select("path", "name", "type", "length", "sha256", "verdict")
    )


def likely_duplicates(inventory: DataFrame) -> DataFrame:
    """Without reading contents: same name, type and size are likely, not verified, duplicates."""
    groups = inventory.groupBy("name", "type", "length").agg(F.count("*").alias("n"))
    return inventory.join(groups, ["name", "type", "length"]).select(
        "path", F.when(F.col("n") > 1, "LIKELY DUPLICATE — UNVERIFIED").otherwise("UNIQUE/POTENTIALLY UNIQUE").alias("verdict")
    )


# --- Payloads of the two metadata services --------------------------------------------

CROSSREF_SCHEMA = (
    "title array<string>, author array<struct<given:string,family:string>>, `published-print` struct<`date-parts`:array<array<int>>>, "
    "`container-title` array<string>, volume string, page string, DOI string"
)
LIBRARY_SCHEMA = (
    "title string, authors array<struct<first_name:string,last_name:string>>, year int, source string, volume string, pages string, "
    "identifiers struct<doi:string>"
)


def _short_names(people: Column, last: str, first: str) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    named = F.filter(F.coalesce(people, F.array().cast(f"array<struct<{first}:string,{last}:string>>")), lambda a: ~blank(a[last]))
    return F.array_join(
        F.transform(named, lambda a: F.when(blank(a[first]), a[last]).otherwise(F.concat_ws(" ", a[last], F.substring(a[first], 1, 1)))), ", "
    )


def crossref_fields(df: DataFrame, col: str = "payload") -> DataFrame:
    j = F.from_json(F.col(col), CROSSREF_SCHEMA)
    text_or = lambda c: F.coalesce(c, F.lit(""))
    keep = [c for c in df.columns if c != col]
    return df.withColumn("_j", j).select(
        *keep, text_or(F.get("_j.title", F.lit(0))).alias("title"), _short_names(F.col("_j.author"), "family", "given").alias("authors"),
        F.get(F.get("_j.`published-print`.`date-parts`", F.lit(0)), F.lit(0)).alias("year"),
        text_or(F.get("_j.`container-title`", F.lit(0))).alias("journal"), text_or(F.col("_j.volume")).alias("volume"),
        text_or(F.col("_j.page")).alias("pages"), text_or(F.col("_j.DOI")).alias("doi"),
    )


def library_fields(df: DataFrame, col: str = "payload") -> DataFrame:
    j = F.from_json(F.col(col), LIBRARY_SCHEMA)
    text_or = lambda c: F.coalesce(c, F.lit(""))
    keep = [c for c in df.columns if c != col]
    return df.withColumn("_j", j).select(
        *keep, text_or(F.col("_j.title")).alias("title"), _short_names(F.col("_j.authors"), "last_name", "first_name").alias("authors"),
        F.col("_j.year").alias("year"), text_or(F.col("_j.source")).alias("journal"), text_or(F.col("_j.volume")).alias("volume"),
        text_or(F.col("_j.pages")).alias("pages"), text_or(F.col("_j.identifiers.doi")).alias("doi"),
    )
