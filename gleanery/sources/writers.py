"""Writers: tables to reference files, review grids and export logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tag(name: str, value: Column) -> Column:
    """`NAME  - value`, or null for an empty value."""
    shown = value.cast("string")
    return F.when(F.coalesce(shown, F.lit("")) != "", F.concat(F.lit(f"{name}  - "), shown))


def _tags(name: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: F.concat(F.lit(f"{name}  - "), v))


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _authors(df: DataFrame) -> Column:
    if "authors" in df.columns:
        return F.col("authors")
    return F.array_compact(F.array(_column(df, "first_author")))


def to_ris(works: DataFrame, variant: str = "server") -> DataFrame:
    """One RIS record per work in column `value`; write it with `write_ris`.

    The client variant adds volume, issue, pages, PDF and DOI links and keeps each
    value on one line.
    """
    c = lambda name: _column(works, name)
    authors, keywords = _authors(works), (F.col("keywords") if "keywords" in works.columns else F.array().cast("array<string>"))
    kind = F.lower(F.coalesce(c("type"), F.lit("JOUR")))
    one = lambda *cols: F.array(*cols)
    if variant == "server":
        ris_type = F.when(kind.contains("journal"), "JOUR").when(kind.contains("book"), "BOOK").when(kind.contains("conference"), "CONF").otherwise("JOUR")
        parts = [
            one(F.concat(F.lit("TY  - "), ris_type), _tag("TI", c("title"))), _tags("AU", authors),
            one(_tag("PY", c("year")), _tag("JO", c("journal")), _tag("T2", c("journal")), _tag("DO", c("doi")), _tag("AB", c("abstract"))),
            _tags("KW", keywords), one(_tag("PB", c("publisher")), _tag("UR", c("full_text_url"))),
        ]
    elif variant == "client":
        flat = lambda col: F.regexp_replace(col, r"\r?\n", " ")
        ris_type = F.when(c("type") == "journal-article", "JOUR").otherwise(F.coalesce(c("publication_type"), F.lit("JOUR")))
        bare = F.regexp_replace(F.lower(c("doi")), r"^https?://doi\.org/", "")
        doi_url = F.when(F.coalesce(c("doi"), F.lit("")) != "", F.concat(F.lit("https://doi.org/"), bare))
        parts = [
            one(F.concat(F.lit("TY  - "), ris_type), F.concat(F.lit("TI  - "), flat(F.coalesce(c("title"), F.lit("Untitled"))))),
            _tags("AU", F.transform(authors, flat)),
            one(
                _tag("PY", c("year")), _tag("DO", c("doi")), _tag("JO", flat(c("journal"))), _tag("TA", flat(c("journal"))), _tag("VL", c("volume")),
                _tag("IS", c("issue")), _tag("SP", c("pages")), _tag("AB", flat(c("abstract"))),
            ),
            _tags("KW", F.transform(keywords, flat)),
            one(_tag("L1", c("full_text_url")), _tag("L2", doi_url), _tag("UR", doi_url), _tag("PB", flat(c("publisher")))),
        ]
    else:
        raise ValueError("variant is server or client")
    lines = F.filter(F.concat(*parts, F.array(F.lit("ER  - "))), lambda l: l.isNotNull())
    keys = [k for k in ("work_id", "seq") if k in works.columns]
    return works.select(*keys, F.array_join(lines, "\n").alias("value"))


def write_ris(works: DataFrame, path: str, variant: str = "server") -> None:
    to_ris(works, variant).select("value").write.mode("errorifexists").text(path)


CSV_COLUMNS = ["title", "authors", "year", "journal", "doi", "publication_type", "abstract", "keywords", "source"]


def to_csv(works: DataFrame) -> DataFrame:
    """The nine export columns, lists joined by "; ", newlines flattened."""
    c = lambda name: F.coalesce(_column(works, name).cast("string"), F.lit(""))
    flat = lambda col: F.regexp_replace(col, "\n", " ")
    keywords = F.array_join("keywords", "; ") if "keywords" in works.columns else F.lit("")
    kind = F.coalesce(_column(works, "publication_type"), _column(works, "type"), F.lit(""))
    values = [flat(c("title")), F.array_join(_authors(works), "; "), c("year"), c("journal"), c("doi"), kind, flat(c("abstract")), keywords, c("source")]
    keys = [k for k in ("work_id",) if k in works.columns]
    return works.select(*keys, *[v.alias(n) for n, v in zip(CSV_COLUMNS, values)])


def csv_line(df: DataFrame) -> Column:
    """A row of `to_csv` as text: every field quoted but the year, quotes doubled."""
    quoted = lambda n: F.concat(F.lit('"'), F.replace(F.col(n), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[F.col(n) if n == "year" else quoted(n) for n in CSV_COLUMNS])


def to_review_csv(ledger: DataFrame) -> DataFrame:
    """Review grid of the rows in state DIFFED, the ones to correct first."""
    text_of = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
    cols = ["uuid", "title_lib", "title_auth", "year_lib", "year_auth", "authors_lib", "authors_auth"]
    rows = ledger.filter("state = 'DIFFED'").orderBy(F.desc("needs_correction"), "title_lib", "uuid")
    return rows.select(
        F.lit(0).alias("approved"), *[text_of(n) for n in cols], F.col("needs_correction").cast("int").alias("needs_correction"),
        text_of("correction_json"), F.lit("").alias("reviewer_notes"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("errorifexists").csv(path)


def to_json_export(works: DataFrame, exported_at: str, watermark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one header row with count and watermark, one JSON row per work)."""
    header = works.agg(F.count("*").alias("count")).select(
        F.to_json(F.struct(F.lit(exported_at).alias("exportedAt"), F.lit(watermark).alias("watermark"), "count"), {"ignoreNullFields": "false"}).alias("value")
    )
    c = lambda name: _column(works, name)
    body = F.struct(
        F.coalesce(c("title"), F.lit("")).alias("title"), _authors(works).alias("authors"), c("year").alias("year"),
        F.coalesce(c("journal"), F.lit("")).alias("journal"), c("doi").alias("doi"),
        F.coalesce(c("type"), F.lit("")).alias("publicationType"), F.coalesce(c("abstract"), F.lit("")).alias("abstract"), c("source").alias("source"),
    )
    keys = [k for k in ("work_id",) if k in works.columns]
    return header, works.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_json_export(works: DataFrame, path: str, exported_at: str, watermark: str | None = None) -> None:
    header, rows = to_json_export(works, exported_at, watermark)
    header.write.mode("errorifexists").text(path + "/header")
    rows.select("value").write.mode("errorifexists").text(path + "/papers")


def export_audit(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Audit row of every export attempt: outcome, watermark and what was delivered."""
    joined = requests.join(decisions, ["search_id", "mode", "format"])
    return joined.select(
        "search_id", "format", F.when(F.col("allowed"), "complete").otherwise("blocked").alias("status"),
        F.when(~F.col("allowed"), F.col("reason")).alias("blocked_reason"), "watermarked",
        F.when(F.col("allowed"), F.col("result_count")).otherwise(0).alias("result_count"), "created_at",
    )


def export_history(audit: DataFrame, search_id: str) -> DataFrame:
    return audit.filter(F.col("search_id") == search_id).orderBy(F.desc("created_at"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
