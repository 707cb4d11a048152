"""Text, vocabulary, trial-id, hash and schema operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lookups as L
from ..functions import text
from ..functions.kernels import best_window
from .windows import first_per_key

# --- Vocabulary ----------------------------------------------------------------------


def norm_term(c: Column) -> Column:
    return text.squeeze(F.regexp_replace(F.lower(c), r"[^\w\s]", " "))


def vocab_table(spark, entries: list[tuple]) -> DataFrame:
    rows = [(n, t, list(s), list(b), float(w)) for n, (t, s, b, w) in enumerate(entries)]
    return spark.createDataFrame(rows, "ordinal int, term string, synonyms array<string>, broader array<string>, weight double")


def overlay_table(spark, entries: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(e) for e in entries], "region string, kind string, key string, value string")


def build_vocab(entries: DataFrame) -> DataFrame:
    """Index of terms (weight w) and synonyms (0.9 w), one row per normalised spelling.

    A term beats any synonym of the same spelling; of equal terms the last one wins,
    of equal synonyms the first one.
    """
    terms = entries.select(norm_term(F.col("term")).alias("key"), "term", "synonyms", "broader", "weight", F.lit(0).alias("_kind"), (-F.col("ordinal")).alias("_place"), F.lit(0).alias("_at"))
    synonyms = entries.select("*", F.posexplode("synonyms").alias("_at", "_s")).select(
        norm_term(F.col("_s")).alias("key"), "term", "synonyms", "broader", (F.col("weight") * 0.9).alias("weight"), F.lit(1).alias("_kind"), F.col("ordinal").alias("_place"), "_at"
    )
    return first_per_key(terms.unionByName(synonyms), ["key"], ["_kind", "_place", "_at"]).drop("_kind", "_place", "_at")


def lookup_terms(df: DataFrame, vocab: DataFrame, overlay: DataFrame, region: str | None, col: str = "term") -> DataFrame:
    """Entry of each term: regional exclusion, addition, mapping, then the standard index.

    Adds entry_term, entry_synonyms, entry_broader, entry_weight (null when unknown).
    """
    keyed = df.withColumn("_key", norm_term(F.col(col)))
    mine = overlay.filter(F.col("region") == F.lit(region))
    excluded = mine.filter("kind = 'exclusion'").select(norm_term(F.col("key")).alias("_key"), F.lit(True).alias("_out")).distinct()
    added = (
        mine.filter("kind = 'addition'").groupBy(norm_term(F.col("key")).alias("_key"))
        .agg(F.min("key").alias("_add"), F.min("value").alias("_add_broader"))
    )
    mapped = (
        mine.filter("kind = 'mapping'").groupBy(norm_term(F.col("value")).alias("_key")).agg(F.min("key").alias("_standard"))
    )
    index = vocab.select(
        F.col("key").alias("_at"), F.col("term").alias("_term"), F.col("synonyms").alias("_syn"), F.col("broader").alias("_broader"), F.col("weight").alias("_weight")
    )
    joined = (
        keyed.join(excluded, "_key", "left").join(added, "_key", "left").join(mapped, "_key", "left")
        .withColumn("_at", F.coalesce("_standard", "_key"))
        .join(index, "_at", "left")
    )
    shut, extra = F.coalesce("_out", F.lit(False)), F.col("_add").isNotNull()
    pick = lambda addition, standard: F.when(shut, None).when(extra, addition).otherwise(standard)
    none = F.array().cast("array<string>")
    return joined.select(
        *df.columns,
        pick(F.col("_add"), F.col("_term")).alias("entry_term"),
        pick(none, F.col("_syn")).alias("entry_synonyms"),
        pick(F.when(F.col("_add_broader").isNotNull(), F.array("_add_broader")).otherwise(none), F.col("_broader")).alias("entry_broader"),
        pick(F.lit(1.0), F.col("_weight")).alias("entry_weight"),
    )


def expand_terms(df: DataFrame, vocab: DataFrame, overlay: DataFrame, region: str | None, col: str = "term") -> DataFrame:
    """One row per (term, expansion): the entry, its synonyms and broader terms, or the term itself."""
    found = lookup_terms(df, vocab, overlay, region, col)
    names = F.when(F.col("entry_term").isNull(), F.array(F.col(col))).otherwise(
        F.array_distinct(F.concat(F.array("entry_term"), "entry_synonyms", "entry_broader"))
    )
    return found.select(*df.columns, F.explode(names).alias("expansion")).distinct()


# --- Trial ids -----------------------------------------------------------------------


def trial_id_array(*fields: Column) -> Column:
    """Array of (registry, trial_id, raw, confidence, position), distinct by upper-cased id."""
    joined = F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])

    def of(registry: str, pattern: str, any_case: bool, sure: str | None) -> Column:
        raws = F.regexp_extract_all(joined, F.lit(("(?i)" if any_case else "") + pattern), F.lit(1))
        certain = (lambda r: F.when(r.rlike(sure), 1.0).otherwise(0.8)) if sure else (lambda r: F.lit(0.8))
        return F.transform(
            raws, lambda r: F.struct(F.lit(registry).alias("registry"), F.upper(r).alias("trial_id"), r.alias("raw"), certain(r).alias("confidence"))
        )

    found = F.concat(*[of(*rule) for rule in L.TRIAL_REGISTRIES])
    # the first spelling of an id wins; only this paper's own few ids are compared
    ids = F.transform(found, lambda x: x["trial_id"])
    return F.filter(
        F.transform(
            found,
            lambda x, i: F.struct(
                x["registry"].alias("registry"), x["trial_id"].alias("trial_id"), x["raw"].alias("raw"), x["confidence"].alias("confidence"),
                F.when(F.array_position(ids, x["trial_id"]) == i + 1, i + 1).alias("position"),
            ),
        ),
        lambda x: x["position"].isNotNull(),
    )


def trial_ids(df: DataFrame, fields: list[str], id_: str = "work_id") -> DataFrame:
    return df.select(id_, F.inline(trial_id_array(*[F.col(f) for f in fields])))


# --- Anchors -------------------------------------------------------------------------


def fuzzy_anchor(df: DataFrame, body: str = "text", claim: str = "claim", threshold: float = 0.7) -> DataFrame:
    """Where a row's claim sits in its text: exact, else the best edit-distance window.

    Only rows without an exact place go through the kernel.
    Adds start, end (exclusive) and similarity; (-1, -1, 0) when nothing is close.
    """
    low, needle = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(claim, F.lit("")))
    marked = (
        df.withColumn("_t", low).withColumn("_c", needle)
        .withColumn("_n", F.length("_c"))
        .withColumn("_at", F.when(F.col("_n") > 0, F.instr(F.col("_t"), F.col("_c")) - 1).otherwise(-1))
    )
    exact = F.col("_at") >= 0
    searched = lambda c: F.when(~exact, F.col(c))
    found = marked.withColumn("_r", best_window(searched("_t"), searched("_c"), float(threshold)))
    return found.select(
        *df.columns,
        F.when(exact, F.col("_at")).otherwise(F.col("_r.start")).alias("start"),
        F.when(exact, F.col("_at") + F.col("_n")).otherwise(F.col("_r.end")).alias("end"),
        F.when(exact, F.lit(1.0)).otherwise(F.col("_r.similarity")).alias("similarity"),
    )


# --- Summaries, hashes, schemas ------------------------------------------------------

SUMMARY_SCHEMA = (
    "context struct<claim:string,anchor:string,start:int,end:int>, method struct<claim:string,anchor:string,start:int,end:int>, "
    "outcome struct<claim:string,anchor:string,start:int,end:int>, "
    "verifiableEntities array<struct<entity:string,type:string,confidence:double,sourceSentence:string>>"
)
ENTITY_TYPES = ["intervention", "population", "outcome", "study_design", "institution"]


def parse_summary(df: DataFrame, col: str = "summary_json") -> DataFrame:
    """Anchored claims and at most five valid entities of a JSON summary."""
    parsed = F.from_json(F.col(col), SUMMARY_SCHEMA)
    part = lambda name: F.struct(
        F.coalesce(F.col(f"_p.{name}.claim"), F.lit("")).alias("claim"),
        F.col(f"_p.{name}.anchor").alias("anchor"),
        F.coalesce(F.col(f"_p.{name}.start"), F.lit(-1)).alias("start"),
        F.coalesce(F.col(f"_p.{name}.end"), F.lit(-1)).alias("end"),
    ).alias(name)
    valid = F.filter(
        "_p.verifiableEntities",
        lambda e: (F.coalesce(e["entity"], F.lit("")) != "") & e["type"].isin(ENTITY_TYPES) & (e["confidence"] >= 0.7),
    )
    tidy = F.transform(
        F.slice(valid, 1, 5),
        lambda e: F.struct(
            e["entity"].alias("entity"), e["type"].alias("type"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), e["confidence"])).alias("confidence"),
            F.coalesce(e["sourceSentence"], F.lit("")).alias("source_sentence"),
        ),
    )
    return df.withColumn("_p", parsed).select(*df.columns, part("context"), part("method"), part("outcome"), tidy.alias("entities"))


def multiset_hash(hex_digest: Column) -> Column:
    """Aggregate: one digest of all row digests, whatever their order.

    Slices of the digests are summed and the sums hashed with the count. It keeps
    constant state and combines before the shuffle, where sorting all digests in one
    place would not.
    """
    part = lambda at: F.sum(F.conv(F.substring(hex_digest, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count(hex_digest).cast("string"), part(1), part(13), part(25), part(37)), 256)


def manifest_rows(df: DataFrame) -> DataFrame:
    """paper_id, doi, abstract hash and row hash of every work."""
    rows = df.select(
        text.record_id(F.col("work_id").cast("string"), F.col("doi"), F.col("title"), F.col("source")).alias("paper_id"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        text.abstract_hash(F.col("abstract")).alias("abstract_hash"),
    )
    return rows.withColumn("row_hash", F.sha2(F.concat_ws("|", "paper_id", "doi", "abstract_hash"), 256))


def manifest_hash(df: DataFrame) -> DataFrame:
    return manifest_rows(df).agg(F.count("*").alias("papers"), multiset_hash(F.col("row_hash")).alias("manifest_hash"))


def spec_shape(spec) -> str:
    """Structure of a condition: operators and string lengths, not the strings."""
    if isinstance(spec, str):
        return f"str:{len(spec)}"
    return "{" + spec[0] + ":" + ",".join(spec_shape(p) for p in spec[1:]) + "}"


def query_fingerprint(df: DataFrame, spec, endpoints: list[str], region: str, doi: str = "doi") -> DataFrame:
    """One row: reproducibility hash over structure, endpoints, region, count and the three least DOIs."""
    total = df.agg(F.count("*").alias("cardinality"))
    plain = text.norm_doi(F.col(doi))
    least = df.filter(F.coalesce(F.col(doi), F.lit("")) != "").groupBy(plain.alias("d")).count().orderBy("d").limit(3)
    # three rows at most reach this array
    top = least.agg(F.array_join(F.array_sort(F.collect_list("d")), ",").alias("top_dois"))
    shape = spec_shape(spec)
    return total.withColumn("top_dois", top.scalar()).select(
        F.lit(shape).alias("shape"),
        "cardinality",
        "top_dois",
        F.sha2(
            F.concat_ws("|", F.lit(shape), F.lit(",".join(sorted(endpoints))), F.lit(region.upper()), F.col("cardinality").cast("string"), "top_dois"), 256
        ).alias("fingerprint"),
    )


def verify_fingerprint(df: DataFrame, expected: str, spec, endpoints: list[str], region: str) -> DataFrame:
    now = query_fingerprint(df, spec, endpoints, region)
    return now.select("fingerprint", (F.col("fingerprint") == expected).alias("unchanged"))


def schema_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every field, nested ones included."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        kind = f.dataType
        out.append((path, kind.simpleString() if not isinstance(kind, T.StructType) else "struct"))
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(inner, T.StructType):
            out += schema_fields(inner, path + ("[]." if inner is not kind else "."))
    return out


def schema_drift(expected: DataFrame, actual: DataFrame, used: list[str]) -> DataFrame:
    """Field differences: `expected` and `actual` are (path, type) tables.

    A difference in a used field blocks; in any other field it only warns.
    """
    e = expected.select("path", F.col("type").alias("expected_type"))
    a = actual.select("path", F.col("type").alias("actual_type"))
    joined = e.join(a, "path", "full_outer")
    kind = (
        F.when(F.col("expected_type").isNull(), "added")
        .when(F.col("actual_type").isNull(), "removed")
        .when(F.col("expected_type") != F.col("actual_type"), "type_changed")
    )
    return (
        joined.withColumn("drift", kind).filter("drift IS NOT NULL")
        .withColumn("severity", F.when(F.col("path").isin(used), "block").otherwise("warn"))
        .select("path", "expected_type", "actual_type", "drift", "severity")
    )


def json_fields(df: DataFrame, col: str) -> DataFrame:
    """(path, type) observed in a column of JSON objects, top level, one row per pair."""
    return df.sparkSession.sql(
        f"SELECT DISTINCT key AS path, lower(regexp_extract(schema_of_variant(value), '^([A-Z]+)', 1)) AS type FROM {{df}}, LATERAL variant_explode(try_parse_json({col}))",
        df=df.select(col),
    )
