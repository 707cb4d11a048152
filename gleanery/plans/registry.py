"""The catalogue of named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(tables) -> DataFrame under `name`."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is already registered")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


# --- SQL spellings of the shared normalisers ------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def re_all(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(to)}, 'g')"


def sql_title(e: str) -> str:
    return f"trim({re_all(re_all(f'strip_accents(lower(coalesce({e}, chr(0))))', '[^\\p{L}\\p{M}\\p{N}_\\s]', ' '), '\\s+', ' ')})"


def sql_author(e: str) -> str:
    return f"trim({re_all(re_all(f'strip_accents(lower({e}))', '[.,;:]', ' '), '\\s+', ' ')})"


def sql_surname(e: str) -> str:
    return f"CASE WHEN contains({e}, ',') THEN {sql_author(f'split_part({e}, chr(44), 1)')} ELSE list_extract(string_split({sql_author(e)}, ' '), -1) END"


def sql_doi(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({e}), '^https?://doi\\.org/', ''), '^doi:', ''))"


def sql_hash(title: str = "title", year: str = "year", author: str = "first_author") -> str:
    return f"sha256(concat_ws('|', {sql_title(title)}, CAST({year} AS STRING), {sql_surname(author)}))"


def sql_trim(e: str) -> str:
    return re_all(e, "^\\s+|\\s+$", "")


def sql_map(table: dict, key: str, default: str = "NULL") -> str:
    show = lambda v: lit(v) if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {default} END"
