"""Normalising column functions. Plain Column expressions; only the edit distance of `levenshtein_sim` is a kernel."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lookups as L
from .kernels import edit_distance


def _latin_folds() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode itself."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(base) == 1 and base != letter:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _latin_folds()


def fold_accents(c: Column) -> Column:
    """Drop accents of Latin letters; `kernels.nfkd_fold` covers other scripts."""
    return F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), ACCENTED, PLAIN)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it.

    A column used inside a higher-order function is otherwise computed per element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    """Folded title of letters, marks and digits of every script, single-spaced."""
    folded = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return squeeze(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}_\s]", " "))


def norm_author(c: Column) -> Column:
    folded = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return squeeze(F.regexp_replace(folded, "[.,;:]", " "))


def surname(c: Column) -> Column:
    """Text before the comma, else the last word."""
    return F.when(c.contains(","), norm_author(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(
        F.element_at(F.split(norm_author(c), " "), -1)
    )


def norm_doi(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), r"^https?://doi\.org/", "")
    return F.trim(F.regexp_replace(bare, r"^doi:", ""))


def dedup_hash(title: Column, year: Column, author: Column) -> Column:
    return F.sha2(F.concat_ws("|", norm_title(title), year.cast("string"), surname(author)), 256)


def doi_hash(c: Column) -> Column:
    return F.sha2(norm_doi(c), 256)


def year_in(c: Column) -> Column:
    """First run of four digits as an int; null when there is none."""
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


def leading_int(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def extract_year(*candidates: Column) -> Column:
    """First usable year among the candidates, in the given order."""
    return F.coalesce(*candidates)


def inverted_abstract(words: Column) -> Column:
    """Array of words to `{word: [positions]}`, within the row: sorted, then cut where the word changes."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def cut(p: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(p) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(p, i)["word"] != F.get(p, i - 1)["word"]))
        ends = F.concat(F.slice(starts, 2, F.size(p)), F.array(F.size(p)))
        spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
        entry = lambda s: F.struct(F.get(p, s["a"])["word"].alias("key"), F.transform(F.slice(p, s["a"] + 1, s["b"] - s["a"]), lambda e: e["at"]).alias("value"))
        return F.map_from_entries(F.transform(spans, entry))

    # a lambda over one element, so that the sorted array is made once
    return F.get(F.transform(F.array(placed), cut), F.lit(0))


def decode_inverted_abstract(c: Column) -> Column:
    """`{word: [positions]}` back to text, words ordered by position."""
    placed = F.transform(
        F.map_entries(c),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))),
    )
    return F.array_join(F.transform(F.array_sort(F.flatten(placed)), lambda x: x["word"]), " ")


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"^\s+|\s+$", "")


def sanitize_text(c: Column) -> Column:
    cleaned = reduce(lambda acc, step: F.regexp_replace(acc, F.lit(step[0]), F.lit(step[1])), L.SANITIZE_STEPS, F.coalesce(c, F.lit("")))
    return F.regexp_replace(cleaned, r"^\s+|\s+$", "")


def flag_injection(c: Column) -> Column:
    return F.coalesce(c.rlike(L.INJECTION_PATTERN), F.lit(False))


def redact_injection(c: Column) -> Column:
    return F.regexp_replace(c, L.INJECTION_PATTERN, "[REDACTED]")


def record_id(id_: Column, doi: Column, title: Column, source: Column) -> Column:
    return F.coalesce(id_, doi, F.concat_ws("-", title, source))


def abstract_hash(c: Column) -> Column:
    trimmed = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.sha2(trimmed, 256))


def host_of(c: Column) -> Column:
    """Host of a URL, or the prefix of a bare DOI; null when neither is there."""
    low = F.lower(c)
    return F.when(low.startswith("http"), F.try_parse_url(low, F.lit("HOST"))).when(
        low.contains("/"), F.split_part(low, F.lit("/"), F.lit(1))
    )


def norm_authors_bib(c: Column) -> Column:
    """`Last, First and First Last` to `Last F, Last F`."""

    def one(name: Column) -> Column:
        comma = F.split(name, ",", 2)
        last, first = F.trim(comma[0]), F.trim(F.get(comma, F.lit(1)))
        words = F.split(F.trim(name), r"\s+")
        initial = lambda part: F.upper(F.substring(part, 1, 1))
        return (
            F.when(name.contains(",") & (first != ""), F.concat_ws(" ", last, initial(first)))
            .when(name.contains(","), last)
            .when(F.size(words) >= 2, F.concat_ws(" ", F.element_at(words, -1), initial(words[0])))
            .otherwise(F.trim(name))
        )

    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), " and "), lambda a: one(F.trim(a))), ", ")


def format_authors(c: Column) -> Column:
    """`A B, C` to an array of (first_name, last_name); the last word is the last name."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")

    def split_name(name: Column) -> Column:
        words = F.split(name, r"\s+")
        return F.struct(
            F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("first_name"),
            F.element_at(words, -1).alias("last_name"),
        )

    return F.transform(names, split_name)


def author_set(c: Column) -> Column:
    """Lower-cased, trimmed, distinct author names of a comma list."""
    names = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda a: F.trim(a))
    return F.array_sort(F.array_distinct(F.filter(names, lambda a: a != "")))


def diff_title(c: Column) -> Column:
    """Title form of the correction ledger: punctuation removed, not replaced by a space."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger word set."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(wa, wb)).cast("double") / F.greatest(F.size(wa), F.size(wb))


def title_equiv(a: Column, b: Column, overlap: float = 0.85) -> Column:
    """Same title for the ledger: equal, contained, or more than `overlap` shared words."""
    ta, tb = diff_title(a), diff_title(b)
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    shared = (ta != "") & (tb != "") & (token_overlap(ta, tb) > overlap)
    return given & ((ta == tb) | tb.contains(ta) | ta.contains(tb) | shared)


def trial_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", ""))


def trial_title_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.95 if one contains the other, else the word overlap."""
    return _likeness(trial_title(a), trial_title(b))


def _likeness(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.95).otherwise(token_overlap(a, b))


def registry_title_match(a: Column, b: Column, overlap: float = 0.7) -> Column:
    """Same trial by title, in any script: one contains the other as written, or the words of both overlap."""
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    na, nb = norm_title(a), norm_title(b)
    return la.contains(lb) | lb.contains(la) | ((na != "") & (nb != "") & (_likeness(na, nb) >= overlap))


def levenshtein_sim(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    nested = a.startswith(b) | b.startswith(a)  # then only the rest of the longer one is added
    distance = F.when(nested, F.abs(F.length(a) - F.length(b))).otherwise(edit_distance(F.when(~nested, a), F.when(~nested, b)))
    return F.when(longest == 0, 1.0).otherwise(1.0 - distance / longest)


def entities(title: Column) -> Column:
    """Geographic, method and diagnostic terms of a title, each sorted and distinct."""
    def terms_of(norm: Column) -> Column:
        words = F.split(norm, r"\s+")

        def found(lexicon: list[str]) -> Column:
            phrases = F.array(*[F.lit(t) for t in lexicon if " " in t])
            singles = F.array(*[F.lit(t) for t in lexicon if " " not in t])
            return F.concat(F.filter(phrases, lambda p: norm.contains(p)), F.array_intersect(words, singles))

        phase = F.regexp_extract(norm, f"({L.PHASE_PATTERN})", 1)
        with_phase = F.concat(found(L.METHOD_ENTITIES), F.filter(F.array(phase), lambda p: p != ""))
        tidy = lambda terms: F.array_sort(F.array_distinct(terms))
        return F.struct(
            tidy(found(L.GEO_ENTITIES)).alias("geo"),
            tidy(with_phase).alias("method"),
            tidy(found(L.DIAGNOSTIC_ENTITIES)).alias("diagnostic"),
        )

    return let(norm_title(title), terms_of)


def entity_conflict(a: Column, b: Column) -> Column:
    """True when both sides name terms of one class and share none of them."""
    one = lambda k: (F.size(a[k]) > 0) & (F.size(b[k]) > 0) & ~F.arrays_overlap(a[k], b[k])
    return one("geo") | one("method") | one("diagnostic")


def is_domain_query(c: Column, keywords: list[str] = L.DOMAIN_KEYWORDS) -> Column:
    return let(F.lower(c), lambda low: F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: low.contains(k)))


def quote_phrases(c: Column, phrases: list[str] = L.DOMAIN_PHRASES) -> Column:
    """Put quotes round known multi-word phrases, the longest alternative first."""
    ordered = sorted((p for p in phrases if " " in p), key=lambda p: (-len(p), p))
    return F.regexp_replace(c, '(?i)"?(' + "|".join(ordered) + ')"?', '"$1"')


def detect_features(c: Column) -> Column:
    """Query-syntax features of a logged query string."""
    upper = F.concat(F.lit(" "), F.upper(c), F.lit(" "))
    return F.struct(
        c.contains("*").alias("has_star"),
        c.contains("?").alias("has_qmark"),
        (c.contains("$") | c.contains("#")).alias("has_dollar_hash"),
        c.rlike(L.PROXIMITY_PATTERN).alias("has_proximity"),
        c.rlike(L.FIELD_PATTERN).alias("has_field"),
        c.rlike(L.MESH_PATTERN).alias("has_mesh"),
        upper.rlike(r"\bOR\b").alias("has_or"),
        (upper.rlike(r"\bNOT\b") | c.rlike(r'(^|\s)-["\w]')).alias("has_not"),
        (c.contains("*") & F.lower(c).rlike(r"\[ *(ti|tiab|ad) *:~\d+ *\]")).alias("proximity_truncation_conflict"),
    )
