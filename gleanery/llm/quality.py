"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in function of the row's whole text, so the scan, the
measures and the verdict run in one stage without a shuffle and without user code.

Defined results: a null or empty text has zero for every count and fails the base
rules; ties and repeated rows are judged row by row; an empty table gives an empty
result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SPACE, words

#: Frequent short words of the languages the rules know.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "was", "this",
    "le", "la", "les", "de", "des", "du", "et", "que", "qui", "dans", "pour", "une",
    "der", "die", "das", "und", "ein", "eine", "den", "von", "mit", "ist", "zu", "nicht",
    "el", "los", "las", "y", "en", "un", "una", "se", "por", "con", "del", "no",
]

#: measure, least allowed, most allowed (null: no limit). A text outside any limit is rejected.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("mean_word_length", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("n_stop_words", 2, None),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
]


def _repeated_window_words(ws: Column, width: int = 3) -> Column:
    """Words covered by a window of `width` words that occurs twice or more in the text.

    Windows are hashed; only where a hash repeats are (hash, position) pairs sorted, equal
    neighbours kept, and the union of their spans added up: n log n for any text. A text
    whose hashes are all distinct has no repeats. Two windows count as equal by a 64-bit
    hash of their words.
    """
    n = F.size(ws)
    hashes = F.transform(
        F.slice(ws, 1, F.greatest(n - (width - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, width)]),
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))

        def repeats(p: Column) -> Column:
            twice = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def union(starts: Column) -> Column:
            steps = F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(width)), F.lit(width)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(pairs, repeats), union)
        )

    return F.when(n < width, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """Struct of all measures of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda l: l.rlike(f"[^{SPACE}]"))

    def of(ws: Column) -> Column:
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeated_window_words(ws).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(ws, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(ls, lambda l: l.endswith("...") | l.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
                F.size(F.filter(ls, lambda l: l.rlike(f"^[{SPACE}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            ),
        )

    return let(words(t), of)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def verdict(m: Column, thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """True where no threshold is broken. `m` is a struct made by measures()."""
    known = {
        "n_words": m["n_words"], "n_stop_words": m["n_stop_words"],
        "mean_word_length": _ratio(m["word_chars"], m["n_words"]), "symbol_ratio": _ratio(m["n_symbols"], m["n_words"]),
        "dup_line_ratio": _ratio(m["n_dup_lines"], m["n_lines"]),
        "ellipsis_line_ratio": _ratio(m["n_ellipsis_lines"], m["n_lines"]),
        "bullet_line_ratio": _ratio(m["n_bullet_lines"], m["n_lines"]),
        "repeat_ratio": _ratio(m["n_repeat_words"], m["n_words"]),
    }
    passed = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            passed = passed & (known[name] >= least)
        if most is not None:
            passed = passed & (known[name] <= most)
    return passed


def quality_rules(docs: DataFrame, text: str = "text", out: str = "quality", thresholds=None) -> DataFrame:
    """docs with a struct column `out`: the measures, base_failed and kept."""
    m = measures(F.col(text))

    def judged(x: Column) -> Column:
        base = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        return x.withField("base_failed", base).withField("kept", ~base & verdict(x, thresholds or THRESHOLDS))

    return docs.withColumn(out, let(m, judged))
