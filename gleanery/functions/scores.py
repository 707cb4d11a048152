"""Ranking and classification column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lookups as L
from .text import let


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table; the table is a literal, so nothing is joined."""
    value = literal_map(table)[key]
    return value if default is None else F.coalesce(value, F.lit(default))


def recency_score(year: Column, now: int) -> Column:
    age = F.lit(now) - year
    return F.when(age <= 1, 1.0).when(age <= 3, 0.8).when(age <= 5, 0.6).when(age <= 10, 0.4).otherwise(0.2)


def citation_score(citations: Column, most: Column) -> Column:
    usable = (citations > 0) & (most > 0)
    return F.when(usable, F.least(F.lit(1.0), F.log1p(citations) / F.log1p(most))).otherwise(0.0)


def journal_score(name: Column) -> Column:
    """Score of the first table entry that contains, or is contained in, the name."""
    low = F.lower(F.trim(name))
    score = F.when(F.coalesce(name, F.lit("")) == "", 0.0)
    for entry, points in L.JOURNAL_SCORES:
        score = score.when(low.contains(entry) | F.lit(entry).contains(low), points)
    return score.otherwise(0.0)


def design_score(kind: Column) -> Column:
    return lookup(L.DESIGN_SCORES, kind, L.DESIGN_SCORES["unknown"])


def geo_score(country: Column) -> Column:
    return lookup(L.GEO_SCORES, F.upper(F.coalesce(country, F.lit(""))), L.GEO_DEFAULT)


def openness_signals(
    is_oa: Column, full_text_url: Column, title: Column, abstract: Column, license_: Column
) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        F.coalesce(is_oa, F.lit(False)).alias("is_oa"),
        (
            text(title).rlike(r"(?i)code\s+(available|at|on|in)")
            | text(abstract).rlike(r"(?i)code\s+(available|at|on|in)\s+(github|gitlab|bitbucket)")
        ).alias("has_code"),
        (
            text(title).rlike(r"(?i)data\s+(available|at|on|in|set)")
            | text(abstract).rlike(r"(?i)data\s+(available|at|on|in)\s+(figshare|dryad|zenodo)")
        ).alias("has_dataset"),
        text(license_).rlike(r"(?i)cc[-\s]?(by|by-sa|by-nc|by-nd|zero|0|pddl)").alias("has_open_license"),
        (text(full_text_url) != "").alias("has_full_text"),
    )


def openness(signals: Column, predatory: Column) -> Column:
    """Sum of the signal points; a predatory source turns it into a penalty."""
    points = sum((F.when(signals[k], w).otherwise(0.0) for k, w in L.OPENNESS_POINTS.items()), F.lit(0.0))
    return F.when(predatory, F.greatest(F.lit(-2.0), points * L.PREDATORY_MULTIPLIER)).otherwise(
        F.least(F.lit(1.0), points)
    )


def composite(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum over the nine dimensions, three decimals; absent weights count 0."""
    total = sum((scores[d] * F.lit(float(weights.get(d, 0.0))) for d in L.DIMENSIONS), F.lit(0.0))
    return F.floor(total * 1000 + 0.5) / 1000.0


def retraction_penalty(score: Column, is_retracted: Column, kind: Column) -> Column:
    factor = lookup(L.RETRACTION_FACTORS, kind, 1.0)
    return F.when(F.coalesce(is_retracted, F.lit(False)), score * factor).otherwise(score)


def freeze_weights(weights: dict[str, float], degraded: list[str]) -> dict[str, float]:
    """Drop factors fed by degraded sources and share their weight out in proportion."""
    lost = {f for source in degraded for f in L.SOURCE_FACTORS.get(source, [])} & set(weights)
    freed = sum(weights[f] for f in lost)
    rest = sum(w for f, w in weights.items() if f not in lost)
    return {
        f: 0.0 if f in lost else (w + freed * w / rest if rest > 0 else w)
        for f, w in weights.items()
    }


def is_regional_registry(c: Column) -> Column:
    return c.isin(L.REGIONAL_REGISTRIES)


def equity_override(
    scores: Column, country: Column, trial_verified: Column, from_regional: Column, user_region: str | None = None
) -> Column:
    """Re-weigh a map of scores for under-indexed regions, then scale it to sum 1."""
    eligible = F.coalesce(country.isin(L.EQUITY_REGIONS), F.lit(False))
    same = F.coalesce(country == F.lit(user_region), F.lit(False)) if user_region else F.lit(False)
    applied = (eligible | same) & ~F.coalesce(trial_verified, F.lit(False))

    def reweigh(k: Column, v: Column) -> Column:
        out = v * lookup(L.EQUITY_BOOSTS, k, 1.0)
        for factor, divisor in L.EQUITY_DIVISORS.items():
            out = F.when(k == factor, v * (1 / divisor)).otherwise(out)
        return out

    moved = F.transform_values(scores, reweigh)
    total = F.aggregate(F.map_values(moved), F.lit(0.0), lambda acc, v: acc + v)
    scaled = F.transform_values(moved, lambda k, v: F.when(total > 0, v / total).otherwise(v))
    triggers = F.array_join(
        F.array_compact(
            F.array(F.when(eligible, country), F.when(same, F.concat(F.lit("same-region:"), country)))
        ),
        ", ",
    )
    ending = F.when(from_regional, " — unverified regional trial with local registry").otherwise(
        " — region-matched evidence boost"
    )
    return F.struct(
        F.when(applied, scaled).otherwise(scores).alias("scores"),
        applied.alias("applied"),
        F.when(applied, F.concat(F.lit("Equity override: "), triggers, ending))
        .otherwise("No override needed")
        .alias("reason"),
    )


def tier_label(c: Column) -> Column:
    return lookup(L.TIER_LABELS, c)


def grey_label(c: Column) -> Column:
    return lookup(L.GREY_LABELS, c)


def classify_tier(
    type_: Column,
    publication_types: Column | None,
    title: Column,
    abstract: Column,
    publisher: Column,
    container: Column | None = None,
    whole_words: bool = False,
) -> Column:
    """Evidence tier by the strongest signal: publisher type, index types, text, institution.

    `whole_words` asks for word-bounded institution names; the default keeps the
    bare substring test, under which short names such as "iso" match freely.
    """
    container = container if container is not None else F.lit("")
    types = publication_types if publication_types is not None else F.array().cast("array<string>")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def tier(peer, grey, kind, origin, confidence) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_col(peer).cast("int").alias("peer_tier"),
            as_col(grey).cast("int").alias("grey_tier"),
            as_col(kind).alias("document_type"),
            F.lit(origin).alias("tier_source"),
            as_col(confidence).cast("double").alias("confidence"),
        )

    by_type = lookup(L.PUBLISHER_TYPE_TIERS, type_)
    grey_by_type = lookup(L.PUBLISHER_TYPE_GREY, type_)

    grey_types = {k: v[0] for k, v in L.INDEX_TYPE_GREY.items()}
    grey_confidence = {k: v[1] for k, v in L.INDEX_TYPE_GREY.items()}
    first_grey = F.get(F.filter(types, lambda t: t.isin(list(grey_types))), F.lit(0))
    # best known tier below 6; the earliest type wins among equals
    ranked = F.filter(
        F.transform(types, lambda t, i: F.struct(lookup(L.INDEX_TYPE_TIERS, t, 6).alias("tier"), i.alias("at"), t.alias("type"))),
        lambda x: x["tier"] < 6,
    )
    best = F.array_min(ranked)

    def first_pattern(text: Column) -> Column:
        out = F.lit(None).cast("int")
        for pattern, grey in reversed(L.GREY_TEXT_PATTERNS):
            out = F.when(text.rlike(pattern), grey).otherwise(out)
        return out

    text_grey = let(F.concat(low(title), F.lit(" "), low(abstract)), first_pattern)

    if whole_words:
        inside = lambda c: low(c).rlike(r"\b(" + "|".join(L.INSTITUTIONS) + r")\b")
    else:
        inside = lambda c: low(c).rlike("(" + "|".join(L.INSTITUTIONS) + ")")
    institutional = inside(publisher) | inside(container)

    def by_text(grey: Column) -> Column:
        return (
            F.when(grey.isNotNull(), tier(6, grey, "inferred_from_text", "structural_regex", 0.6))
            .when(institutional, tier(6, 3, "institutional_publication", "structural_regex", 0.5))
            .otherwise(tier(6, None, "unclassified", "inferred", 0.3))
        )

    return (
        F.when(by_type.isNotNull() & grey_by_type.isNotNull(), tier(6, grey_by_type, type_, "publisher_type", 0.9))
        .when(by_type.isNotNull(), tier(by_type, None, type_, "publisher_type", 0.85))
        .when(
            first_grey.isNotNull(),
            tier(6, lookup(grey_types, first_grey), first_grey, "index_type", lookup(grey_confidence, first_grey)),
        )
        .when(
            F.size(types) > 0,
            tier(
                F.coalesce(best["tier"], F.lit(6)), None, F.coalesce(best["type"], F.lit("Journal Article")), "index_type", 0.8
            ),
        )
        .otherwise(let(text_grey, by_text))
    )
