"""The end-to-end search: filter, quarantine, dedup, classify, score, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scores
from ..operators import dedup, filters, windows
from ..session import cut_lineage
from .aggregates import _DOI_KEY, _SQL_GREEDY, _sql_similar
from .registry import query, sql_hash
from .selection import NOW, scored, sql_composite, sql_spec, tiered

SPEC = filters.all_of("the", filters.any_of("and", "for"))


def search(works: DataFrame, spec=SPEC, mode: str = "systematic_review", k: int = 20, entries=L.PREDATORY_SAMPLE) -> DataFrame:
    """k best works that match `spec`, one per DOI and per title, year and surname, with tier and composite score.

    The cheap narrow tests come first, so each later step sees fewer rows. The only
    full shuffles are the two dedup keys; the top k needs no global sort.
    """
    matched = filters.boolean_filter(works, spec)
    clean, _log = filters.quarantine(matched, entries)
    unique = dedup.dedup_exact(clean)
    # scores need the largest citation count of the set, so it is kept once, without its texts
    classified = cut_lineage(tiered(unique).drop("abstract", "first_author", "publisher", "doi"))
    ranked = scored(classified, mode)
    return windows.top_k(ranked, k, [F.desc("score"), F.col("seq")]).select(
        "work_id", "title", "year", F.col("tier.peer_tier").alias("peer_tier"), scores.tier_label(F.col("tier.peer_tier")).alias("tier"),
        F.round("score", 3).alias("score"),
    )


@query(
    "search",
    f"""WITH m AS (SELECT * FROM works WHERE {sql_spec(SPEC)} AND publisher <> 'Sample Bad Press'), a AS (SELECT *, row_number() OVER (PARTITION BY {_DOI_KEY} ORDER BY seq) AS r1 FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY {sql_hash()} ORDER BY seq) AS r2 FROM a WHERE r1 = 1 OR {_DOI_KEY} IS NULL), u AS (SELECT * FROM b WHERE r2 = 1),
s AS ({sql_composite('systematic_review', 'u')}), c AS (SELECT *, CAST(CASE type WHEN 'systematic-review' THEN 1 WHEN 'meta-analysis' THEN 2 WHEN 'clinical-trial' THEN 3 WHEN 'cohort-study' THEN 4 WHEN 'journal-article' THEN 5 ELSE 6 END AS INT) AS peer_tier FROM s)
SELECT work_id, title, year, peer_tier, CASE peer_tier {' '.join(f"WHEN {k} THEN '{v}'" for k, v in L.TIER_LABELS.items())} END AS tier, round(score, 3) AS score FROM c ORDER BY c.score DESC, seq LIMIT 20""",
)
def _(t):
    return search(t.works)


@query(
    "search_deduplicated",
    f"""WITH m AS (SELECT * FROM works WHERE {sql_spec(SPEC)} AND publisher <> 'Sample Bad Press'), a AS (SELECT *, row_number() OVER (PARTITION BY {_DOI_KEY} ORDER BY seq) AS r1 FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY {sql_hash()} ORDER BY seq) AS r2 FROM a WHERE r1 = 1 OR {_DOI_KEY} IS NULL), e AS (SELECT * FROM b WHERE r2 = 1), {_sql_similar('e', L.MERGE_SIMILARITY)}, {_SQL_GREEDY},
u AS (SELECT * FROM e WHERE work_id IN (SELECT id FROM firsts) AND work_id NOT IN (SELECT id FROM fallen)), s AS ({sql_composite('systematic_review', 'u')})
SELECT work_id, round(score, 3) AS score FROM s ORDER BY s.score DESC, seq LIMIT 100""",
)
def _(t):
    """The same search with the fuzzy pass after the exact one."""
    matched = filters.boolean_filter(t.works, SPEC)
    clean, _log = filters.quarantine(matched, L.PREDATORY_SAMPLE)
    unique = cut_lineage(dedup.dedup_fuzzy(dedup.dedup_exact(clean)).drop("abstract", "first_author", "publisher", "doi"))
    return windows.top_k(scored(unique), 100, [F.desc("score"), F.col("seq")]).select("work_id", F.round("score", 3).alias("score"))
