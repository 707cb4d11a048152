"""Catalogue: dedup, aggregates, screening, ledger and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scores, text
from ..operators import dedup, filters, jobs, joins, ledger as ledger_ops, metrics, textops, windows
from .records import _UUID_SQL, md5
from .registry import lit, listed, query, re_all, sql_author, sql_doi, sql_hash, sql_map, sql_surname, sql_title, sql_trim
from .selection import _sql_tier, tiered

# --- Entity resolution -----------------------------------------------------------------


def _copies(t):
    """The works twice over: a later batch repeats the DOIs of earlier works and many titles."""
    return t.sql(_COPIES)


_COPIES = """SELECT work_id, seq, source, country, title, abstract, first_author, year, doi, type, publisher FROM works
UNION ALL SELECT work_id + 10000000, seq + 10000000, source, country, CASE WHEN work_id % 4 = 0 THEN concat('  ', lower(title)) WHEN work_id % 4 = 1 THEN concat(title, '!') ELSE concat(title, ' b') END,
  abstract, first_author, CASE WHEN work_id % 10 = 1 THEN year + 1 ELSE year END, CASE WHEN work_id % 5 = 0 THEN 'DOI:' || substr(doi, 17) END, type, publisher FROM works"""


_DOI_KEY = f"nullif({sql_doi('doi')}, '')"


@query(
    "dedup_exact",
    f"""WITH c AS ({_COPIES}), a AS (SELECT *, row_number() OVER (PARTITION BY {_DOI_KEY} ORDER BY seq) AS r1 FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY {sql_hash()} ORDER BY seq) AS r2 FROM a WHERE r1 = 1 OR {_DOI_KEY} IS NULL) SELECT work_id FROM b WHERE r2 = 1""",
)
def _(t):
    return dedup.dedup_exact(_copies(t)).select("work_id")


def _ent_sql(title: str, lexicon: list[str], extra: str = "[]") -> str:
    n = sql_title(title)
    multi, single = [x for x in lexicon if " " in x], [x for x in lexicon if " " not in x]
    return f"list_sort(list_distinct(list_concat([p for p in {listed(multi)} if contains({n}, p)], list_intersect(string_split({n}, ' '), {listed(single)}), {extra})))"


def _phase_sql(title: str) -> str:
    return f"[p for p in [regexp_extract({sql_title(title)}, {lit(L.PHASE_PATTERN)})] if p <> '']"


def _entities_sql(title: str) -> str:
    return f"{_ent_sql(title, L.GEO_ENTITIES)} AS geo, {_ent_sql(title, L.METHOD_ENTITIES, _phase_sql(title))} AS method, {_ent_sql(title, L.DIAGNOSTIC_ENTITIES)} AS diagnostic"


@query(
    "entities",
    f"SELECT work_id, array_to_string(geo, ',') AS geo, array_to_string(method, ',') AS method, array_to_string(diagnostic, ',') AS diagnostic FROM (SELECT work_id, {_entities_sql('title')} FROM works)",
)
def _(t):
    e = t.works.select("work_id", text.entities(F.col("title")).alias("e"))
    return e.select("work_id", *[F.array_join(f"e.{k}", ",").alias(k) for k in ("geo", "method", "diagnostic")])


@query(
    "entity_conflict",
    f"""WITH e AS (SELECT uuid, {_entities_sql("concat(title_lib, CASE uuid % 3 WHEN 0 THEN ' malaysia pilot' WHEN 1 THEN ' asthma cohort' ELSE '' END)")} FROM ledger),
f AS (SELECT uuid, {_entities_sql("concat(coalesce(title_auth, ''), CASE uuid % 5 WHEN 0 THEN ' japan pilot' WHEN 1 THEN ' stroke' ELSE ' malaysia asthma' END)")} FROM ledger)
SELECT e.uuid, (len(e.geo) > 0 AND len(f.geo) > 0 AND NOT list_has_any(e.geo, f.geo)) OR (len(e.method) > 0 AND len(f.method) > 0 AND NOT list_has_any(e.method, f.method))
  OR (len(e.diagnostic) > 0 AND len(f.diagnostic) > 0 AND NOT list_has_any(e.diagnostic, f.diagnostic)) AS conflict FROM e JOIN f ON e.uuid = f.uuid""",
)
def _(t):
    u = F.col("uuid")
    a = F.concat("title_lib", F.when(u % 3 == 0, " malaysia pilot").when(u % 3 == 1, " asthma cohort").otherwise(""))
    b = F.concat(F.coalesce("title_auth", F.lit("")), F.when(u % 5 == 0, " japan pilot").when(u % 5 == 1, " stroke").otherwise(" malaysia asthma"))
    both = t.ledger.select("uuid", text.entities(a).alias("a"), text.entities(b).alias("b"))
    return both.select("uuid", text.entity_conflict(F.col("a"), F.col("b")).alias("conflict"))


def _sql_jaro_winkler(pairs: str) -> str:
    """CTEs up to `jw` (x, y, similarity) for the CTE `pairs` (x, y, a, b) of two strings each.

    Letters are independent of each other: for each one, a pointer walks over its places in b,
    at most one on from the later of where it is and where the window begins, at most to where the window ends.
    """
    return f"""
jw_sized AS (
  SELECT x, y, a, b, length(a) AS na, length(b) AS nb, greatest(length(a), length(b)) // 2 - 1 AS reach,
         CASE WHEN left(a, 1) <> left(b, 1) THEN 0 WHEN left(a, 2) <> left(b, 2) THEN 1 WHEN left(a, 3) <> left(b, 3) THEN 2 WHEN left(a, 4) <> left(b, 4) THEN 3
              ELSE least(4, length(a), length(b)) END AS shared FROM {pairs}
), jw_strings AS (
  SELECT a AS s FROM jw_sized UNION SELECT b FROM jw_sized
), jw_places AS (
  SELECT s, ch, list(i ORDER BY i) AS places FROM (SELECT s, i, substr(s, i, 1) AS ch FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM jw_strings)) GROUP BY s, ch
), jw_steps AS MATERIALIZED (
  SELECT p.x, p.y, l.ch, l.places AS ia, r.places AS ib, list_transform(l.places, lambda i: struct_pack(
           low := CAST(len(list_filter(r.places, lambda j: j < i - p.reach)) AS BIGINT), up := CAST(len(list_filter(r.places, lambda j: j <= i + p.reach)) AS BIGINT))) AS steps
  FROM jw_sized p JOIN jw_places l ON l.s = p.a JOIN jw_places r ON r.s = p.b AND r.ch = l.ch WHERE p.reach >= 0
), jw_walked AS (
  SELECT x, y, ch, ib, unnest(ia) AS i, unnest(list_transform(steps, lambda e: e.up)) AS up,
         unnest(list_transform(range(1, len(steps) + 1), lambda k: greatest(qs[k], steps[k].low))) AS q
  FROM (SELECT *, list_reduce(steps, lambda qs, e: list_append(qs, least(greatest(qs[-1], e.low) + 1, e.up)), [0::BIGINT]) AS qs FROM jw_steps)
), jw_met AS (
  SELECT x, y, ch, i, ib[q + 1] AS j FROM jw_walked WHERE q < up
), jw_ranked AS (
  SELECT x, y, ch, row_number() OVER (PARTITION BY x, y ORDER BY i) AS ri, row_number() OVER (PARTITION BY x, y ORDER BY j) AS rj FROM jw_met
), jw_swaps AS (
  SELECT a.x, a.y, count(*) AS m, count_if(a.ch <> b.ch) AS swapped FROM jw_ranked a JOIN jw_ranked b ON a.x = b.x AND a.y = b.y AND a.ri = b.rj GROUP BY a.x, a.y
), jw_jaro AS (
  SELECT p.*, CASE WHEN m > 0 THEN (m::DOUBLE / na + m::DOUBLE / nb + (m - swapped / 2.0::DOUBLE) / m) / 3 ELSE 0.0 END AS jaro
  FROM jw_sized p LEFT JOIN jw_swaps s ON p.x = s.x AND p.y = s.y
), jw AS MATERIALIZED (
  SELECT x, y, CASE WHEN a = b THEN 1.0::DOUBLE WHEN jaro = 0 THEN 0.0 ELSE jaro + shared * 0.1::DOUBLE * (1 - jaro) END AS similarity FROM jw_jaro
)"""


@query(
    "jaro_winkler",
    f"""WITH p AS (SELECT uuid AS x, uuid AS y, {sql_title('title_lib')} AS a, {sql_title('title_auth')} AS b FROM ledger WHERE title_auth IS NOT NULL),
{_sql_jaro_winkler('p')} SELECT x AS uuid, similarity FROM jw""",
)
def _(t):
    from ..functions.kernels import jaro_winkler

    pairs = t.ledger.filter("title_auth IS NOT NULL").select("uuid", text.norm_title(F.col("title_lib")).alias("a"), text.norm_title(F.col("title_auth")).alias("b"))
    return pairs.select("uuid", jaro_winkler(F.col("a"), F.col("b")).alias("similarity"))


def _sql_firsts(source: str) -> str:
    """CTEs `prepared` and `firsts`, the first work of each title and year of `source`."""
    return f"""prepared AS (SELECT work_id AS id, seq, year, {sql_title('title')} AS norm, {sql_surname('first_author')} AS author, {_entities_sql('title')} FROM {source}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm, year ORDER BY seq) AS rn FROM prepared) WHERE rn = 1 OR norm = '')"""


def _sql_similar(source: str, floor: float) -> str:
    """CTEs up to `alike`: pairs of works of `source` within a year that score at least `floor`.

    Two strings that share too few letters to reach it are not scored.
    """
    bound = lambda l: f"{3 * (floor - l / 10) / (1 - l / 10) - 1 - 1e-9:.12f}"
    return f"""{_sql_firsts(source)},
near AS (SELECT a.id AS x, b.id AS y, a.norm AS a, b.norm AS b FROM firsts a JOIN firsts b ON b.year BETWEEN a.year - 1 AND a.year + 1 AND a.seq < b.seq WHERE a.norm <> '' AND b.norm <> ''),
tally AS (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(norm, '')) AS ch FROM firsts WHERE norm <> '') GROUP BY id, ch),
shares AS (SELECT x, y, sum(least(l.n, r.n)) AS common FROM near JOIN tally l ON l.id = x JOIN tally r ON r.id = y AND r.ch = l.ch GROUP BY x, y),
hopeful AS (SELECT near.* FROM near JOIN shares ON near.x = shares.x AND near.y = shares.y WHERE common::DOUBLE / length(a) + common::DOUBLE / length(b) >=
  CASE WHEN left(a, 1) <> left(b, 1) THEN {bound(0)} WHEN left(a, 2) <> left(b, 2) THEN {bound(1)} WHEN left(a, 3) <> left(b, 3) THEN {bound(2)} WHEN left(a, 4) <> left(b, 4) THEN {bound(3)} ELSE {bound(4)} END),
{_sql_jaro_winkler('hopeful')},
alike AS MATERIALIZED (SELECT x AS left_id, y AS right_id, a.seq AS left_seq, b.seq AS right_seq, a.year = b.year AS year_match, a.author <> '' AND a.author = b.author AS author_match,
  a.norm <> b.norm AND ((len(a.geo) > 0 AND len(b.geo) > 0 AND NOT list_has_any(a.geo, b.geo)) OR (len(a.method) > 0 AND len(b.method) > 0 AND NOT list_has_any(a.method, b.method))
  OR (len(a.diagnostic) > 0 AND len(b.diagnostic) > 0 AND NOT list_has_any(a.diagnostic, b.diagnostic))) AS conflict, similarity
  FROM jw JOIN firsts a ON a.id = x JOIN firsts b ON b.id = y WHERE similarity >= {floor})"""


#: CTEs up to `fallen` (the ids in `gone`): row by row, a work falls if an earlier one that stands is its duplicate.
_SQL_GREEDY = f"""duplicates AS (SELECT left_id, right_id, left_seq, right_seq FROM alike WHERE similarity >= {L.MERGE_SIMILARITY} AND NOT conflict),
queue AS MATERIALIZED (SELECT right_id, list(left_id) AS before, row_number() OVER (ORDER BY right_seq, right_id) AS turn FROM duplicates GROUP BY right_id, right_seq),
loop AS (SELECT 0::BIGINT AS turn, []::BIGINT[] AS gone UNION ALL
  SELECT l.turn + 1, CASE WHEN len(list_filter(q.before, lambda i: NOT list_contains(l.gone, i))) > 0 THEN list_append(l.gone, q.right_id) ELSE l.gone END
  FROM loop l JOIN queue q ON q.turn = l.turn + 1),
fallen AS (SELECT unnest(gone) AS id FROM loop WHERE turn = (SELECT max(turn) FROM loop))"""


@query(
    "similar_titles",
    f"WITH c AS ({_COPIES}), {_sql_similar('c', L.GREY_SIMILARITY)} SELECT left_id, right_id, left_seq, right_seq, year_match, author_match, conflict, similarity FROM alike",
)
def _(t):
    return dedup.similar_pairs(_copies(t))


@query("block_keys")
def _(t):
    rows = t.works.select("work_id", text.norm_title(F.col("title")).alias("norm"))
    return dedup.block_keys(rows).select("work_id", "block")


@query(
    "dedup_fuzzy",
    f"WITH c AS ({_COPIES}), {_sql_similar('c', L.MERGE_SIMILARITY)}, {_SQL_GREEDY} SELECT id AS work_id FROM firsts WHERE id NOT IN (SELECT id FROM fallen)",
)
def _(t):
    return dedup.dedup_fuzzy(_copies(t)).select("work_id")


@query(
    "shadow_pairs",
    f"""WITH c AS ({_COPIES}), {_sql_similar('c', L.GREY_SIMILARITY)}, {_SQL_GREEDY},
hits AS (SELECT right_id, min(left_seq) AS hit FROM duplicates WHERE left_id NOT IN (SELECT id FROM fallen) GROUP BY right_id)
SELECT s.left_id, s.right_id, similarity, concat_ws(',', 'title_similarity_' || printf('%.3f', similarity), CASE WHEN year_match THEN 'year_match' END, CASE WHEN author_match THEN 'author_match' END) AS reasons,
  s.right_id IN (SELECT id FROM fallen) AS later_dropped
FROM alike s LEFT JOIN hits h ON s.right_id = h.right_id WHERE similarity < {L.MERGE_SIMILARITY} AND (year_match OR author_match) AND s.left_id NOT IN (SELECT id FROM fallen) AND (hit IS NULL OR left_seq < hit)""",
)
def _(t):
    out = dedup.shadow_pairs(_copies(t))
    return out.select("left_id", "right_id", "similarity", F.array_join("reasons", ",").alias("reasons"), "later_dropped")


@query(
    "dedup_stats",
    f"""WITH c AS ({_COPIES}), q AS (SELECT * FROM c WHERE publisher <> 'Sample Bad Press'), a AS (SELECT *, row_number() OVER (PARTITION BY {_DOI_KEY} ORDER BY seq) AS r1 FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY {sql_hash()} ORDER BY seq) AS r2 FROM a WHERE r1 = 1 OR {_DOI_KEY} IS NULL), e AS (SELECT * FROM b WHERE r2 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY {sql_title('title')}, year ORDER BY seq) AS r3 FROM e)
SELECT *, total_exact - total_after AS fuzzy_removed, total_before - total_after AS duplicates_removed FROM (SELECT (SELECT count(*) FROM c) AS total_before, (SELECT count(*) FROM e) AS total_exact,
 (SELECT count(*) FROM f WHERE r3 = 1) AS total_after, (SELECT count(*) FROM c WHERE publisher = 'Sample Bad Press') AS quarantined)""",
)
def _(t):
    """Totals along the pass; the last step keeps one row per equal title and year, which SQL can follow."""
    all_ = _copies(t)
    clean, held = filters.quarantine(all_, L.PREDATORY_SAMPLE)
    exact = dedup.dedup_exact(clean)
    after = windows.first_per_key(exact.withColumn("norm", F.nullif(text.norm_title(F.col("title")), F.lit(""))), ["norm", "year"], ["seq"])
    return dedup.dedup_stats(all_, exact, after, held)


@query(
    "dedup_hierarchical",
    f"""WITH c AS ({_COPIES}), k AS (SELECT work_id, unnest(['d' || ({_DOI_KEY}), CASE WHEN work_id % 10000000 < 100 THEN concat('p', CAST(work_id % 50 AS STRING)) END,
  CASE WHEN {sql_title('title')} <> '' THEN concat('t', {sql_hash()}) END]) AS key FROM c),
e AS (SELECT DISTINCT a.work_id AS u, b.work_id AS v FROM k a JOIN k b ON a.key = b.key),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
g AS (SELECT u AS work_id, min(v) AS group_id, count(DISTINCT v) AS group_size FROM r GROUP BY u)
SELECT c.work_id, coalesce(group_id, c.work_id) AS group_id, coalesce(group_size, 1) AS group_size, coalesce(group_id, c.work_id) = c.work_id AS is_canonical FROM c LEFT JOIN g ON c.work_id = g.work_id""",
)
def _(t):
    c = F.col
    doi = F.nullif(text.norm_doi(c("doi")), F.lit(""))
    pmid = F.when(c("work_id") % 10000000 < 100, (c("work_id") % 50).cast("string"))
    same = F.when(text.norm_title(c("title")) != "", text.dedup_hash(c("title"), c("year"), c("first_author")))
    out = dedup.dedup_hierarchical(_copies(t), [("doi", doi), ("pmid", pmid), ("database_id", F.lit(None).cast("string")), ("title_author_year", same)])
    return out.select("work_id", "group_id", "group_size", "is_canonical")


@query(
    "hierarchy_review",
    f"""WITH c AS ({_COPIES}), {_sql_firsts('c')},
near AS (SELECT a.id AS x, b.id AS y, a.norm AS a, b.norm AS b, greatest(length(a.norm), length(b.norm)) AS longest FROM firsts a JOIN firsts b ON b.year BETWEEN a.year - 1 AND a.year + 1 AND a.seq < b.seq
  WHERE a.norm <> '' AND b.norm <> '' AND least(length(a.norm), length(b.norm)) > {L.HIERARCHY_SIMILARITY} * greatest(length(a.norm), length(b.norm))),
marked AS (SELECT x, y FROM near WHERE 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / longest > {L.HIERARCHY_SIMILARITY}),
g AS (SELECT {_DOI_KEY} AS k, min(work_id) AS group_id, count(*) AS n, arg_min(work_id, seq) AS canonical_id FROM c WHERE {_DOI_KEY} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT c.work_id, coalesce(g.group_id, c.work_id) AS group_id, coalesce(g.canonical_id, c.work_id) = c.work_id AS is_canonical, CASE WHEN g.k IS NOT NULL THEN 'doi' END AS matched_level,
  c.work_id IN (SELECT x FROM marked UNION SELECT y FROM marked) AS needs_review FROM c LEFT JOIN g ON g.k = {_DOI_KEY}""",
)
def _(t):
    """Level 5 of the hierarchy: near-equal titles are only marked for review."""
    works = _copies(t)
    doi = F.nullif(text.norm_doi(F.col("doi")), F.lit(""))
    out = dedup.dedup_hierarchical(works, [("doi", doi)], dedup.title_lev_pairs(works, cover=True))
    return out.select("work_id", "group_id", "is_canonical", "matched_level", "needs_review")


@query(
    "levenshtein_sim",
    "SELECT uuid, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similarity FROM (SELECT uuid, regexp_replace(title_lib, '[^ -~]', '', 'g') AS a, regexp_replace(coalesce(title_auth, ''), '[^ -~]', '', 'g') AS b FROM ledger)",
)
def _(t):
    # the SQL side counts bytes, so both compare plain ASCII
    ascii_ = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^ -~]", "")
    a, b = ascii_("title_lib"), ascii_("title_auth")
    return t.ledger.select("uuid", F.round(text.levenshtein_sim(a, b), 6).alias("similarity"))


_TERMS = ["the", "and", "in"]


@query(
    "doi_intersection",
    "SELECT work_id FROM works WHERE lower(doi) IN (SELECT d FROM (" + " UNION ALL ".join(
        f"SELECT DISTINCT {lit(w)} AS term, lower(doi) AS d FROM works WHERE contains(lower(abstract), {lit(w)}) AND doi IS NOT NULL" for w in _TERMS
    ) + f") GROUP BY d HAVING count(*) = {len(_TERMS)})",
)
def _(t):
    """One scan finds the terms of each work; a DOI must be hit by every term."""
    low = F.lower("abstract")
    hits = t.works.select("doi", F.explode(F.filter(F.array(*[F.lit(w) for w in _TERMS]), lambda w: low.contains(w))).alias("term"))
    return dedup.doi_intersection(t.works, hits, len(_TERMS)).select("work_id")


@query(
    "companion_reports",
    """WITH r AS (SELECT work_id, work_id % 150 AS dataset, country AS content, CASE WHEN type IS NULL THEN 1 ELSE 0 END AS rank, seq FROM works),
p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rank, seq) AS a, row_number() OVER (PARTITION BY dataset, content ORDER BY rank, seq) AS b FROM r)
SELECT work_id, CASE WHEN a = 1 THEN 'primary' WHEN b > 1 THEN 'duplicate' ELSE 'companion' END AS report_role, CASE WHEN a = 1 THEN NULL WHEN b > 1 THEN 'E6' ELSE 'E7' END AS exclusion FROM p""",
)
def _(t):
    rows = t.works.select("work_id", (F.col("work_id") % 150).alias("dataset"), F.col("country").alias("content"), F.when(F.col("type").isNull(), 1).otherwise(0).alias("rank"), "seq")
    return dedup.companion_reports(rows, "dataset", "content", "rank").select("work_id", "report_role", "exclusion")


# --- Aggregates ------------------------------------------------------------------------


def _flat_tiers(t):
    return tiered(t.works).select("work_id", "country", "source", "year", "type", F.col("tier.peer_tier").alias("peer_tier"))


_Q = sql_map(L.TIER_QUALITY, "peer_tier", "0.1")


@query("tier_distribution", f"SELECT peer_tier, count(*) AS n FROM ({_sql_tier()}) GROUP BY peer_tier")
def _(t):
    return metrics.tier_distribution(_flat_tiers(t))


@query("evidence_quality", f"SELECT count(*) AS n, round(least(1.0, sum({_Q}::DOUBLE) / count(*)), 6) AS quality FROM ({_sql_tier()})")
def _(t):
    return metrics.evidence_quality(_flat_tiers(t)).withColumn("quality", F.round("quality", 6))


@query(
    "research_gaps",
    f"""WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE peer_tier = 4) AS t4, count(*) FILTER (WHERE peer_tier = 5) AS t5, count(*) FILTER (WHERE peer_tier = 6) AS t6,
  count(*) FILTER (WHERE peer_tier IN (1, 2)) AS sr FROM (SELECT work_id, greatest(peer_tier, 4) AS peer_tier FROM ({_sql_tier()})) t JOIN works w ON t.work_id = w.work_id)
SELECT 'no_rcts' AS gap, 'critical' AS severity, t4 || ' observational studies, ' || t5 || ' case series' AS present FROM f WHERE t4 + t5 > 5
UNION ALL SELECT 'no_systematic_reviews', 'warning', n || ' individual studies' FROM f WHERE sr = 0 AND n > 10
UNION ALL SELECT 'low_evidence', 'warning', (t5 + t6) || ' case series or unclassified' FROM f WHERE (0.6 * t4 + 0.3 * t5 + 0.1 * t6) / n < 0.3 AND n > 0
UNION ALL SELECT 'regional_gap', 'warning', n || ' international studies' FROM f WHERE n > 5""",
)
def _(t):
    """Gaps if all evidence were weak, seen from Malaysia: no tier is better than 4."""
    return metrics.research_gaps(_flat_tiers(t).withColumn("peer_tier", F.greatest("peer_tier", F.lit(4))), "MY")


@query(
    "prisma_funnel",
    """WITH x AS (SELECT * FROM screening WHERE reviewer_a = 'EXCLUDE'), p AS (SELECT count(*) AS n FROM screening WHERE reviewer_a = 'INCLUDE')
SELECT 'identified' AS stage, source AS key, count(*) AS n FROM works GROUP BY source
UNION ALL SELECT 'duplicates_removed', '', (SELECT count(*) - count(DISTINCT title) FROM works)
UNION ALL SELECT 'shadow_records', '', count(*) FROM works WHERE type IS NULL
UNION ALL SELECT 'screened', '', count(*) FROM works
UNION ALL SELECT 'excluded_ta', '', CAST(coalesce(sum(n_source_records), 0) AS BIGINT) FROM x WHERE phase = 'ta'
UNION ALL SELECT 'promoted', '', n FROM p
UNION ALL SELECT 'excluded_fulltext', '', CAST(coalesce(sum(n_source_records), 0) AS BIGINT) FROM x WHERE phase = 'fulltext'
UNION ALL SELECT 'included', '', greatest(0, n - (SELECT count(*) FROM x WHERE phase = 'fulltext')) FROM p
UNION ALL SELECT 'reason', reason, count(*) FROM x GROUP BY reason""",
)
def _(t):
    s = t.screening
    duplicates = t.works.agg((F.count("*") - F.countDistinct("title")).alias("n"))
    return metrics.prisma_funnel(t.works, s.filter("reviewer_a = 'EXCLUDE'"), s.filter("reviewer_a = 'INCLUDE'"), duplicates, t.works.filter("type IS NULL"))


_SPECS = {"wide": filters.all_of("the", "and"), "narrow": filters.all_of("zzzz", "qqqq"), "single": "a", "rare": filters.any_of("glaucoma", filters.none_of("the"))}


@query(
    "cardinality_plan",
    "SELECT spec, estimated, CAST(n AS INT) AS n_terms, CASE WHEN estimated <= 500 THEN 'direct' WHEN n >= 2 THEN 'doi_intersection' ELSE 'user_alert' END AS strategy FROM ("
    + """SELECT 'wide' AS spec, count(*) FILTER (WHERE contains(h, 'the') OR contains(h, 'and')) AS estimated, 2 AS n FROM h UNION ALL SELECT 'narrow', count(*) FILTER (WHERE contains(h, 'zzzz') OR contains(h, 'qqqq')), 2 FROM h
UNION ALL SELECT 'single', count(*) FILTER (WHERE contains(h, 'a')), 1 FROM h UNION ALL SELECT 'rare', count(*) FILTER (WHERE contains(h, 'glaucoma') OR NOT contains(h, 'the')), 2 FROM h)""".replace(
        "FROM h", "FROM (SELECT lower(concat_ws(' ', title, abstract)) AS h FROM works)"
    ),
)
def _(t):
    return metrics.cardinality_plan(t.works, _SPECS, limit=500)


@query(
    "verification_summary",
    """SELECT count(*) AS papers, count(*) FILTER (WHERE k > 0) AS with_trial_ids, count(*) FILTER (WHERE k = 2) AS regional, count(*) FILTER (WHERE k = 1) AS verified, count(*) FILTER (WHERE k = 0) AS unverified
FROM (SELECT CASE WHEN regexp_matches(title, 'NCT[0-9]{8}') AND is_oa THEN 1 WHEN regexp_matches(title, 'NCT[0-9]{8}') THEN 2 ELSE 0 END AS k FROM works)""",
)
def _(t):
    extra = F.when(~F.col("is_oa") & F.col("title").rlike("NCT[0-9]{8}"), "ChiCTR1234567")
    ids = textops.trial_ids(t.works.withColumn("extra", extra), ["title", "extra"])
    return metrics.verification_summary(ids, t.works)


@query(
    "ledger_stats",
    f"""SELECT s.state, count(l.uuid) AS n, count(*) FILTER (WHERE year_lib <> year_auth) AS needs_correction, count(*) FILTER (WHERE l.state = 'PATCHED') AS approved
FROM (VALUES {', '.join(f"('{s}')" for s in L.LEDGER_STATES)}) s(state) LEFT JOIN (SELECT uuid, CASE WHEN state = 'FETCHED' THEN 'DIFFED' ELSE state END AS state, year_lib, year_auth FROM ledger) l ON s.state = l.state GROUP BY s.state""",
)
def _(t):
    """All rows, with those of one state moved on, so that a state without rows still has its line."""
    moved = t.ledger.withColumn("state", F.when(F.col("state") == "FETCHED", "DIFFED").otherwise(F.col("state")))
    marked = moved.withColumn("needs_correction", F.col("year_lib") != F.col("year_auth")).withColumn("approved", F.col("state") == "PATCHED")
    return metrics.ledger_stats(marked)


_PAGES_SQL = "[CAST(event_id % 30 AS INT), CAST(event_id % 7 AS INT)]"


@query(
    "feedback_stats",
    f"""WITH f AS (SELECT event_id AS seq, rating, category, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('note ', CAST(event_id AS STRING)) END AS description FROM jobs),
pg AS (SELECT page, count(*) AS n FROM (SELECT event_id % 30 AS page FROM jobs UNION ALL SELECT event_id % 7 FROM jobs) GROUP BY page ORDER BY n DESC, page LIMIT 20),
c AS (SELECT category, count(*) AS n, min_by(substr(description, 1, 120), CASE WHEN description <> '' THEN seq END) AS sample FROM f GROUP BY category)
SELECT 'total' AS section, '' AS key, count(*) AS n, NULL AS sample FROM f UNION ALL SELECT 'rating', rating, count(*), NULL FROM f GROUP BY rating
UNION ALL SELECT 'category', category, n, NULL FROM c UNION ALL SELECT 'page', CAST(page AS STRING), n, NULL FROM pg
UNION ALL (SELECT 'issue', category, n, sample FROM c ORDER BY n DESC, category LIMIT 5)""",
)
def _(t):
    e = F.col("event_id")
    rows = t.jobs.select(
        e.alias("seq"), "rating", "category", F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("note "), e.cast("string"))).alias("description"),
        F.array((e % 30).cast("int"), (e % 7).cast("int")).alias("page_numbers"),
    )
    return metrics.feedback_stats(rows)


@query(
    "latency_summary",
    """WITH r AS (SELECT source, latency_ms, row_number() OVER (PARTITION BY source ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM calls WHERE latency_ms IS NOT NULL)
SELECT source, max(n) AS n, round(avg(latency_ms), 6) AS mean, max(latency_ms) AS max, max(CASE WHEN i = floor(n * 0.5) THEN latency_ms END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN latency_ms END) AS p95 FROM r GROUP BY source""",
)
def _(t):
    return metrics.latency_summary(t.calls, ["source"], "latency_ms", 0.5).withColumn("mean", F.round("mean", 6))


def _spans(t):
    start = F.unix_millis("ts")
    status = F.when(F.col("status") == "failed", "error").otherwise("ok")
    return t.jobs.select(
        F.concat_ws("-", "job_id", F.date_format("ts", "yyyyMMdd")).alias("trace_id"), "event_id", start.alias("start_ms"), (start + F.floor(F.col("duration_ms") * 1000)).alias("end_ms"), status.alias("status")
    )


_SPANS = "SELECT concat_ws('-', job_id, strftime(ts, '%Y%m%d')) AS trace_id, event_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(duration_ms * 1000) AS BIGINT) AS end_ms, CASE WHEN status = 'failed' THEN 'error' ELSE 'ok' END AS status FROM jobs"


@query(
    "trace_summary",
    f"""SELECT trace_id, max(end_ms) - min(start_ms) AS total_ms, count(*) AS spans, min(end_ms - start_ms) AS fastest_ms, max(end_ms - start_ms) AS slowest_ms, count(*) FILTER (WHERE status = 'error') AS errors FROM ({_SPANS}) GROUP BY trace_id""",
)
def _(t):
    return metrics.trace_summary(_spans(t))


@query(
    "waterfall",
    f"""SELECT event_id, CASE WHEN t1 > t0 THEN round((start_ms - t0) / (t1 - t0) * 100, 4) ELSE 0 END AS offset_pct, CASE WHEN t1 > t0 THEN round((end_ms - start_ms) / (t1 - t0) * 100, 4) ELSE 0 END AS width_pct
FROM (SELECT *, min(start_ms) OVER (PARTITION BY trace_id) AS t0, max(end_ms) OVER (PARTITION BY trace_id) AS t1 FROM ({_SPANS}))""",
)
def _(t):
    return windows.waterfall(_spans(t)).select("event_id", "offset_pct", "width_pct")


@query("pass_rate", "SELECT phase, count(*) AS n, round(count(*) FILTER (WHERE status <> 'failed') * 100.0 / count(*), 4)::DOUBLE AS rate, count(*) FILTER (WHERE status <> 'failed') * 100.0 / count(*) >= 90 AS gate FROM jobs GROUP BY phase")
def _(t):
    return metrics.pass_rate(t.jobs, F.col("status") != "failed", 90.0, ("phase",))


@query("modal_value", """WITH c AS (SELECT page_id, font_size, count(*) AS n FROM boxes GROUP BY ALL) SELECT page_id, font_size AS modal FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, font_size) AS rn FROM c) WHERE rn = 1""")
def _(t):
    return metrics.modal_value(t.boxes, ["page_id"], "font_size")


_KAPPA = """WITH s AS (SELECT * FROM screening {where}), c AS (SELECT reviewer_a AS a, reviewer_b AS b, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same FROM c),
m AS (SELECT sum(na * nb) AS chance FROM (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE a = label) AS na, (SELECT coalesce(sum(n), 0) FROM c WHERE b = label) AS nb FROM (SELECT a AS label FROM c UNION SELECT b FROM c)))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS observed, round(chance / (n * n), 6) AS expected, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM t, m"""


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("cohen_kappa", _KAPPA.format(where=""))
def _(t):
    return _rounded(metrics.cohen_kappa(t.screening, "reviewer_a", "reviewer_b", "paper_id"), "observed", "expected", "kappa")


@query("cohen_kappa_sample", _KAPPA.format(where="WHERE CAST(concat('0x', substr(md5(CAST(paper_id AS STRING)), 1, 8)) AS BIGINT) % 10 = 0"))
def _(t):
    """The calibration gate of the method: agreement on one paper in ten."""
    return _rounded(metrics.cohen_kappa(t.screening, "reviewer_a", "reviewer_b", "paper_id", sample_of=10), "observed", "expected", "kappa")


@query(
    "frequency_tables",
    """SELECT 'type' AS dimension, type AS value, count(*) AS n FROM works GROUP BY type UNION ALL SELECT 'country', country, count(*) FROM works GROUP BY country
UNION ALL SELECT 'year', CAST(year AS STRING), count(*) FROM works GROUP BY year UNION ALL SELECT 'publisher', publisher, count(*) FROM works GROUP BY publisher""",
)
def _(t):
    return metrics.frequency_tables(t.works, ["type", "country", "year", "publisher"])


_LANGS = ["de", "en", "es", "fr"]


@query("evidence_map", "SELECT type, " + ", ".join(f"count(*) FILTER (WHERE country = '{c}') AS {c}" for c in _LANGS) + " FROM works GROUP BY type")
def _(t):
    return metrics.evidence_map(t.works, "type", "country", _LANGS)


@query(
    "gap_matrix",
    f"""WITH g AS (SELECT DISTINCT publisher, c.country FROM works, (VALUES {', '.join(f"('{c}')" for c in _LANGS + ['it'])}) c(country)), n AS (SELECT publisher, country, count(*) AS n FROM works WHERE type IS NOT NULL GROUP BY ALL)
SELECT g.publisher, g.country, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'none' ELSE 'thin' END AS gap FROM g LEFT JOIN n ON g.publisher = n.publisher AND g.country = n.country WHERE coalesce(n, 0) < 40""",
)
def _(t):
    return metrics.gap_matrix(t.works, "publisher", "country", _LANGS + ["it"], 40, F.col("type").isNotNull())


def _qc_inputs(t):
    raw = t.works_raw.withColumn("record_hash", F.sha2(F.concat_ws("|", "seq", "title"), 256))
    manifest = raw.groupBy("source").agg(F.count("*").alias("n_records"), textops.multiset_hash(F.col("record_hash")).alias("content_hash")).withColumn(
        "n_records", F.when(F.col("source") == "src3", F.col("n_records") + 1).otherwise(F.col("n_records"))
    )
    return raw, manifest


@query(
    "qc_checks",
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE title <> '' AND doi_any <> '') AS full_, count(DISTINCT source) AS k FROM works_raw)
SELECT 'record_count' AS "check", round((k - 1) / k, 6) AS value, false AS passed FROM s UNION ALL SELECT 'hash_match', 1.0, true FROM s UNION ALL SELECT 'all_records_parsed', 1.0, true FROM s
UNION ALL SELECT 'metadata_complete', round(full_ / n, 6), full_ / n > 0.95 FROM s UNION ALL SELECT 'provenance_tagged', 1.0, true FROM s UNION ALL SELECT 'batches_present', 1.0, true FROM s""",
)
def _(t):
    raw, manifest = _qc_inputs(t)
    return metrics.qc_checks(raw, t.works_raw, manifest, ["title", "doi_any"])


@query(
    "batch_total",
    """SELECT search_id, count(*) AS batches, CAST(sum(exported) AS BIGINT) AS exported, max(CAST(displayed AS BIGINT)) AS displayed, count(*) FILTER (WHERE exported >= 20) AS capped_batches, sum(exported) = max(displayed) AS complete
FROM (SELECT search_id, page, count(*) AS exported, sum(count(*)) OVER (PARTITION BY search_id) + max(CASE WHEN search_id = 'q3' THEN 1 ELSE 0 END) AS displayed FROM calls GROUP BY search_id, page) GROUP BY search_id""",
)
def _(t):
    exported = t.calls.groupBy("search_id", "page").agg(F.count("*").alias("exported"))
    shown = t.calls.groupBy("search_id").agg((F.count("*") + F.max(F.when(F.col("search_id") == "q3", 1).otherwise(0))).alias("displayed"))
    return metrics.batch_total(exported.join(shown, "search_id").withColumn("export_cap", F.lit(20)))


# --- Vocabulary, trial ids, anchors, hashes ------------------------------------------------

_WORDS = "SELECT DISTINCT term FROM (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) AS term FROM documents UNION ALL SELECT lang FROM documents)"


# a small vocabulary over words of the test documents, and one regional overlay
# (term, synonyms, broader terms, weight)
VOCAB = [
    ("the", ["les", "des"], ["article"], 1.0),
    ("and", ["on", "ou"], ["link"], 0.9),
    ("on", ["se"], ["place"], 0.8),
    ("in", ["from", "on"], ["place"], 0.7),
]
# (region, kind, key, value)
OVERLAY = [("MY", "exclusion", "from", None), ("MY", "addition", "was", "verb"), ("MY", "mapping", "the", "anon"), ("SG", "mapping", "in", "was")]


def _sql_vocab() -> str:
    rows = ", ".join(f"({n}, {lit(t)}, {listed(s)}, {listed(b)}, {w}::DOUBLE)" for n, (t, s, b, w) in enumerate(VOCAB))
    return f"""ent(ordinal, term, synonyms, broader, weight) AS (VALUES {rows}),
allk AS (SELECT term AS key, term, synonyms, broader, weight, 0 AS kind, -ordinal AS place, 0 AS ord FROM ent UNION ALL SELECT synonyms[i], term, synonyms, broader, weight * 0.9, 1, ordinal, i FROM ent, range(1, 10) r(i) WHERE i <= len(synonyms)),
voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY kind, place, ord) AS rn FROM allk) WHERE rn = 1)"""


def _terms(t):
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +", " ")), " ")
    return t.documents.select(F.explode(F.concat(words, F.array("lang"))).alias("term")).distinct()


@query(
    "build_vocab",
    f"WITH {_sql_vocab()}, w AS ({_WORDS}) SELECT w.term, v.term AS entry, round(v.weight, 6) AS weight FROM w JOIN voc v ON w.term = v.key",
)
def _(t):
    vocab = textops.build_vocab(textops.vocab_table(t.spark, VOCAB))
    return _terms(t).join(vocab.select(F.col("key").alias("term"), F.col("term").alias("entry"), F.round("weight", 6).alias("weight")), "term")


_LOOKUP = f"""WITH {_sql_vocab()}, w AS ({_WORDS}),
j AS (SELECT w.term, CASE WHEN w.term = 'from' THEN NULL WHEN w.term = 'was' THEN 'was' ELSE v.term END AS entry, CASE WHEN w.term = 'was' THEN [] ELSE v.synonyms END AS syn,
  CASE WHEN w.term = 'was' THEN ['verb'] ELSE v.broader END AS broad FROM w LEFT JOIN voc v ON v.key = CASE WHEN w.term = 'anon' THEN 'the' ELSE w.term END)"""


@query("lookup_terms", f"{_LOOKUP} SELECT term, entry FROM j")
def _(t):
    vocab, overlay = textops.build_vocab(textops.vocab_table(t.spark, VOCAB)), textops.overlay_table(t.spark, OVERLAY)
    return textops.lookup_terms(_terms(t), vocab, overlay, "MY").select("term", F.col("entry_term").alias("entry"))


@query("expand_terms", f"{_LOOKUP} SELECT DISTINCT term, unnest(CASE WHEN entry IS NULL THEN [term] ELSE list_concat([entry], syn, broad) END) AS expansion FROM j")
def _(t):
    vocab, overlay = textops.build_vocab(textops.vocab_table(t.spark, VOCAB)), textops.overlay_table(t.spark, OVERLAY)
    return textops.expand_terms(_terms(t), vocab, overlay, "MY")


@query("trial_ids", "SELECT work_id, 'NCT' AS registry, regexp_extract(title, 'NCT[0-9]{8}') AS trial_id, CAST(1.0 AS DOUBLE) AS confidence FROM works WHERE regexp_matches(title, '\\bNCT[0-9]{8}\\b')")
def _(t):
    return textops.trial_ids(t.works, ["title", "abstract"]).select("work_id", "registry", "trial_id", "confidence")


_MIXED = "concat(title, CASE work_id % 4 WHEN 0 THEN ' isrctn12345678 EUCTR2015-001234-21' WHEN 1 THEN ' CTRI/2019/03 RBR-abc123' WHEN 2 THEN ' nct00000001' ELSE '' END)"


@query(
    "primary_trial",
    """SELECT work_id, CASE WHEN work_id % 6 = 3 THEN regexp_extract(title, 'NCT[0-9]{8}') WHEN work_id % 4 = 0 THEN 'EUCTR2015-001234-21' WHEN work_id % 4 = 1 THEN 'CTRI/2019/03' ELSE 'NCT00000001' END AS trial_id,
  CAST(CASE WHEN work_id % 6 = 3 OR work_id % 4 = 0 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence FROM works WHERE work_id % 6 = 3 OR work_id % 4 <> 3""",
)
def _(t):
    ids = textops.trial_ids(t.works.withColumn("all_text", F.expr(_MIXED.replace("substr", "substr"))), ["all_text"])
    return windows.primary_trial(ids).select("work_id", "trial_id", "confidence")


@query(
    "anchor_exact",
    """SELECT doc_id, CAST(CASE WHEN length(text) >= 60 THEN instr(lower(text), lower(substr(text, 31, 30))) - 1 ELSE instr(lower(text), lower(substr(text, 1, 12))) - 1 END AS INT) AS start, CAST(1.0 AS DOUBLE) AS similarity FROM documents WHERE text <> ''""",
)
def _(t):
    claim = F.when(F.length("text") >= 60, F.substring("text", 31, 30)).otherwise(F.substring("text", 1, 12))
    rows = t.documents.filter("text <> ''").select("doc_id", "text", claim.alias("claim"))
    return textops.fuzzy_anchor(rows).select("doc_id", "start", "similarity")


@query("anchor_fuzzy")
def _(t):
    """Claims cut from the texts with letters changed, found again in the whole texts."""
    claim = F.translate(F.substring("text", 41, 48), "aet", "xqz")
    light = F.concat(F.substring("text", 41, 20), F.lit("#@"), F.substring("text", 63, 26))
    rows = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, light).otherwise(claim).alias("claim"))
    return textops.fuzzy_anchor(rows).select("doc_id", "start", "end", F.round("similarity", 6).alias("similarity"))


@query(
    "parse_summary",
    """SELECT doc_id, substr(text, 1, 20) AS claim, CAST(-1 AS INT) AS missing_start, CASE WHEN doc_id % 2 = 0 THEN 'population' ELSE 'population,outcome' END AS kinds FROM documents""",
)
def _(t):
    ent = lambda kind, c: F.struct(F.col("lang").alias("entity"), F.lit(kind).alias("type"), F.lit(c).alias("confidence"))
    body = F.to_json(F.struct(
        F.struct(F.substring("text", 1, 20).alias("claim"), F.lit(3).alias("start")).alias("context"),
        F.array(ent("population", 0.9), ent("weather", 0.99), ent("outcome", 0.3), F.when(F.col("doc_id") % 2 == 1, ent("outcome", 0.7))).alias("verifiableEntities"),
    ))
    out = textops.parse_summary(t.documents.select("doc_id", body.alias("summary_json")))
    return out.select("doc_id", F.col("context.claim").alias("claim"), F.col("method.start").alias("missing_start"), F.array_join(F.transform("entities", lambda e: e["type"]), ",").alias("kinds"))


@query(
    "schema_drift",
    """WITH f AS (SELECT DISTINCT unnest(json_keys(props)) AS path FROM events) SELECT path, 'gone' AS drift FROM (VALUES ('removed_field')) v(path) UNION ALL SELECT path, 'new' FROM f WHERE path <> 'k'""",
)
def _(t):
    """Fields of the event properties against an expected shape."""
    seen = textops.json_fields(t.events, "props")
    expected = t.spark.createDataFrame([("removed_field", "string")], "path string, type string").unionByName(seen.filter("path = 'k'"))
    drift = textops.schema_drift(expected, seen, ["removed_field"])
    return drift.select("path", F.when(F.col("drift") == "added", "new").otherwise("gone").alias("drift"))


_ROW_HASH = f"sha256(concat_ws('|', CAST(work_id AS STRING), coalesce(doi, ''), CASE WHEN coalesce(abstract, '') = '' THEN '' ELSE sha256({sql_trim('lower(abstract)')}) END))"


@query("abstract_hash", f"SELECT work_id, CASE WHEN coalesce(abstract, '') = '' THEN '' ELSE sha256({sql_trim('lower(abstract)')}) END AS abstract_hash FROM works")
def _(t):
    return t.works.select("work_id", text.abstract_hash(F.col("abstract")).alias("abstract_hash"))


_PART = lambda at: f"CAST(sum(CAST(CAST(concat('0x', substr(h, {at}, 12)) AS BIGINT) AS HUGEINT)) AS STRING)"


@query("manifest_hash", f"SELECT count(*) AS papers, sha256(concat_ws(':', CAST(count(h) AS STRING), {_PART(1)}, {_PART(13)}, {_PART(25)}, {_PART(37)})) AS manifest_hash FROM (SELECT {_ROW_HASH} AS h FROM works)")
def _(t):
    return textops.manifest_hash(t.works)


# --- Ledger and screening ------------------------------------------------------------------

_UPDATES = """SELECT uuid, CASE uuid % 3 WHEN 0 THEN 'FETCHED' WHEN 1 THEN 'DIFFED' ELSE 'PATCHED' END AS state, CASE WHEN uuid % 2 = 0 THEN 'new title' END AS title_lib FROM ledger WHERE uuid % 4 <> 0
UNION ALL SELECT uuid + 50000000, 'DISCOVERED', 'fresh' FROM ledger WHERE state = 'PATCHED'"""
_STEP = "(l.uuid IS NULL OR l.state = u.state OR concat(l.state, '>', u.state) IN (" + ", ".join(lit(f"{a}>{b}") for a, b in L.LEDGER_STEPS) + "))"


@query(
    "upsert_state",
    f"""WITH u AS ({_UPDATES}) SELECT coalesce(l.uuid, u.uuid) AS uuid, CASE WHEN u.uuid IS NOT NULL AND {_STEP} THEN u.state ELSE l.state END AS state,
  CASE WHEN u.uuid IS NOT NULL AND {_STEP} THEN coalesce(u.title_lib, l.title_lib) ELSE l.title_lib END AS title_lib, coalesce(NOT {_STEP}, false) AND u.uuid IS NOT NULL AS refused FROM ledger l FULL JOIN u ON l.uuid = u.uuid""",
)
def _(t):
    new, refused = ledger_ops.upsert_state(t.ledger.select("uuid", "state", "title_lib"), t.sql(_UPDATES))
    marks = refused.select("uuid", F.lit(True).alias("refused"))
    return new.join(marks, "uuid", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


#: Up to five updates of a job, in order, over a ledger that has some of them.
_BATCH = """SELECT concat('u', CAST(user_id % 40 AS STRING)) AS uuid, event_id AS no,
 CASE event_type WHEN 'signup' THEN 'DISCOVERED' WHEN 'view' THEN 'FETCHED' WHEN 'click' THEN 'DIFFED' WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'PATCHED' END AS state,
 CASE WHEN event_id % 3 = 0 THEN concat('title ', CAST(event_id AS STRING)) END AS title_lib FROM events"""
_HELD = "SELECT concat('u', CAST(uuid AS STRING)) AS uuid, state, title_lib FROM ledger WHERE uuid % 3 <> 1"


@query(
    "upsert_batch",
    f"""WITH u AS ({_BATCH}), h AS ({_HELD}), n AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY no) AS turn FROM u),
step AS (SELECT k.uuid, 0::BIGINT AS turn, h.state, h.title_lib, NULL::BIGINT AS no, NULL::BOOLEAN AS applied, NULL::VARCHAR AS was FROM (SELECT DISTINCT uuid FROM u) k LEFT JOIN h ON h.uuid = k.uuid
  UNION ALL SELECT l.uuid, u.turn, CASE WHEN ok THEN coalesce(u.state, l.state) ELSE l.state END, CASE WHEN ok THEN coalesce(u.title_lib, l.title_lib) ELSE l.title_lib END, u.no, ok, l.state
  FROM (SELECT l.*, n.turn AS next, n.state AS wish, n.title_lib AS given, n.no AS own,
          CASE WHEN n.state IS NULL THEN l.state IS NOT NULL ELSE l.state IS NULL OR l.state = n.state OR concat(l.state, '>', n.state) IN ({", ".join(lit(f"{a}>{b}") for a, b in L.LEDGER_STEPS)}) END AS ok
        FROM step l JOIN n ON n.uuid = l.uuid AND n.turn = l.turn + 1) l, LATERAL (SELECT l.next AS turn, l.wish AS state, l.given AS title_lib, l.own AS no) u),
ends AS (SELECT uuid, arg_max(struct_pack(s := state, t := title_lib), turn) AS e, count_if(NOT applied) AS n_refused FROM step GROUP BY uuid)
SELECT coalesce(h.uuid, e.uuid) AS uuid, CASE WHEN e.uuid IS NULL THEN h.state ELSE e.e.s END AS state, CASE WHEN e.uuid IS NULL THEN h.title_lib ELSE e.e.t END AS title_lib, CAST(coalesce(n_refused, 0) AS BIGINT) AS n_refused
FROM h FULL JOIN ends e ON h.uuid = e.uuid""",
)
def _(t):
    """Many updates of a key in one batch, applied one after the other."""
    new, refused = ledger_ops.upsert_state(t.sql(_HELD), t.sql(_BATCH), order=["no"])
    counts = refused.groupBy("uuid").agg(F.count("*").alias("n_refused"))
    return new.join(counts, "uuid", "left").withColumn("n_refused", F.coalesce("n_refused", F.lit(0)).cast("long"))


@query("override_lock", "SELECT uuid, last_modified > CAST('2024-01-15' AS DATE) - 180 AS locked FROM ledger")
def _(t):
    return ledger_ops.override_lock(t.ledger, "2024-01-15 00:00:00").select("uuid", "locked")


def _corrected(t):
    diffs = joins.authority_diff(t.ledger)
    return diffs.drop("corrections", "authority")


@query(
    "apply_corrections",
    """SELECT uuid, CASE WHEN state = 'APPROVED' AND year_lib <> year_auth THEN year_auth ELSE year_lib END AS year_lib,
  CASE WHEN state = 'APPROVED' AND (year_lib <> year_auth OR authors_auth = 'Smith J') THEN coalesce(CASE WHEN authors_auth = 'Smith J' THEN authors_auth END, authors_lib) ELSE authors_lib END AS authors_lib FROM ledger""",
)
def _(t):
    new, _audit, _missing = ledger_ops.apply_corrections(_corrected(t), t.ledger)
    return new.select("uuid", "year_lib", "authors_lib")


@query("apply_corrections_refused", "SELECT state, count(*) AS n FROM ledger GROUP BY state")
def _(t):
    """Approved rows without a snapshot: nothing is applied."""
    new, _audit, _missing = ledger_ops.apply_corrections(_corrected(t), t.ledger.filter("uuid % 2 = 0"))
    return new.groupBy("state").agg(F.count("*").alias("n"))


@query(
    "rollback",
    """SELECT uuid, CASE WHEN state = 'PATCHED' THEN 'bad' ELSE title_lib END AS title_lib, CASE WHEN state = 'PATCHED' OR uuid % 7 = 0 THEN 1 ELSE year_lib END AS year_lib FROM ledger""",
)
def _(t):
    broken = t.ledger.withColumn("title_lib", F.lit("bad")).withColumn("year_lib", F.lit(1))
    snap = t.ledger.withColumn("year_lib", F.when(F.col("uuid") % 7 == 0, 0).otherwise(F.col("year_lib")))
    done = t.ledger.filter("state = 'PATCHED'").select("uuid")
    return ledger_ops.rollback(broken, snap, done).select("uuid", "title_lib", "year_lib")


@query("verify_applied", "SELECT uuid, uuid % 2 = 0 AS verified FROM ledger WHERE year_lib <> year_auth")
def _(t):
    payload = F.to_json(F.struct(F.concat(F.lit("  "), "title_lib", F.lit(" ")).alias("title"), F.when(F.col("uuid") % 2 == 0, F.col("year_lib")).otherwise(0).cast("string").alias("year")))
    asked = t.ledger.filter("year_lib <> year_auth").select("uuid", payload.alias("correction_json"))
    return ledger_ops.verify_applied(t.ledger, asked)


_OUTCOMES = "SELECT user_id AS uuid, event_type <> 'error' AS ok, event_id AS at_no FROM events"


@query("resume", f"WITH o AS ({_OUTCOMES}), l AS (SELECT uuid, max_by(ok, at_no) AS ok FROM o GROUP BY uuid) SELECT uuid FROM ledger WHERE uuid NOT IN (SELECT uuid FROM l WHERE ok)")
def _(t):
    return ledger_ops.resume(t.ledger, t.sql(_OUTCOMES).withColumnRenamed("at_no", "at")).select("uuid")


@query("outcome_lists", f"SELECT uuid, CASE WHEN max_by(ok, at_no) THEN 'completed' ELSE 'failed' END AS outcome FROM ({_OUTCOMES}) GROUP BY uuid")
def _(t):
    return ledger_ops.outcome_lists(t.sql(_OUTCOMES).withColumnRenamed("at_no", "at"))


@query(
    "cached_lookup",
    """WITH c AS (SELECT search_id AS key, max_by(CAST(latency_ms AS STRING), event_id) AS payload FROM calls WHERE source <> 's2' GROUP BY search_id), k AS (SELECT DISTINCT search_id AS key FROM calls)
SELECT k.key, CASE WHEN c.key IS NOT NULL THEN 'hit' ELSE 'fetch' END AS outcome FROM k LEFT JOIN c ON k.key = c.key""",
)
def _(t):
    cache = t.calls.filter("source <> 's2'").select(F.col("search_id").alias("key"), F.col("latency_ms").cast("string").alias("payload"), F.col("event_id").alias("cached_at"))
    hits, misses = ledger_ops.cached_lookup(t.calls.select(F.col("search_id").alias("key")).distinct(), cache)
    return hits.select("key", F.lit("hit").alias("outcome")).unionByName(misses.select("key", F.lit("fetch").alias("outcome")))


@query(
    "screen",
    """SELECT paper_id, CASE WHEN reviewer_a = 'INCLUDE' THEN 'promote' ELSE 'exclude' END AS action, CASE WHEN reviewer_a = 'INCLUDE' THEN 'ta' ELSE phase END AS phase,
  CASE WHEN reviewer_a <> 'INCLUDE' THEN reason END AS reason, CASE WHEN paper_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_source_records FROM screening""",
)
def _(t):
    s = t.screening
    action = F.when(F.col("reviewer_a") == "INCLUDE", "promote").otherwise("exclude").alias("action")
    flags = s.filter("paper_id % 2 = 0").select(F.col("paper_id").alias("paired_id"), F.lit("other").alias("paired_source"), F.lit("none").alias("paired_title"))
    records = joins.source_records(s.select("paper_id", "source", F.lit("x").alias("title")), flags)
    out = ledger_ops.screen(s.select("paper_id"), s.select("paper_id", action, "reason", "phase"), records)
    return out.select("paper_id", "action", "phase", "reason", "n_source_records")


@query(
    "screen_dual",
    """SELECT paper_id, decision, decision IN ('INCLUDE', 'UNCERTAIN') AS to_full_text FROM (SELECT paper_id, CASE WHEN reviewer_a = reviewer_b THEN reviewer_a WHEN paper_id % 3 = 0 THEN 'UNCERTAIN' ELSE 'CONFLICT' END AS decision FROM screening)""",
)
def _(t):
    return ledger_ops.screen_dual(t.screening.withColumn("third", F.when(F.col("paper_id") % 3 == 0, "UNCERTAIN"))).select("paper_id", "decision", "to_full_text")


@query(
    "spot_check",
    """WITH s AS (SELECT * FROM screening WHERE CAST(concat('0x', substr(md5(CAST(paper_id AS STRING)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.30)
SELECT 'decision' AS field, count(*) AS charted, count(*) FILTER (WHERE reviewer_a <> reviewer_b) AS discrepancies FROM s UNION ALL SELECT 'phase', count(*), 0 FROM s""",
)
def _(t):
    chart = lambda r: t.screening.select("paper_id", F.col(r).alias("decision"), "phase")
    return ledger_ops.spot_check(chart("reviewer_a"), chart("reviewer_b"), ["decision", "phase"])
