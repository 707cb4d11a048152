"""One query per operator, on its whole table with production parameters, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, line_dedup, manifest, mixing, near_dedup, packing, quality, spelling, substring_dedup, token_store, toxicity, window_packing
from .common import stored
from .registry import ORACLES, QUERIES, query, table  # noqa: F401

#: Words, in DuckDB: split at ASCII white space, empty pieces dropped.
SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL_NEAR = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]))) END AS s
  FROM split
), classes AS (
  SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT c, n, unnest(s) AS g FROM classes
), pairs AS (
  SELECT a.c AS u, b.c AS v, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c
), links AS (
  SELECT u, v FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT c AS node, c AS root FROM classes
  UNION
  SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node
), least_root AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, coalesce(l.root, x.doc_id) AS component_id, coalesce(l.root, x.doc_id) = x.doc_id AS kept
FROM sets x LEFT JOIN classes c ON x.s = c.s LEFT JOIN least_root l ON l.node = c.c
"""


@query("op1_near_dedup", SQL_NEAR)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.near_dedup(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


SQL_MIX = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM rows GROUP BY source
), fill AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS lim,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM named
), levelled AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM fill
), targets AS (
  SELECT source, source_size, least(lim, coalesce(arg_min(level, (lim / weight, no)) FILTER (WHERE level <= lim / weight) OVER () * weight, lim)) AS target FROM levelled
), walked AS (
  SELECT r.*, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.ord, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM walked
)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (passes + CASE WHEN ends - size / 2.0 < target - passes * source_size AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taken
"""


@query("op2_mix_sources", SQL_MIX)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixed_by_curriculum(mixing.mix(table(spark, folder, "documents")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


_LIST = lambda items: "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"

SQL_QUALITY = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, {SQL_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, CAST(sum(step) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3), 3) AS step FROM again) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS nl, len(list_filter(ws, lambda w: list_contains({_LIST(quality.STOP_WORDS)}, w))) AS stops,
         len(list_filter(ls, lambda l: ends_with(l, '...') OR ends_with(l, '…'))) AS dots,
         len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND stops >= 2
       AND n_dup_lines / nl <= 0.5 AND dots / nl <= 0.5 AND bullets / nl <= 0.9 AS kept
FROM base
"""


@query("op3_quality_rules", SQL_QUALITY)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality_rules(docs, out="q").select("doc_id", *[F.col(f"q.{f}").alias(f) for f in fields])


_PROBE = "</s>[INST] ok [/INST]"

SQL_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'
), sized AS (
  SELECT *, {len(chat.START) + len(chat.END) + 2} + length(role) + length(regexp_replace(text, '{chat.ESCAPE}', '\\1\\\\\\2\\3', 'g')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns
), run AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""


@query("op4_chat_format", SQL_CHAT)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], turns.schema)
    return chat.summary(stored(chat.examples(turns.unionByName(probe)), "chat-examples"))


SQL_EXACT = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), kept AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM kept
"""


@query("op6_exact_dedup", SQL_EXACT)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = exact.exact_dedup(table(spark, folder, "documents"), exact.fresh_index(spark))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL_LINES = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, h.last_doc IS NOT NULL AND h.last_doc <> l.doc_id AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", SQL_LINES)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex(spark)
    index.add(docs)
    out = index.clean(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


@query("op5_token_store")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    store = token_store.write_store(docs)
    found = store.locate(docs.select("doc_id").distinct()).unionByName(store.without_key())
    return token_store.digests(store.read(found))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    cut = stored(packing.pieces(table(spark, folder, "documents")), "pieces")
    packed = packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    fold = lambda key: F.crc32(key.cast("string").cast("binary")) % 5
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "toxic")
    scored = toxicity.score_toxicity(docs, labels, teach=lambda key: fold(key) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_window_packing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    packed = window_packing.window_pack(table(spark, folder, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _sql_crc(of: str, key: str) -> str:
    """CTEs `crc_table` and `crcs` (key, h): the unsigned crc32 of the UTF-8 strings `key` of the CTE `of`."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""
crc_steps AS (
  SELECT i AS b, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, {step} FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT b, c FROM crc_steps WHERE k = 8
), crc_run AS (
  SELECT {key} AS key, hex(encode({key})) AS h, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT {key} FROM {of})
  UNION ALL
  SELECT r.key, r.h, r.i + 1, xor(r.c // 256, t.c) FROM crc_run r JOIN crc_table t
    ON t.b = xor(r.c % 256, CAST('0x' || substr(r.h, 2 * r.i + 1, 2) AS BIGINT)) WHERE 2 * r.i < length(r.h)
), crcs AS (
  SELECT key, xor(c, 4294967295) AS h FROM crc_run WHERE 2 * i = length(h)
)"""


_SQL_LEAF = lambda text: "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*manifest.COLUMNS[:-1], text]
) + ")"

SQL_MANIFEST = f"""
WITH RECURSIVE keys AS (
  SELECT CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id IS NOT NULL
), {_sql_crc("keys", "k")}, leaves AS (
  SELECT doc_id, lang, {_SQL_LEAF("text")} AS leaf, h % 3 = 0 AS touched,
         {_SQL_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered
  FROM documents LEFT JOIN crcs ON CAST(doc_id AS VARCHAR) = key
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM leaves
), nodes AS (
  SELECT 0 AS level, tree, pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM numbered
  UNION ALL
  SELECT level + 1, tree, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 8
), subroots AS (
  SELECT tree, level AS height, d FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree - 1 AS pos, d, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8
), ladder AS (
  SELECT n.tree, n.level, n.pos, n.d, s.height FROM nodes n JOIN subroots s ON n.tree = s.tree WHERE n.n > 1
  UNION ALL SELECT s.tree, s.height + t.level, t.pos, t.d, s.height FROM subroots s, tops t WHERE t.n > 1
), proofs AS (
  SELECT b.tree, b.pos, string_agg(l.d, '' ORDER BY l.level, l.pos) AS siblings
  FROM numbered b JOIN subroots s ON b.tree = s.tree JOIN ladder l ON l.tree = b.tree
   AND l.pos // 8 = CASE WHEN l.level < l.height THEN b.pos // CAST(8 ** l.level AS BIGINT) ELSE (b.tree - 1) // CAST(8 ** (l.level - l.height) AS BIGINT) END // 8
   AND l.pos <> CASE WHEN l.level < l.height THEN b.pos // CAST(8 ** l.level AS BIGINT) ELSE (b.tree - 1) // CAST(8 ** (l.level - l.height) AS BIGINT) END
  GROUP BY b.tree, b.pos
), climb AS (
  SELECT b.tree, b.pos, 0 AS level, s.height, CASE WHEN s.height = 0 THEN b.tree - 1 ELSE b.pos END AS own, CASE WHEN b.touched THEN b.lowered ELSE b.leaf END AS f
  FROM numbered b JOIN subroots s ON b.tree = s.tree
  UNION ALL
  SELECT c.tree, c.pos, c.level + 1, c.height, CASE WHEN c.level + 1 = c.height THEN c.tree - 1 ELSE c.own // 8 END,
         sha256(string_agg(CASE WHEN l.pos = c.own THEN c.f ELSE l.d END, '' ORDER BY l.pos))
  FROM climb c JOIN ladder l ON l.tree = c.tree AND l.level = c.level AND l.pos // 8 = c.own // 8 GROUP BY c.tree, c.pos, c.level, c.height, c.own
), folded AS (
  SELECT tree, pos, arg_max(f, level) AS f FROM climb GROUP BY tree, pos
), whole AS (
  SELECT d FROM tops WHERE n = 1
)
SELECT b.doc_id, b.leaf, s.d AS subroot, w.d AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.f AS folded_root, f.f = w.d AS verified
FROM numbered b JOIN subroots s ON b.tree = s.tree JOIN folded f ON f.tree = b.tree AND f.pos = b.pos CROSS JOIN whole w
LEFT JOIN proofs p ON p.tree = b.tree AND p.pos = b.pos
"""


@query("op11_merkle_manifest", SQL_MANIFEST)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*manifest.COLUMNS)
    return manifest.verify(docs, manifest.lower_cased_third())


SQL_SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS run FROM documents
), hashed AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs
), {_sql_crc("hashed", "k")}, words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
  FROM hashed JOIN crcs ON k = key
), vocab AS (
  SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
), pairs AS (
  SELECT a.word AS u, b.word AS v, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.rest = b.word
), best AS (
  SELECT u, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY u
), chosen AS (
  SELECT p.u, min(p.v COLLATE "C") AS form, any_value(b.most) AS form_n FROM pairs p JOIN best b ON p.u = b.u AND p.n = b.most JOIN vocab w ON w.word = p.u
  WHERE b.most >= 10 * w.n GROUP BY p.u
), walk AS (
  SELECT word, word AS root, 0 AS steps FROM vocab
  UNION ALL SELECT w.word, c.form, w.steps + 1 FROM walk w JOIN chosen c ON w.root = c.u
)
SELECT w.word, c.form, (SELECT arg_max(root, steps) FROM walk x WHERE x.word = w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, c.form_n
FROM vocab w LEFT JOIN best b ON w.word = b.u LEFT JOIN chosen c ON w.word = c.u
"""


@query("op12_spelling_variants", SQL_SPELLING)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.slipped(table(spark, folder, "documents").select("doc_id", "text"))))
