"""Each operator bound to its given table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import (
    coordinate_join, decontaminate, hash_forest, line_runs, pair_search, pieces, quality, repeats, simhash_bytes, surrogates,
    toxicity, turn_grammar, url_rules,
)
from obsframe.llm.registry import query, table


@query("op1_quality")
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality.classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


LINES_SQL = r"""
WITH lines AS (
 SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
 FROM documents),
keyed AS (
 SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_runs.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

URLS_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
 ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (
 SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
 SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (
 SELECT page_id, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(verdict, length(rhost) + length(rpath)) AS verdict
 FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id"""


@query("op7_url_rules", URLS_SQL)
def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.filter_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_simhash_bytes")
def op9_simhash_bytes(spark: SparkSession, sf: str) -> DataFrame:
    linked = simhash_bytes.link_near_duplicates(table(spark, sf, "documents"))
    return linked.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op10_hash_forest")
def op10_hash_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    found = hash_forest.nearest(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


REPEATS_SQL = r"""
WITH split AS (
 SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start FROM split),
windows AS (SELECT t.doc_id, start, array_to_string(list_slice(words, start, start + 19), ' ') AS stretch FROM starts t JOIN split s ON t.doc_id = s.doc_id),
again AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY stretch ORDER BY doc_id, start) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM again),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
kept AS (
 SELECT p.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
 FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT s.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id"""


@query("op8_repeats", REPEATS_SQL)
def op8_repeats(spark: SparkSession, sf: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query("op2_pieces")
def op2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), drop=["text"])
    return encoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "parity", "round_trip")


@query("op5_toxicity_chain")
def op5_toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic text, then toxic text that is of low quality as well."""
    labels = table(spark, sf, "labels").withColumn("toxic_junk", F.col("toxic") * (1 - F.col("quality")))
    scored = toxicity.score_toxicity(table(spark, sf, "documents").select("doc_id", "text"), labels, ["toxic", "toxic_junk"])
    toxic = F.when(F.col("p_toxic") >= toxicity.Settings.threshold, 1).otherwise(0)
    return scored.select("doc_id", "p_toxic", "p_toxic_junk", toxic.alias("toxic"))


@query("op3_surrogates")
def op3_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf, "documents").select("doc_id", "text"), "corpus key")


SEARCH_SQL = r"""
WITH found AS (
 SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
measured AS (SELECT doc_id, terms, 75 + (25 * n * docs) // total AS m FROM docs, corpus),
tfs AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM measured) GROUP BY doc_id, m, term),
weights AS (
 SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
 FROM tfs, corpus GROUP BY term),
asked AS (
 SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark) GROUP BY item_id, term),
scores AS (
 SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
 FROM asked JOIN weights USING (term) JOIN tfs USING (term) GROUP BY item_id, doc_id)
SELECT * FROM (
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
 FROM scores WHERE score > 0) WHERE rank <= 20"""


@query("op11_pair_search", SEARCH_SQL)
def op11_pair_search(spark: SparkSession, sf: str) -> DataFrame:
    found = pair_search.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


NEAR_SQL = r"""
WITH RECURSIVE split AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
 SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingle FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (
 SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id),
links AS (
 SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
reach(doc_id, other) AS (
 SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
firsts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT f.doc_id, coalesce(n, 0) AS n_shingles, component_id, f.doc_id = component_id AS kept
FROM firsts f LEFT JOIN sizes s ON f.doc_id = s.doc_id"""


@query("op12_coordinate_join", NEAR_SQL)
def op12_coordinate_join(spark: SparkSession, sf: str) -> DataFrame:
    linked = coordinate_join.link_similar(table(spark, sf, "documents"))
    kept = F.col("id").eqNullSafe(F.col("component"))
    return linked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given the wrong role by a checksum of their key; nulls are one space there and in the texts."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _plus(way: str, cost: str, edit: str) -> str:
    """A way, nine digits of cost and then the audit, with one more edit."""
    return f"(lpad(CAST(CAST(substr({way}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{edit}')"


REPAIR_SQL = rf"""
WITH RECURSIVE bytes AS (SELECT unnest(range(256)) AS b),
shifted AS (
 SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM bytes),
crc AS (SELECT list(v ORDER BY b) AS t FROM shifted),
keyed AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
marked AS (
 SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS damage FROM keyed, crc),
damaged AS (
 SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
  CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked WHERE damage <> 0),
numbered AS (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
  regexp_replace(text, '[ 	-]+$', '') AS core FROM damaged),
judged AS (
 SELECT conv_id, turn, role, text, n, role[1] AS initial,
  CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
   WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM numbered),
ways AS (
 SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM judged
 UNION ALL
 SELECT w.conv_id, r.n, {_plus('c0', '4', 'D')},
  CASE WHEN stays AND initial = 's' THEN least({_plus('c1', '4', 'D')}, {_plus('c0', 'more', 'K')}) ELSE {_plus('c1', '4', 'D')} END,
  CASE WHEN NOT stays THEN {_plus('c2', '4', 'D')} WHEN initial = 'u' THEN least({_plus('c2', '4', 'D')}, {_plus('before', 'more', 'K')})
   ELSE least({_plus('c2', '4', 'D')}, {_plus('before', '(3 + more)', 'R')}) END,
  CASE WHEN NOT stays THEN {_plus('c3', '4', 'D')} WHEN initial = 'a' THEN least({_plus('c3', '4', 'D')}, {_plus('c2', 'more', 'K')})
   ELSE least({_plus('c3', '4', 'D')}, {_plus('c2', '(3 + more)', 'R')}) END
 FROM (
  SELECT conv_id, n, v0 AS c0, v1 AS c1, c2, least(v3, {_plus('c2', '3', 'I')}) AS c3, least(v0, v1, least(v3, {_plus('c2', '3', 'I')})) AS before FROM (
   SELECT *, least(v2, {_plus('v0', '3', 'I')}, {_plus('v1', '3', 'I')}, {_plus('v3', '3', 'I')}) AS c2 FROM ways)) w
 JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM judged) r
  ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1),
counts AS (
 SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM judged GROUP BY conv_id),
ends AS (
 SELECT c.*, least(v0, v3, {_plus('least(v2, ' + _plus('v1', '3', 'I') + ')', '3', 'I')}) AS best
 FROM counts c JOIN ways w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n),
edits AS (
 SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS p FROM ends WHERE length(best) > 9),
placed AS (
 SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS n,
  count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS place FROM edits),
left_over AS (
 SELECT p.conv_id, p.p, p.place, edit, CASE WHEN edit = 'K' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
  bool_or(place = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY p.conv_id) AS system
 FROM placed p LEFT JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND p.n = j.n WHERE edit <> 'D'),
texts AS (
 SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END)
  || ':' || text, chr(10) ORDER BY p)) AS digest FROM left_over GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, CAST(coalesce(substr(best, 1, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit,
 coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id"""


@query("op13_turn_grammar", REPAIR_SQL)
def op13_turn_grammar(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return repaired_conversations(rows.select("conv_id").distinct(), damaged_conversations(rows))


def repaired_conversations(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The report on every original conversation and the digest of its repaired turns."""
    report, turns = turn_grammar.repair_conversations(rows)
    digests = turn_grammar.digests(turns).select(F.col("conv").alias("conv_"), "sha256")
    found = original.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("conv_")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)
