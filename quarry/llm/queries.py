"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, lm, mixing, negatives, paragraphs, quality, sharding, simhash, suffixes, tokens, urls

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_row")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", sharding.size(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"))
    dealt = sharding.assign(narrow, text="text_crc32")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


URL_RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS r(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row is an anchor; the labels of every seventh are moved on by one first, so that some near rows are negatives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(negatives.eligible(rows), "id % 100 = 0")


SQL["op13_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own AND vec_id <> anchor_id) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

SQL["op12_divergence"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), l AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), t AS (
  SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source
), g AS (
  SELECT DISTINCT lang, source FROM d
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), s AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o
)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 200
"""

SQL["op5_url_filters"] = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM rest
), fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM parts p LEFT JOIN (VALUES {URL_RULES}) r(host, path, verdict)
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE n = 1
"""

SQL["op2_mixing"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1.0::DOUBLE AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER w, 0)::BIGINT) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS rate
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, total, CAST(ceil(total / {mixing.SLOTS}) AS BIGINT) AS block,
    least(CAST(3 * source_size AS DOUBLE), weight * (SELECT arg_min(rate, ratio) FROM r WHERE rate <= ratio)) AS target FROM r
), e AS (
  SELECT * EXCLUDE (high), coalesce(lag(high) OVER w, 0.0) AS low, CASE WHEN lead(total) OVER w IS NULL THEN 1.0 ELSE high END AS high FROM (
    SELECT *, sum(target) OVER (ORDER BY source ASC NULLS LAST) / total AS high FROM g WHERE target > 0)
  WINDOW w AS (ORDER BY source ASC NULLS LAST)
), n AS (
  SELECT coalesce(CAST(ceil(max(total) / max(block)) AS BIGINT), 0) AS n FROM e
), p AS (
  SELECT slot, (slot + 1) * {mixing.GOLDEN} - floor((slot + 1) * {mixing.GOLDEN}) AS u FROM range((SELECT n FROM n)) t(slot)
), hit AS MATERIALIZED (
  SELECT p.slot, e.source FROM p JOIN e ON e.low <= p.u AND p.u < e.high
), slots AS (
  SELECT * FROM hit UNION ALL
  SELECT n.n + row_number() OVER (ORDER BY source ASC NULLS LAST) - 1, source FROM e, n
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.source IS NOT DISTINCT FROM e.source)
), ranked AS MATERIALIZED (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots
), q AS (
  SELECT *, used // blocks AS q, used % blocks AS m FROM (
    SELECT g.source, g.source_size, g.target, least(CAST(round(g.target) AS BIGINT), 3 * g.source_size) AS used, coalesce(b.blocks, 1) AS blocks
    FROM g LEFT JOIN (SELECT source, count(*) AS blocks FROM ranked GROUP BY source) b ON b.source IS NOT DISTINCT FROM g.source)
), placed AS (
  SELECT d.*, q.* EXCLUDE (source),
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), lays AS (
  SELECT *, start + lay * source_size AS a, least(start + lay * source_size + size, used) AS z FROM placed, range(3) t(lay)
), blocks AS (
  SELECT *, CASE WHEN a < m * (q + 1) THEN a // (q + 1) ELSE m + (a - m * (q + 1)) // greatest(q, 1) END AS low,
    CASE WHEN z - 1 < m * (q + 1) THEN (z - 1) // (q + 1) ELSE m + (z - 1 - m * (q + 1)) // greatest(q, 1) END AS high
  FROM lays WHERE size > 0 AND a < used
), taken AS (
  SELECT b.row_id, sum(z - a) AS taken, min(k.slot) AS first_slot, sum(high - low + 1) AS n_blocks
  FROM blocks b JOIN ranked k ON k.source IS NOT DISTINCT FROM b.source AND k.rank = b.low GROUP BY b.row_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM placed LEFT JOIN taken USING (row_id)
"""
