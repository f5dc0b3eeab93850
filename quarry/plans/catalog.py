"""Every registered query of the engine with its SQL twin, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import measures as M
from ..sources import chunk_store
from ..sources import files as S
from ..sources.scratch import shared_dir
from . import answers, media, search  # noqa: F401  these register their queries
from .registry import QUERIES, SQL, query
from .search import TOKENS

__all__ = ["QUERIES", "SQL"]

# ---------------------------------------------------------------- text

@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize_counts(t):
    tokens = X.tokens(F.col("text"))
    return t("documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace('10II ' || text || chr(160) || 'x', '10II', '10^-9'), '10■■', '10^-9'), 'ε=', 'epsilon='), 'ɛ=', 'epsilon='), chr(0), ''), chr(160), ' ') AS cleaned FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", X.clean(F.concat(F.lit("10II "), "text", F.lit("\xa0x"))).alias("cleaned"))


@query("SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' <pad>' WHEN 1 THEN text || 'x<pad>' WHEN 2 THEN '<s>' || text ELSE text || ' <EOS>.' END AS x FROM documents) WHERE NOT regexp_matches(x, '(^|[^\\p{L}\\p{N}_])(<EOS>|<pad>|<unk>|<s>|</s>|<mask>)([^\\p{L}\\p{N}_]|$)')")
def junk_filter(t):
    x = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" <pad>"))).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("x<pad>"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<s>"), "text")).otherwise(F.concat("text", F.lit(" <EOS>.")))
    return t("documents").where(~X.has_marker(x)).select("doc_id")


@query("SELECT doc_id, CASE WHEN title <> '' OR heading <> '' THEN 'Doc: ' || title || ' | Section: ' || heading || chr(10) || chr(10) || text ELSE text END AS embed_text FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS heading FROM documents)")
def embed_input_text(t):
    title, heading = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return t("documents").select("doc_id", X.embed_input(title, heading, F.col("text")).alias("embed_text"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM pages")
def mime_sniff(t):
    content = F.concat(F.unhex(F.when(F.col("page_id") % 2 == 0, "89504E47").otherwise("FFD8FFE0")), F.encode("html", "UTF-8"))
    return t("pages").select("page_id", X.mime(content).alias("mime"))


@query("SELECT doc_id, para_no, n_tokens, CAST(tail AS BIGINT) AS tail_tokens FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY para_no DESC ROWS UNBOUNDED PRECEDING) AS tail FROM (SELECT doc_id, CAST(i AS INTEGER) AS para_no, CAST(len(regexp_extract_all(p, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS n_tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))) WHERE tail <= 100")
def overlap_tail(t):
    p = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_no", "text"))
    return C.overlap_tail(p.select("doc_id", "para_no", X.token_count(F.col("text")).alias("n_tokens")))


@query("SELECT conv_id, turn, cited, list_filter(cited, lambda x: x < 1 OR x > 3) AS invented FROM (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || turn || '] and [2][9]', '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)))) AS cited FROM conversations)".replace("cited, list_filter(cited, lambda x: x < 1 OR x > 3) AS invented", "array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda x: x < 1 OR x > 3), ',') AS invented"))
def hallucinated_citations(t):
    cited = X.citations(F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] and [2][9]")))
    joined = lambda c: F.concat_ws(",", c.cast("array<string>"))
    return t("conversations").select("conv_id", "turn", cited.alias("c")).select("conv_id", "turn", joined(F.col("c")).alias("cited"), joined(X.invented(F.col("c"), F.lit(3))).alias("invented"))


@query("SELECT event_id, CASE WHEN regexp_matches(lower(event_type || ' ' || event_id), '401|403|api key|permission denied|400|invalid argument|bad request') THEN 'config' ELSE 'retryable' END AS error_class FROM events")
def error_classes(t):
    return t("events").select("event_id", X.error_class(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("error_class"))


# ---------------------------------------------------------------- sources, ids, chunks

FILES = "SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' WHEN 3 THEN '.mov' ELSE '' END AS path, page_id * 10000000 AS length FROM pages"


@query(f"SELECT page_id, CASE s WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'image' WHEN 'mov' THEN 'video' END AS format FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS s FROM ({FILES})) WHERE s IN ('pdf', 'png', 'mov') AND length <= 524288000")
def file_dispatch(t):
    end = F.element_at(F.array(*map(F.lit, (".PDF", ".png", ".exe", ".mov", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return S.accepted(t("pages").select("page_id", F.concat("url", end).alias("path"), (F.col("page_id") * 10_000_000).alias("length"))).select("page_id", "format")


@query("SELECT doc_id, sha256(sha256(text) || ':' || (doc_id % 10)) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'gs://media/media/' || sha256(text) || '/img_' || (doc_id % 10) || '.png' ELSE '' END AS uri FROM documents")
def chunk_ids(t):
    h, k = F.sha2("text", 256), (F.col("doc_id") % 10).cast("string")
    return t("documents").select("doc_id", C.chunk_id(h, k).alias("chunk_id"), S.media_uri("media", h, F.when(F.col("doc_id") % 3 == 0, "image_local").otherwise("pdf"), k, F.lit("image/png")).alias("uri"))


@query("SELECT doc_id, sha256(text) AS chunk_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def insert_if_absent(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("chunk_id"))
    return C.insert_if_absent(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).select("doc_id", "chunk_id")


@query("SELECT DISTINCT sha256(text) AS chunk_id FROM documents WHERE text IS NOT NULL")
def chunk_store_inserts(t):
    """What a store holds after an upload of every second document and then of all: each chunk once."""
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("chunk_id"))
    spark, path = d.sparkSession, f"{shared_dir(d.sparkSession)}/{uuid.uuid4().hex}"
    for some in (d.where("doc_id % 2 = 0"), d):
        chunk_store.add_chunks(spark, path, some)
    stored = chunk_store.read_chunks(spark, path)
    return (d.limit(0) if stored is None else stored).select("chunk_id")


@query("SELECT file_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(text) AS file_hash FROM documents) GROUP BY file_hash")
def file_dedup(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, i * 700 AS start, least(i * 700 + 800, n) AS stop FROM (SELECT doc_id, n, unnest(range(0, 1 + CASE WHEN n <= 800 THEN 0 ELSE CAST(ceil((n - 800) / 700.0) AS BIGINT) END)) AS i FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS n FROM documents))")
def token_windows(t):
    d = t("documents").select("doc_id", X.token_count(F.col("text")).alias("n"))
    return d.select("doc_id", F.explode(C.token_windows(F.col("n"))).alias("w")).select("doc_id", "w.start", "w.stop")


@query("SELECT event_id, s + i * 115 AS start, least(s + i * 115 + 120, e) AS stop, e - s > 120 AS forced FROM (SELECT *, unnest(range(0, 1 + CASE WHEN e - s <= 120 THEN 0 ELSE CAST(ceil((e - s - 120) / 115) AS BIGINT) END)) AS i FROM (SELECT event_id, CAST(event_id % 50 AS DOUBLE) AS s, (event_id % 50) + 1 + CAST(event_id % 700 AS DOUBLE) AS e FROM events))")
def scene_split(t):
    s = (F.col("event_id") % 50).cast("double")
    d = t("events").select("event_id", s.alias("s"), (s + 1 + (F.col("event_id") % 700).cast("double")).alias("e"))
    return d.select("event_id", F.explode(C.scene_segments(F.col("s"), F.col("e"))).alias("x")).select("event_id", "x.start", "x.stop", "x.forced")


@query("""
WITH b AS (SELECT p_partkey, (p_partkey % 40)::INTEGER - 20 AS x1, (p_partkey % 130)::INTEGER AS y1, (p_partkey % 40)::INTEGER - 20 + (p_partkey % 260)::INTEGER AS x2, (p_partkey % 130)::INTEGER + (p_partkey % 37)::INTEGER AS y2 FROM part),
c AS (SELECT *, greatest(0, least(x1, 200)) a1, greatest(0, least(y1, 100)) b1, greatest(0, least(x2, 200)) a2, greatest(0, least(y2, 100)) b2, CASE WHEN x2 > 200 THEN 200.0::DOUBLE / x2 ELSE 1.0 END sx, CASE WHEN y2 > 100 THEN 100.0::DOUBLE / y2 ELSE 1.0 END sy FROM b),
r AS (SELECT *, greatest(0, least(round_even(x1 * sx, 0)::INTEGER, 200)) c1, greatest(0, least(round_even(y1 * sy, 0)::INTEGER, 100)) d1, greatest(0, least(round_even(x2 * sx, 0)::INTEGER, 200)) c2, greatest(0, least(round_even(y2 * sy, 0)::INTEGER, 100)) d2 FROM c)
SELECT p_partkey, CASE WHEN a2 - a1 >= 10 AND b2 - b1 >= 10 THEN concat_ws(',', a1, b1, a2, b2) WHEN sx >= 0.75 AND sy >= 0.75 AND c2 - c1 >= 10 AND d2 - d1 >= 10 THEN concat_ws(',', c1, d1, c2, d2) END AS box FROM r
""")
def bbox_clamp_rescue(t):
    k = F.col("p_partkey")
    x1, y1 = (k % 40 - 20).cast("int"), (k % 130).cast("int")
    box = [x1, y1, x1 + (k % 260).cast("int"), y1 + (k % 37).cast("int")]
    found = C.rescue_box(box, F.lit(200), F.lit(100))
    return t("part").select("p_partkey", F.when(found.isNotNull(), F.concat_ws(",", found.cast("array<string>"))).alias("box"))


@query("SELECT image_id, pos, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS chunk_index FROM (SELECT doc_id % 20 AS image_id, doc_id AS pos, row_number() OVER (PARTITION BY doc_id % 20, n_chars % 97 ORDER BY doc_id) AS n FROM documents) WHERE n = 1".replace("row_number() OVER (PARTITION BY image_id ORDER BY pos) AS", "CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos) AS INTEGER) AS"))
def region_dedup(t):
    d = t("documents").select((F.col("doc_id") % 20).alias("image_id"), F.col("doc_id").alias("pos"), F.array(F.col("n_chars") % 97).alias("bbox"))
    return C.first_regions(d).select("image_id", "pos", "chunk_index")


@query("SELECT doc_id, type, n // size AS batch, n % size AS place FROM (SELECT doc_id, type, CASE type WHEN 'image' THEN 6 WHEN 'document' THEN 20 ELSE 1 END AS size, row_number() OVER (PARTITION BY type ORDER BY doc_id) - 1 AS n FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'document' WHEN 2 THEN 'video' ELSE 'other' END AS type FROM documents)) WHERE type <> 'other'")
def embed_batches(t):
    kind = F.element_at(F.array(*map(F.lit, ("image", "document", "video", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return C.batches(t("documents").select("doc_id", kind.alias("type"))).select("doc_id", "type", F.col("batch").cast("long"), F.col("place").cast("long"))


# ---------------------------------------------------------------- telemetry and evaluation

LOGS = "SELECT event_id, ts, value AS latency_ms, event_id % 1000 AS input_tokens, event_id % 300 AS output_tokens FROM events"


def _logs(t):
    return t("events").select("event_id", "ts", F.col("value").alias("latency_ms"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"))


@query(f"""WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS date, * FROM ({LOGS})), o AS (SELECT date, latency_ms, row_number() OVER (PARTITION BY date ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY date) AS n FROM l WHERE latency_ms IS NOT NULL)
SELECT l.date, round(avg(latency_ms), 6) AS avg_latency_ms, count(*) AS query_count, round(avg(input_tokens), 6) AS avg_input_tokens, round(sum(input_tokens * 1.25e-6 + output_tokens * 5e-6), 9) AS cost_usd, any_value(p50) AS p50, any_value(p95) AS p95
FROM l LEFT JOIN (SELECT date, max(latency_ms) FILTER (r = greatest(1, n * 50 // 100)) AS p50, max(latency_ms) FILTER (r = greatest(1, n * 95 // 100)) AS p95 FROM o GROUP BY date) p ON p.date = l.date GROUP BY l.date""")
def daily_metrics(t):
    return M.daily(_logs(t))


@query(f"""WITH l AS ({LOGS}), o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM l WHERE latency_ms IS NOT NULL)
SELECT count(*) AS total_queries, coalesce(round(avg(latency_ms), 6), 0) AS avg_latency_ms, round(sum(input_tokens * 1.25e-6 + output_tokens * 5e-6), 9) AS total_cost_usd, round(sum(input_tokens * 1.25e-6 + output_tokens * 5e-6) / count(*), 12) AS cost_per_query_usd,
(SELECT latency_ms FROM o WHERE r = greatest(1, n * 50 // 100)) AS p50, (SELECT latency_ms FROM o WHERE r = greatest(1, n * 95 // 100)) AS p95 FROM l""")
def metrics_summary(t):
    return M.summary(_logs(t))


@query("SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS query_count FROM events GROUP BY 1) ORDER BY date DESC LIMIT 14")
def last_n_days(t):
    return M.last_days(t("events"), 14)


RESULTS = "SELECT d.doc_id AS query_id, CASE WHEN d.doc_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN d.lang = 'es' THEN 'out-of-scope' ELSE d.lang END AS category, CAST(d.n_chars AS DOUBLE) AS latency_ms, d.doc_id % 1000 AS input_tokens, d.doc_id % 300 AS output_tokens, CAST(l.quality * 5 - (d.doc_id % 3) * l.quality AS DOUBLE) AS correctness, CAST(l.toxic AS DOUBLE) AS hallucination, CAST(l.quality * 4 AS DOUBLE) AS faithfulness, CAST(l.quality AS DOUBLE) AS precision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _results(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    k = F.col("doc_id")
    return d.select(
        k.alias("query_id"), F.when(k % 9 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("lang") == "es", "out-of-scope").otherwise(F.col("lang")).alias("category"), F.col("n_chars").cast("double").alias("latency_ms"),
        (k % 1000).alias("input_tokens"), (k % 300).alias("output_tokens"), (F.col("quality") * 5 - (k % 3) * F.col("quality")).cast("double").alias("correctness"), F.col("toxic").cast("double").alias("hallucination"),
        (F.col("quality") * 4).cast("double").alias("faithfulness"), F.col("quality").cast("double").alias("precision"))


@query(f"""WITH r AS ({RESULTS}) SELECT count(*) AS num_queries, count(*) FILTER (status <> 'ok') AS failed_queries, round(avg(latency_ms) FILTER (status = 'ok'), 1) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.5) FILTER (status = 'ok'), 1) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95) FILTER (status = 'ok'), 1) AS p95_latency_ms,
CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(correctness) FILTER (status = 'ok'), 4) AS avg_correctness, round(avg(hallucination) FILTER (status = 'ok'), 4) AS avg_hallucination, round(avg(faithfulness) FILTER (status = 'ok'), 4) AS avg_faithfulness, round(avg(precision) FILTER (status = 'ok' AND category <> 'out-of-scope'), 4) AS avg_context_precision FROM r""")
def eval_summary(t):
    return M.eval_summary(_results(t))


@query(f"WITH r AS ({RESULTS}) SELECT category, round(avg(correctness), 1) AS correctness, round(avg(faithfulness), 1) AS faithfulness FROM r WHERE correctness IS NOT NULL GROUP BY category")
def category_scores(t):
    return M.category_scores(_results(t))


@query(f"WITH r AS ({RESULTS}) SELECT query_id, CASE WHEN correctness >= 4 THEN 'green' WHEN correctness >= 2 THEN 'amber' WHEN correctness IS NOT NULL THEN 'red' END AS correctness_band, CASE WHEN hallucination <= 0.1 THEN 'green' WHEN hallucination <= 0.3 THEN 'amber' WHEN hallucination IS NOT NULL THEN 'red' END AS hallucination_band FROM r")
def score_bands(t):
    return _results(t).select("query_id", M.band(F.col("correctness"), 4, 2).alias("correctness_band"), M.band(F.col("hallucination"), 0.1, 0.3, True).alias("hallucination_band"))


@query(f"WITH a AS ({RESULTS}), b AS (SELECT query_id, correctness * 0.9 AS correctness, faithfulness + query_id % 2 AS faithfulness FROM a WHERE query_id % 5 <> 0) SELECT a.query_id, round(b.correctness - a.correctness, 6) AS d_correctness, round(b.faithfulness - a.faithfulness, 6) AS d_faithfulness, coalesce(abs(b.correctness - a.correctness) > 0.5 OR abs(b.faithfulness - a.faithfulness) > 0.5, false) AS changed FROM a JOIN b USING (query_id)")
def run_comparison(t):
    a = _results(t).select("query_id", "correctness", "faithfulness")
    b = a.where("query_id % 5 <> 0").select("query_id", (F.col("correctness") * 0.9).alias("correctness"), (F.col("faithfulness") + F.col("query_id") % 2).alias("faithfulness"))
    return M.compare_runs(a, b).select("query_id", F.round("d_correctness", 6).alias("d_correctness"), F.round("d_faithfulness", 6).alias("d_faithfulness"), "changed")


@query("""
WITH s AS (
  SELECT count(*) AS n, avg(value) AS mean, list_sort(list(value) FILTER (value IS NOT NULL)) AS vs,
    CAST(sum(event_id % 1000) * 1.25 + sum(event_id % 300) * 5 AS DECIMAL(28, 2)) * CAST(0.000001 AS DECIMAL(8, 6)) AS total FROM events
)
SELECT format('{:,}', n) AS total_queries, format('{:,.0f}', round(mean)) || ' ms' AS avg_latency,
  format('{:,.0f}', round(vs[greatest(1, CAST(floor(len(vs) * 95 / 100) AS BIGINT))])) || ' ms' AS p95_latency,
  '$' || format('{:,.4f}', CAST(round(total, 4) AS DOUBLE)) AS total_cost, '$' || format('{:,.5f}', round(CAST(total AS DOUBLE) / n, 5)) AS cost_per_query FROM s
""")
def stat_cards(t):
    return M.stat_cards(M.summary(_logs(t)))


@query(f"""
WITH a AS ({RESULTS}), b AS (SELECT query_id, correctness * 0.9 AS correctness, faithfulness + query_id % 2 AS faithfulness FROM a WHERE query_id % 5 <> 0)
SELECT round(avg(b.correctness - a.correctness), 6) AS d_correctness, round(avg(b.faithfulness - a.faithfulness), 6) AS d_faithfulness, count(b.correctness - a.correctness) AS pairs FROM a JOIN b USING (query_id)
""")
def mean_deltas(t):
    a = _results(t).select("query_id", "correctness", "faithfulness")
    b = a.where("query_id % 5 <> 0").select("query_id", (F.col("correctness") * 0.9).alias("correctness"), (F.col("faithfulness") + F.col("query_id") % 2).alias("faithfulness"))
    d = M.mean_deltas(M.compare_runs(a, b))
    return d.select(F.round("d_correctness", 6).alias("d_correctness"), F.round("d_faithfulness", 6).alias("d_faithfulness"), "pairs")
