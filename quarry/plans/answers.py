"""Queries around generated answers, judges and runs. Outputs of models are written into the queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as V
from ..operators import generation as G
from ..operators import measures as M
from ..sources import stores
from .registry import query
from .search import MODALITY, RERANKED, modality, reranked

# ---------------------------------------------------------------- context

#: Chunks of a source: its first five documents.
CHUNKS = f"""
ch AS (
  SELECT *, CASE WHEN modality = 'image_global' THEN '[' || pos || '] Source: ' || source || ' (image)' || chr(10) || 'Caption: ' || text
      WHEN modality = 'video_clip' AND uri <> '' THEN '[' || pos || '] Source: ' || source || ' (video clip)' || chr(10) || text
      ELSE '[' || pos || '] Source: ' || source || ', Page: ' || page || chr(10) || text END AS line
  FROM (SELECT source AS qid, text, source, doc_id, doc_id % 10 AS page, {MODALITY} AS modality, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'gs://m/' || doc_id END AS uri,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) WHERE pos <= 5)
"""


def _chunks(t):
    pos = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    uri = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("gs://m/"), F.col("doc_id").cast("string")))
    d = t("documents").select("doc_id", F.col("source").alias("qid"), "text", "source", (F.col("doc_id") % 10).cast("int").alias("page"), modality().alias("modality"), uri.alias("gcs_uri"), pos.alias("pos"))
    return d.where("pos <= 5").withColumns({"fetched": F.col("doc_id") % 3 != 0, "score": F.lit(1.0)})


@query(f"WITH {CHUNKS} SELECT qid AS source, 'Context:' || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY pos) AS context FROM ch GROUP BY qid")
def context_assembly(t):
    return G.contexts(_chunks(t)).select(F.col("qid").alias("source"), "context")


@query(f"""
WITH {CHUNKS}
SELECT qid AS source, 'Context:' || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || 'Question: what of ' || qid || '?' || chr(10) || chr(10) || 'Answer:' AS prompt
FROM ch GROUP BY qid
""")
def answer_prompts(t):
    asked = t("documents").select(F.col("source").alias("qid")).distinct().withColumn("question", F.concat(F.lit("what of "), "qid", F.lit("?")))
    return G.prompts(asked, _chunks(t)).select(F.col("qid").alias("source"), "prompt")


@query("SELECT doc_id, substr(text, 1, 100) AS snippet FROM documents")
def snippets(t):
    return t("documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query(f"""
WITH {CHUNKS}
SELECT qid AS source, string_agg('[' || pos || '] ' || source || ' p' || page || ': ' || trim(text, ' ' || chr(9) || chr(10)), chr(10) || chr(10) ORDER BY pos) AS context FROM ch GROUP BY qid
UNION ALL SELECT 'none', '(no chunks retrieved)'
""")
def judge_contexts(t):
    asked = t("documents").select(F.col("source").alias("qid")).distinct()
    none = t("documents").agg(F.lit("none").alias("qid"))
    return V.judge_contexts(_chunks(t), asked.unionByName(none)).select(F.col("qid").alias("source"), "context")


# ---------------------------------------------------------------- answers

QUOTE = "'As [1] and [2, 3] say, [' || qid % 9 || ']. '"
#: Every benchmark question with its reranked documents, and one question for which nothing was found.
ANSWERED = f"""{RERANKED},
used AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS n, modality IN ('image_global', 'video_clip') AND doc_id % 3 = 0 AS lost FROM best),
per AS (SELECT qid, count(*) AS chunks_used, count(*) FILTER (lost) AS degraded, arg_min(text, n) AS first_text FROM used GROUP BY qid),
ans AS (
  SELECT coalesce(b.item_id, 0) AS qid, coalesce(chunks_used, 0) AS chunks_used, coalesce(degraded, 0) AS degraded, first_text,
    CASE WHEN chunks_used IS NULL THEN 'I don''t have enough information to answer this.' ELSE trim({QUOTE.replace('qid', 'b.item_id')}) END AS answer FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) b LEFT JOIN per ON per.qid = b.item_id)
"""


def _answered(t):
    best = reranked(t).withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("rank")))
    best = best.withColumns({"page": (F.col("doc_id") % 10).cast("int"), "gcs_uri": F.lit("gs://m/x.png"), "fetched": F.col("doc_id") % 3 != 0})
    asked = t("benchmark").select(F.col("item_id").alias("qid")).unionByName(t("benchmark").agg(F.lit(-1).cast("long").alias("qid")))
    text = F.concat(F.lit("As [1] and [2, 3] say, ["), (F.col("qid") % 9).cast("string"), F.lit("]. "))
    made = asked.select("qid", text.alias("answer"), F.lit(7).alias("input_tokens"), F.lit(3).alias("output_tokens"))
    return G.answers(asked, best, made, "offline")


def _joined(c):
    return F.concat_ws(",", c.cast("array<string>"))


@query(f"""
WITH {ANSWERED}
SELECT qid, answer, CAST(chunks_used AS INTEGER) AS chunks_used, CAST(degraded AS INTEGER) AS media_chunks_degraded, coalesce(substr(first_text, 1, 100), '') AS first_snippet,
  CASE WHEN chunks_used = 0 THEN '' WHEN qid % 9 < 1 THEN '0,1' WHEN qid % 9 = 1 THEN '1' ELSE '1,' || qid % 9 END AS cited,
  CASE WHEN chunks_used = 0 THEN '' WHEN qid % 9 < 1 THEN '0' WHEN qid % 9 > chunks_used THEN '' || qid % 9 ELSE '' END AS invented, chunks_used > 0 AS logged, CASE WHEN chunks_used > 0 THEN 7 ELSE 0 END AS input_tokens FROM ans
""")
def answer_envelope(t):
    a = _answered(t)
    return a.select("qid", "answer", "chunks_used", "media_chunks_degraded", F.coalesce(F.get("sources.snippet", F.lit(0)), F.lit("")).alias("first_snippet"), _joined(F.col("cited")).alias("cited"), _joined(F.col("invented")).alias("invented"), "logged", "input_tokens")


@query(f"""
WITH {ANSWERED}
SELECT u.qid, u.n AS n, u.source AS filename, CAST(u.doc_id % 10 AS INTEGER) AS page, round(u.score, 9) AS score FROM used u WHERE u.n = 1 OR u.n = u.qid % 9
""")
def citations(t):
    """The sources that each answer cites."""
    return G.cited_sources(_answered(t)).select("qid", "n", "filename", "page", F.round("score", 9).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '1,2' ELSE '1,2,' || (turn + 3) END AS cited FROM conversations")
def grouped_citations(t):
    marks = F.concat("text", F.lit(" [1,2] [2, "), F.when(F.col("turn") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("turn") + 3).cast("string"), F.lit("]"))
    return t("conversations").select("conv_id", "turn", _joined(X.grouped_citations(marks)).alias("cited"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 400 WHEN 1 THEN 503 WHEN 2 THEN 502 WHEN 3 THEN CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 503 ELSE 502 END
  WHEN 4 THEN CASE event_type WHEN 'click' THEN 413 ELSE 503 END ELSE 200 END AS status FROM events
""")
def http_statuses(t):
    stage = F.element_at(F.array(*map(F.lit, ("empty", "embedding", "retrieval", "generation", "upload", "generation"))), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "config").when(F.col("event_type") == "view", "retryable").otherwise("other")
    upload = F.when(F.col("event_type") == "click", "size").otherwise("store")
    error = F.when(F.col("event_id") % 6 == 5, None).when(F.col("event_id") % 6 == 4, upload).otherwise(kind)
    return t("events").select("event_id", X.http_status(stage, error).alias("status"))


# ---------------------------------------------------------------- judges and runs

JUDGED = """
j AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE least(5.0, (doc_id % 12) / 2.0) END AS correctness, CASE WHEN doc_id % 5 = 1 THEN 0.0 ELSE least(1.0, (doc_id % 4) / 2.0) END AS hallucination,
    CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE 4.0 END AS faithfulness, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE (doc_id % 3) / 2.0 END AS "precision", doc_id % 13 = 0 AS unjudged FROM documents)
"""


def _judge_outputs(t):
    """Four judges' outputs for each document: fenced JSON, plain JSON, text that isn't, an incomplete object, a number as text."""
    k = F.col("doc_id")
    obj = lambda field, v: F.concat(F.lit(f'{{"{field}": '), v.cast("string"), F.lit(', "reasoning": "because"}'))
    out = t("documents").select(
        k.alias("qid"), (k % 3).alias("n_chunks"), F.when(k % 5 == 0, "not json").otherwise(F.concat(F.lit("```json\n"), obj("score", (k % 12) / 2), F.lit("\n```"))).alias("correctness"),
        F.when(k % 5 == 1, '{"hallucination_rate": 1}').otherwise(obj("hallucination_rate", (k % 4) / 2)).alias("hallucination"),
        F.when(k % 2 == 0, '{"score": "x", "reasoning": ""}').otherwise('{"score": "4", "reasoning": ""}').alias("faithfulness"), obj("precision", (k % 3) / 2).alias("precision"))
    return out.withColumn("faithfulness", F.when(F.col("qid") % 13 != 0, F.col("faithfulness")))


@query(f"""
WITH {JUDGED}
SELECT doc_id AS qid, CASE WHEN NOT unjudged THEN correctness END AS correctness, CASE WHEN NOT unjudged THEN hallucination END AS hallucination, CASE WHEN NOT unjudged THEN faithfulness END AS faithfulness,
  CASE WHEN NOT unjudged THEN "precision" END AS "precision", CASE WHEN NOT unjudged THEN CASE WHEN doc_id % 5 = 0 THEN 'parse_error: not json' ELSE 'because' END END AS reasoning FROM j
""")
def judge_scores(t):
    s = V.judge_scores(_judge_outputs(t))
    return s.select("qid", *[F.col(f"scores.{m}").alias(m) for m in V.JUDGES], F.col("reasoning.correctness").alias("reasoning"))


RUN = f"""{JUDGED},
run AS (
  SELECT CAST(d.doc_id AS BIGINT) AS query_id, lang AS category, CASE WHEN d.doc_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN d.doc_id % 9 = 0 THEN 'ERROR: timeout' ELSE 'the answer' END AS generated_answer,
    CAST(CASE WHEN d.doc_id % 9 = 0 THEN 0 ELSE d.doc_id % 3 END AS INTEGER) AS n_retrieved, round(d.n_chars / 8.0::DOUBLE, 1) AS latency_ms, CASE WHEN d.doc_id % 9 = 0 THEN 0 ELSE d.doc_id % 1000 END AS input_tokens,
    CASE WHEN d.doc_id % 9 <> 0 AND NOT unjudged THEN correctness END AS correctness, CASE WHEN d.doc_id % 9 <> 0 AND NOT unjudged THEN hallucination END AS hallucination,
    CASE WHEN d.doc_id % 9 <> 0 AND NOT unjudged THEN faithfulness END AS faithfulness, CASE WHEN d.doc_id % 9 <> 0 AND NOT unjudged THEN "precision" END AS "precision"
  FROM documents d JOIN j ON j.doc_id = d.doc_id)
"""


def _run(t):
    d, k = t("documents"), F.col("doc_id")
    golden = d.select(k.alias("id"), F.col("source").alias("query"), F.col("lang").alias("category"), F.lit("text").alias("source_modality"), F.lit("truth").alias("ground_truth"))
    failed = k % 9 == 0
    made = d.select(k.alias("qid"), F.when(~failed, "the answer").alias("answer"), F.when(failed, "timeout").alias("error"), (F.col("n_chars") / 8).alias("latency_ms"), (k % 1000).alias("input_tokens"), (k % 300).alias("output_tokens"))
    pos = F.explode(F.sequence(F.lit(1), F.when(k % 3 > 0, k % 3).cast("int")))
    chunks = d.where("doc_id % 3 > 0").select(k.alias("qid"), pos.alias("pos"), "text", "source", F.lit(1).alias("page"), F.lit("pdf").alias("modality"), F.lit(0.5).alias("score"), F.lit(None).cast("double").alias("rerank_score"))
    return V.run(golden, made, chunks, _judge_outputs(t))


@query(f"""WITH {RUN} SELECT query_id, category, status, generated_answer, n_retrieved, latency_ms, input_tokens, correctness, hallucination, faithfulness, "precision" FROM run""")
def eval_run(t):
    """Results of a run over every document as a question."""
    r = V.flat(_run(t))
    return r.select("query_id", "category", "status", "generated_answer", F.size("retrieved_chunks").alias("n_retrieved"), "latency_ms", "input_tokens", *V.JUDGES)


@query(f"""
WITH {RUN}
SELECT 'r1' AS run_id, count(*) AS num_queries, count(*) FILTER (status <> 'ok') AS failed_queries, round(quantile_cont(latency_ms, 0.95) FILTER (status = 'ok'), 1) AS p95_latency_ms, round(avg(correctness), 4) AS avg_correctness FROM run
""")
def eval_run_row(t):
    row = V.run_row(_run(t), "r1", "2025-01-01T00:00:00")
    return row.select("run_id", "num_queries", "failed_queries", "p95_latency_ms", "avg_correctness")


@query(f"WITH {RUN} SELECT count(*) AS total_queries, round(avg(latency_ms), 6) AS avg_latency_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM run WHERE status = 'ok'")
def eval_traffic(t):
    """Successful questions of a run are logged as queries."""
    logs = V.query_logs(_run(t), "2025-01-01T00:00:00")
    return logs.agg(F.count("*").alias("total_queries"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.sum("input_tokens").alias("input_tokens"))


@query("""
SELECT doc_id AS qid, round_even(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 1000) / 32768.0::DOUBLE ELSE (doc_id % 77) / 64.0::DOUBLE END, 4) AS score FROM documents
""")
def chunk_scores(t):
    """A retrieved chunk's score: the reranked one if there is one, rounded half to even."""
    k = F.col("doc_id")
    c = t("documents").select(k.alias("qid"), F.lit(1).alias("pos"), "text", "source", F.lit(1).alias("page"), F.lit("pdf").alias("modality"), ((k % 77) / 64.0).alias("score"), F.when(k % 2 == 0, (k % 1000) / 32768.0).alias("rerank_score"))
    return V.retrieved(c).select("qid", F.get("retrieved_chunks.score", F.lit(0)).alias("score"))


#: Runs: one a day of the events.
RUNS = "SELECT strftime(ts, '%Y-%m-%d') AS timestamp, 'run-' || strftime(ts, '%d') AS run_id, count(*) AS num_queries FROM events GROUP BY ALL"


def _runs(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.concat(F.lit("run-"), F.date_format("ts", "dd")).alias("run_id")).agg(F.count("*").alias("num_queries"))


@query(f"SELECT run_id, timestamp, num_queries FROM ({RUNS}) ORDER BY timestamp DESC LIMIT 1")
def latest_run(t):
    return V.chosen_run(_runs(t)).select("run_id", "timestamp", "num_queries")


@query(f"SELECT run_id, timestamp, num_queries FROM ({RUNS}) WHERE run_id = 'run-07'")
def run_by_id(t):
    return V.chosen_run(_runs(t), "run-07").select("run_id", "timestamp", "num_queries")


@query(f"SELECT run_id, CASE n WHEN 1 THEN 'B' ELSE 'A' END AS role FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC) AS n FROM ({RUNS})) WHERE n <= 2")
def default_comparison(t):
    return V.default_comparison(_runs(t))


@query(f"WITH {RUN} SELECT round(avg(correctness), 6) AS avg_correctness, round(avg(\"precision\") FILTER (category <> 'es'), 6) AS avg_precision FROM run WHERE status = 'ok'")
def eval_footer(t):
    f = M.footer(V.flat(_run(t)), ("correctness", "precision"), leave_out={"precision": "es"})
    return f.select(*[F.round(c, 6).alias(c) for c in f.columns])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE (doc_id % 7) / CAST(doc_id % 3 AS DOUBLE) END AS ratio FROM documents""")
def claim_ratios(t):
    return t("documents").select("doc_id", M.ratio(F.col("doc_id") % 7, F.col("doc_id") % 3).alias("ratio"))


# ---------------------------------------------------------------- logs and health

ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


def _iso(t):
    return t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("value").alias("latency_ms"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"))


@query(f"SELECT event_id, {ISO} AS timestamp FROM events WHERE {ISO} >= (SELECT strftime(max(ts) - INTERVAL 10 DAYS, '%Y-%m-%dT%H:%M:%S') FROM events)")
def recent_logs(t):
    """Log rows of the ten days before the last."""
    logs = _iso(t)
    last = logs.agg(F.max("timestamp").alias("_end"))
    return stores.recent_logs(logs.join(F.broadcast(last)), F.col("_end"), 10).select("event_id", "timestamp")


@query(f"SELECT {ISO} AS timestamp, value AS latency_ms, event_id % 1000 AS input_tokens, event_id % 300 AS output_tokens FROM events")
def all_logs(t):
    return stores.all_logs(_iso(t))


@query("SELECT (SELECT count(*) FROM embeddings) AS chunk_count, (SELECT count(*) FROM documents) AS index_size, (SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) FROM events) AS run_count, (SELECT count(*) = 0 FROM embeddings) AS is_empty")
def store_health(t):
    return stores.health(t("embeddings"), t("documents"), _runs(t))
