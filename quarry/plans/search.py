"""Queries of keyword and vector search, fusion, routing and reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import generation as G
from ..operators import retrieval as R
from ..operators import vectors as V
from ..sources import keyword_store
from ..sources.scratch import materialise, shared_dir
from .registry import query

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
MODALITY = "CASE lang WHEN 'de' THEN 'pdf' WHEN 'en' THEN 'image_global' WHEN 'es' THEN 'video_clip' ELSE 'video_summary' END"

TERMS = f"""
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
z AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM documents LEFT JOIN l USING (doc_id)),
w AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
i AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM (SELECT *, avg(raw) OVER () AS mean FROM w))
"""
BM25 = f"""{TERMS},
q AS (SELECT qid, term, count(*) AS qn FROM (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
h AS (
  SELECT qid, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN p USING (term) JOIN i USING (term) JOIN l USING (doc_id), z GROUP BY qid, doc_id),
a AS (
  SELECT b.item_id AS qid, d.doc_id, coalesce(score, 0.0) AS score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN h ON h.qid = b.item_id AND h.doc_id = d.doc_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 20)
"""


def questions(t):
    return t("benchmark").select(F.col("item_id").alias("qid"), "text")


def keyword(t, stems: bool = False):
    return R.bm25(R.index(t("documents").select("doc_id", "text"), stems), questions(t))


def modality():
    lang = F.col("lang")
    return F.when(lang == "de", "pdf").when(lang == "en", "image_global").when(lang == "es", "video_clip").otherwise("video_summary")


@query(f"WITH {TERMS} SELECT term, df, round(idf, 9) AS idf FROM i")
def bm25_terms(t):
    return R.index(t("documents").select("doc_id", "text")).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {BM25} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k")
def bm25_top20(t):
    return keyword(t).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k")
def keyword_store_top20(t):
    """The same lists from an index that grew by two uploads, of every third document and then of all."""
    d = t("documents").select("doc_id", "text")
    spark, path = d.sparkSession, f"{shared_dir(d.sparkSession)}/{uuid.uuid4().hex}"
    for some in (d.where("doc_id % 3 = 0"), d):
        keyword_store.add_documents(spark, path, some)
    return R.bm25(keyword_store.read_index(spark, path), questions(t)).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def bm25_stemmed(t):
    """With stems and without clips, as the index of chunks is built; SQL has no stems."""
    corpus = R.searchable(t("documents").withColumn("modality", modality())).select("doc_id", "text")
    found = R.bm25(R.index(corpus, True), questions(t))
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {BM25}
SELECT qid, doc_id, text, source, CAST(doc_id % 10 AS INTEGER) AS page, 0 AS chunk_index, coalesce(CASE WHEN lang <> 'fr' THEN {MODALITY} END, 'text') AS modality, round(score, 6) AS orig_score, '' AS gcs_uri
FROM k JOIN documents d USING (doc_id)
""")
def normalize_hits(t):
    chunks = t("documents").select("doc_id", "text", "source", F.lit(0).alias("chunk_index"), (F.col("doc_id") % 10).cast("int").alias("page"), F.when(F.col("lang") != "fr", modality()).alias("modality"), F.lit(None).cast("string").alias("gcs_uri"))
    flat = R.normalised_keyword(R.bm25_hits(keyword(t), chunks).drop("rank"))
    return flat.withColumn("orig_score", F.round("orig_score", 6))


# ---------------------------------------------------------------- vectors

COSINE = "round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6)"
VECTORS = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT q.vec_id AS qid, v.vec_id, {COSINE} AS score FROM v q, v WHERE q.vec_id % 50 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 20)
"""


def asked_vectors(t):
    return t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(f"WITH {VECTORS} SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM n")
def vector_top20_batch(t):
    return R.vector_search(t("embeddings"), asked_vectors(t))


@query(f"WITH {VECTORS} SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM n")
def vector_lists_top20(t):
    """The same through inverted lists, of which a question reads those that may hold its best."""
    own = V.build(t("embeddings"), n_lists=16, rows=64)
    return V.search(own, asked_vectors(t)).withColumnRenamed("id", "vec_id")


@query(f"WITH {VECTORS} SELECT vec_id, score, CAST(rank AS INTEGER) AS rank FROM n WHERE qid = (SELECT min(vec_id) FROM v)")
def vector_top20(t):
    """One question's vector: the first."""
    e = t("embeddings")
    first = e.join(F.broadcast(e.agg(F.min("vec_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("qid"), "embedding")
    return R.vector_search(e, first).drop("qid")


HYDE_LISTS = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT a.vec_id AS qid, a.e AS raw, coalesce(b.e, a.e) AS hyde FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 50 WHERE a.vec_id % 50 = 0),
s AS (
  SELECT 'raw' AS list, q.qid, v.vec_id, {COSINE} AS score FROM (SELECT qid, raw AS e FROM g) q, v
  UNION ALL SELECT 'hyde', q.qid, v.vec_id, {COSINE} FROM (SELECT qid, hyde AS e FROM g) q, v),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list, qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3),
a AS (SELECT * FROM n WHERE list = 'raw'), b AS (SELECT * FROM n WHERE list = 'hyde')
"""


def _hyde_lists(t):
    """Every asked vector's list, and that of its expansion, the vector 50 further on; the last have none and keep their own."""
    e, raw = t("embeddings"), asked_vectors(t)
    expansion = e.select((F.col("vec_id") - 50).alias("qid"), "embedding")
    return [hits.withColumnRenamed("id", "vec_id") for hits in V.nearest_each(e, [raw, R.with_expansion(raw, expansion)], 3)]


@query(f"""
WITH {HYDE_LISTS}
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.vec_id, b.vec_id) AS vec_id, CAST(coalesce(a.rank, 0) AS INTEGER) AS raw_rank, CAST(coalesce(b.rank, 0) AS INTEGER) AS hyde_rank,
  CASE WHEN a.rank IS NULL THEN 'new' WHEN b.rank IS NULL THEN 'dropped' WHEN b.rank < a.rank THEN 'up' WHEN b.rank > a.rank THEN 'down' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.qid = b.qid AND a.vec_id = b.vec_id
""")
def hyde_ab(t):
    changes = R.rank_changes(*_hyde_lists(t))
    return changes.select("qid", "vec_id", "change", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_rank", "hyde_rank")])


@query(f"""
WITH {HYDE_LISTS}
SELECT a.qid, a.vec_id % 10 = (a.qid // 50) % 10 AS raw_hit, b.vec_id % 10 = (a.qid // 50) % 10 AS hyde_hit FROM a JOIN b ON a.qid = b.qid AND a.rank = 1 AND b.rank = 1
""")
def hyde_page_hits(t):
    """Whether the best hit lies on the expected page, in both lists."""
    raw, expanded = (x.where("rank = 1").select("qid", (F.col("vec_id") % 10).alias(name)) for x, name in zip(_hyde_lists(t), ("raw", "hyde"), strict=True))
    page = F.floor(F.col("qid") / 50) % 10
    return raw.join(expanded, "qid").select("qid", (F.col("raw") == page).alias("raw_hit"), (F.col("hyde") == page).alias("hyde_hit"))


# ---------------------------------------------------------------- fusion

SHOWN = "SELECT k.qid, d.text, d.source, CAST(d.doc_id % 10 AS INTEGER) AS page, 'pdf' AS modality, k.rank FROM {} JOIN documents d ON d.doc_id = {}"
FUSED = """
g AS (
  SELECT qid, text, round(sum(1 / (60.0::DOUBLE + rank)), 12) AS score, min(list * 1000000 + rank) AS first,
    max(CASE WHEN list = 0 THEN rank END) AS bm25_rank, max(CASE WHEN list = 1 THEN rank END) AS vector_rank FROM f GROUP BY qid, text),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS pos FROM g)
SELECT o.qid, o.text, f.source, f.page, round(o.score, 9) AS score, CAST(coalesce(bm25_rank, 0) AS INTEGER) AS bm25_rank, CAST(coalesce(vector_rank, 0) AS INTEGER) AS vector_rank, CAST(pos AS INTEGER) AS pos
FROM o JOIN f ON f.qid = o.qid AND f.text = o.text AND f.list * 1000000 + f.rank = o.first WHERE pos <= 20
"""


def _ranked(fused):
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]  # 0: not in that list
    return fused.select("qid", "text", "source", "page", F.round("score", 9).alias("score"), *ranks, "pos")


def _fused(keyword_list, vector_list):
    return _ranked(R.fuse(keyword_list, vector_list))


#: Vector lists of the questions. The tables hold no vectors of questions: each takes that of a stored row.
ASKED_VECTORS = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT b.item_id AS qid, v.e FROM benchmark b JOIN v ON v.vec_id = (b.item_id * 50) % (SELECT count(*) FROM embeddings)),
c AS (SELECT q.qid, v.vec_id, {COSINE} AS score FROM u q, v),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 20)
"""


def _hybrid(t, own, **more):
    e, d = t("embeddings"), t("documents")
    n = e.agg(F.count("*").alias("n"))
    met = questions(t).join(F.broadcast(n)).withColumn("vec_id", F.col("qid") * 50 % F.col("n")).join(e, "vec_id")
    chunks = d.select("doc_id", "text", "source", (F.col("doc_id") % 10).cast("int").alias("page"), F.lit("pdf").alias("modality"))
    return _ranked(R.hybrid_search(met.select("qid", "text", "embedding"), own, e, chunks, **more))


@query(f"""
WITH {BM25}, {ASKED_VECTORS},
f AS (SELECT *, 0 AS list FROM ({SHOWN.format('k', 'k.doc_id')}) UNION ALL SELECT *, 1 FROM ({SHOWN.format('n k', 'k.vec_id')})),
{FUSED}""")
def hybrid_search(t):
    """Flagship: keyword and vector lists of every question, fused."""
    return _hybrid(t, R.index(t("documents").select("doc_id", "text")))


@query(f"WITH {ASKED_VECTORS}, f AS (SELECT *, 1 AS list FROM ({SHOWN.format('n k', 'k.vec_id')})), {FUSED}")
def hybrid_without_keywords(t):
    """Before anything was indexed the vectors alone answer; switched off, expansions change nothing."""
    e = t("embeddings")
    return _hybrid(t, None, expansions=e.select((F.col("vec_id") + 1).alias("qid"), "embedding"), use_hyde=False)


LISTED = "SELECT source AS qid, text, source, CAST(doc_id % 10 AS INTEGER) AS page, row_number() OVER (PARTITION BY source ORDER BY {}) AS rank FROM documents"


def _listed(t, *order):
    rank = F.row_number().over(W.partitionBy("source").orderBy(*order))
    return t("documents").select(F.col("source").alias("qid"), "text", "source", (F.col("doc_id") % 10).cast("int").alias("page"), F.lit("pdf").alias("modality"), rank.alias("rank"))


@query(f"WITH f AS (SELECT *, 0 AS list FROM ({LISTED.format('n_chars, doc_id')}) WHERE rank <= 20 UNION ALL SELECT *, 1 FROM ({LISTED.format('doc_id')}) WHERE rank <= 20), {FUSED}")
def rrf_fusion(t):
    """A source's twenty shortest documents and its twenty first, fused."""
    return _fused(_listed(t, "n_chars", "doc_id").where("rank <= 20"), _listed(t, "doc_id").where("rank <= 20"))


@query(f"WITH f AS (SELECT *, 0 AS list FROM ({LISTED.format('n_chars, doc_id')}) UNION ALL SELECT *, 1 FROM ({LISTED.format('doc_id')})), {FUSED}")
def rrf_in_list_duplicates(t):
    """Whole lists, in which texts repeat: each place adds its share, the last rank is shown."""
    return _fused(_listed(t, "n_chars", "doc_id"), _listed(t, "doc_id"))


# ---------------------------------------------------------------- routing and reranking

ASKED = """
SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'In the video ' WHEN 1 THEN 'The Diagram of ' WHEN 2 THEN 'compare the video to the paper ' ELSE '' END || text AS question FROM benchmark
"""
SCOPED = f"""
s AS (
  SELECT *, regexp_matches(question, '(?i)\\b(video|presenter)\\b') AS v, regexp_matches(question, '(?i)\\b(diagram|figure|image|what (does|is) (shown|labeled|depicted) in)\\b') AS im,
    regexp_matches(question, '(?i)\\b(paper|document|report)\\b') AS x FROM ({ASKED}))
"""


def asked(t):
    start = F.element_at(F.array(*map(F.lit, ("In the video ", "The Diagram of ", "compare the video to the paper ", ""))), (F.col("item_id") % 4 + 1).cast("int"))
    return t("benchmark").select(F.col("item_id").alias("qid"), F.concat(start, "text").alias("question"))


@query(f"WITH {SCOPED} SELECT qid, v AS has_video, im AS has_image, x AS has_text FROM s")
def scope_flags(t):
    return asked(t).select("qid", *[c.alias(name) for name, c in R.scopes(F.col("question")).items()])


#: Every question's keyword list with modalities, routed.
ROUTED = f"""{BM25}, {SCOPED},
cand AS (SELECT s.*, k.rank, d.doc_id, d.text, d.source, {MODALITY} AS modality FROM s JOIN k ON k.qid = s.qid JOIN documents d ON d.doc_id = k.doc_id),
kept AS (
  SELECT *, CASE WHEN v::INT + im::INT + x::INT >= 2 THEN true WHEN v THEN modality LIKE 'video%' WHEN im THEN modality LIKE 'image%' ELSE true END AS keep FROM cand),
routed AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (SELECT *, bool_or(keep) OVER (PARTITION BY qid) AS any_keep FROM kept) WHERE keep OR NOT any_keep)
"""


def routed(t):
    d = t("documents").select("doc_id", "text", "source", modality().alias("modality"))
    lists = R.route(keyword(t).drop("score").join(d, "doc_id").join(asked(t), "qid"))
    return materialise(lists.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).drop("rank"))  # read several times by reranking


@query(f"WITH {ROUTED} SELECT qid, doc_id, modality, CAST(pos AS INTEGER) AS pos FROM routed")
def modality_routing(t):
    return routed(t).select("qid", "doc_id", "modality", "pos")


@query(f"""
WITH {ROUTED}
SELECT qid, CAST(pos AS INTEGER) AS pos, '[' || pos || '] ' || CASE WHEN modality = 'image_global' AND doc_id % 3 <> 0 THEN '' WHEN modality = 'video_clip' AND doc_id % 3 <> 0
  THEN '[Video segment] Summary: ' || substr(text, 1, 300) || chr(10) || 'Frame: ' ELSE substr(text, 1, 400) END AS passage FROM routed
""")
def rerank_passages(t):
    """What the reranker reads of each candidate; pictures of every third document could not be fetched."""
    return G.passages(routed(t).withColumns({"gcs_uri": F.lit("gs://m/x.png"), "fetched": F.col("doc_id") % 3 != 0}))


#: A model's score of a candidate, which is missing for some, within 0 to 1 and low for every third question.
MODEL = "CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE (doc_id * 37 + qid * 11) % 100 / 100.0::DOUBLE * CASE WHEN qid % 3 = 0 THEN 0.2 ELSE 1 END END"
RERANKED = f"""{ROUTED},
m AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n_own, 1.0::DOUBLE / (60 + pos) AS score FROM routed),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, pos) AS place FROM (SELECT *, CASE WHEN n_own > 1 THEN {MODEL} ELSE score END AS rerank_score FROM m)),
best AS (
  SELECT * FROM (SELECT *, count(*) FILTER (rerank_score >= 0.25) OVER (PARTITION BY qid) AS good FROM r WHERE place <= 5)
  WHERE n_own = 1 OR rerank_score >= 0.25 OR (good = 0 AND place <= 3))
"""


def reranked(t):
    c = routed(t).withColumn("score", 1 / (F.lit(60.0) + F.col("pos")))
    model = (F.col("doc_id") * 37 + F.col("qid") * 11) % 100 / F.lit(100.0) * F.when(F.col("qid") % 3 == 0, 0.2).otherwise(1.0)
    given = c.where("doc_id % 7 <> 0").select("qid", "pos", F.lit(2).alias("given"), model.alias("model_score"))
    earlier = given.withColumn("given", F.lit(1)).withColumn("model_score", F.lit(0.99))
    return R.rerank(c, given.unionByName(earlier))


@query(f"WITH {ROUTED} SELECT qid, doc_id, round({MODEL}, 6) AS model_score FROM routed")
def rerank_join(t):
    """Every candidate with its model score: missing ones are 0, of repeated ones the last given counts, unknown ids are left out."""
    c = routed(t)
    model = (F.col("doc_id") * 37 + F.col("qid") * 11) % 100 / F.lit(100.0) * F.when(F.col("qid") % 3 == 0, 0.2).otherwise(1.0)
    given = c.where("doc_id % 7 <> 0").select("qid", "pos", F.lit(2).alias("given"), model.alias("model_score"))
    unknown = given.withColumn("pos", F.col("pos") + 1000)
    met = R.with_scores(c, given.unionByName(given.withColumns({"given": F.lit(1), "model_score": F.lit(0.99)})).unionByName(unknown))
    return met.select("qid", "doc_id", F.round("model_score", 6).alias("model_score"))


@query(f"WITH {RERANKED} SELECT qid, doc_id, round(rerank_score, 6) AS rerank_score, CAST(place AS INTEGER) AS rank FROM best")
def rerank_threshold(t):
    return reranked(t).select("qid", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")
