"""Keyword and vector search, rank fusion, modality routing and reranking, over many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SCOPES
from . import vectors
from .keywords import Index, bm25, index, searchable, term_counts  # noqa: F401

RRF_K = 60


# ---------------------------------------------------------------- keyword search


def bm25_hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked documents in the shape of a keyword hit: (qid, doc_id, rank, text, score, metadata)."""
    met = ranked.join(chunks, "doc_id")
    return met.select("qid", "doc_id", "rank", "text", "score", F.struct("source", "chunk_index", "page", "modality", "gcs_uri").alias("metadata"))


def normalised_keyword(hits: DataFrame) -> DataFrame:
    """Keyword hits (text, score, metadata, ...) flat, with defaults."""
    m = lambda c, default: F.coalesce(F.col(f"metadata.{c}"), F.lit(default)).alias(c)
    rest = [c for c in hits.columns if c not in ("text", "score", "metadata")]
    return hits.select(*rest, F.coalesce("text", F.lit("")).alias("text"), m("source", ""), m("page", 0), m("chunk_index", 0), m("modality", "text"), F.coalesce("score", F.lit(0.0)).alias("orig_score"), m("gcs_uri", ""))


def normalised_vector(hits: DataFrame) -> DataFrame:
    """Vector hits (text, source, page, chunk_index, type, modality, gcs_uri, score, ...) with defaults; an empty modality is the type."""
    d = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    rest = [c for c in hits.columns if c not in ("text", "source", "page", "chunk_index", "type", "modality", "gcs_uri", "score")]
    kind = F.coalesce(F.nullif(F.col("modality"), F.lit("")), F.col("type"), F.lit("")).alias("modality")
    return hits.select(*rest, d("text", ""), d("source", ""), d("page", 0), d("chunk_index", 0), kind, F.coalesce("score", F.lit(0.0)).alias("orig_score"), d("gcs_uri", ""))


# ---------------------------------------------------------------- vector search


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def vector_search(rows: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """(qid, vec_id, score, rank) of rows (vec_id, embedding) and queries (qid, embedding) by exact cosine; ties by id.

    ``vectors.build`` and ``vectors.search`` keep an index for many searches.
    """
    return vectors.nearest(rows, queries, top).withColumnRenamed("id", "vec_id")


def with_expansion(questions: DataFrame, expansions: DataFrame) -> DataFrame:
    """Questions (qid, embedding) with the expansion's (qid, embedding) where there is one: a failed expansion leaves the question itself."""
    e = expansions.select("qid", F.col("embedding").alias("_e"))
    return questions.join(e, "qid", "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_e")


def rank_changes(raw: DataFrame, expanded: DataFrame) -> DataFrame:
    """(qid, vec_id, change, raw_rank, hyde_rank) of two ranked lists (qid, vec_id, rank): new, dropped, up, down or same."""
    a, b = raw.select("qid", "vec_id", F.col("rank").alias("raw_rank")), expanded.select("qid", "vec_id", F.col("rank").alias("hyde_rank"))
    change = F.when(F.col("raw_rank").isNull(), "new").when(F.col("hyde_rank").isNull(), "dropped")
    change = change.when(F.col("hyde_rank") < F.col("raw_rank"), "up").when(F.col("hyde_rank") > F.col("raw_rank"), "down").otherwise("same")
    return a.join(b, ["qid", "vec_id"], "full_outer").withColumn("change", change)


# ---------------------------------------------------------------- fusion, routing, reranking


def fuse(keyword: DataFrame, vector: DataFrame, top: int = 20, k: int = RRF_K) -> DataFrame:
    """Rank fusion of (qid, text, source, page, modality, rank) lists by text.

    Repeats in one list add their shares and show the last rank; source, page and
    modality come from the first seen, keyword before vector; ties keep first-seen order.
    """
    both = keyword.withColumn("list", F.lit(0)).unionByName(vector.withColumn("list", F.lit(1)))
    g = both.groupBy("qid", "text").agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank", "source", "page", "modality")).alias("first"),
        F.max(F.when(F.col("list") == 0, F.col("rank"))).alias("bm25_rank"), F.max(F.when(F.col("list") == 1, F.col("rank"))).alias("vector_rank"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "first.list", "first.rank")
    g = g.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top)
    return g.select("qid", "text", "first.source", "first.page", "first.modality", "score", "bm25_rank", "vector_rank", "pos")


def hybrid_search(
    questions: DataFrame, own: Index | None, stored: vectors.Lists | DataFrame, chunks: DataFrame, expansions: DataFrame | None = None, use_hyde: bool = True, top: int = 20, each: int = 20
) -> DataFrame:
    """Keyword and vector lists of ``each`` chunks for every question (qid, text, embedding), fused to ``top``.

    stored: inverted lists, or the vectors (vec_id, embedding) themselves. chunks (doc_id, text, source, page, modality) are what ids of
    both lists stand for. With use_hyde, vector search takes the embedding of the hypothetical answer in expansions (qid, embedding)
    where there is one; keyword search always takes the question. Without a keyword index the vectors alone are used.
    """
    asked = questions.select("qid", "embedding")
    asked = with_expansion(asked, expansions) if use_hyde and expansions is not None else asked
    found = vectors.search(stored, asked, each) if isinstance(stored, vectors.Lists) else vectors.nearest(stored, asked, each)
    shown = lambda hits: hits.join(chunks, "doc_id").select("qid", "text", "source", "page", "modality", "rank")
    near = shown(found.withColumnRenamed("id", "doc_id"))
    return fuse(near.limit(0) if own is None else shown(bm25(own, questions.select("qid", "text"), each)), near, top)


def scopes(question: Column) -> dict[str, Column]:
    return {name: question.rlike(pattern) for name, pattern in SCOPES.items()}


def route(candidates: DataFrame) -> DataFrame:
    """Candidates (qid, question, modality, ...) of the modality that the question names; all if it names several, none or would keep none."""
    s = scopes(F.col("question"))
    named = sum((v.cast("int") for v in s.values()), F.lit(0))
    keep = F.when(named >= 2, True).when(s["has_video"], F.col("modality").isin("video_summary", "video_clip")).when(s["has_image"], F.col("modality").isin("image_global", "image_local")).otherwise(True)
    keep = F.coalesce(keep, F.lit(False))
    return candidates.withColumn("_keep", keep).withColumn("_any", F.max("_keep").over(W.partitionBy("qid"))).where("_keep OR NOT _any").drop("_keep", "_any")


def with_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (qid, pos, ...) with model_score of scores (qid, pos, given, model_score): 0 if missing, of repeated ones the last given."""
    last = scores.groupBy("qid", "pos").agg(F.max_by("model_score", "given").alias("model_score"))
    return candidates.join(last, ["qid", "pos"], "left").withColumn("model_score", F.coalesce("model_score", F.lit(0.0)))


def rerank(candidates: DataFrame, scores: DataFrame, top: int = 5, threshold: float = 0.25, fallback: int = 3) -> DataFrame:
    """Candidates (qid, pos, score, ...) with scores (qid, pos, given, model_score): top by model score, those under the threshold dropped, three kept if all are.

    A single candidate keeps its fused score; without any scores the fused order stays, unthresholded.
    """
    answered = scores.select("qid").distinct().withColumn("answered", F.lit(True))
    c = with_scores(candidates.withColumn("n", F.count("*").over(W.partitionBy("qid"))), scores).join(answered, "qid", "left")
    used = F.coalesce("answered", F.lit(False)) & (F.col("n") > 1)
    c = c.withColumn("used", used).withColumn("rerank_score", F.when(used, F.col("model_score")).otherwise(F.col("score")))
    order = W.partitionBy("qid").orderBy(F.when(F.col("used"), -F.col("rerank_score")), "pos")
    c = c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    good = F.sum((F.col("rerank_score") >= threshold).cast("int")).over(W.partitionBy("qid"))
    c = c.withColumn("good", good).where(~F.col("used") | (F.col("rerank_score") >= threshold) | ((F.col("good") == 0) & (F.col("rank") <= fallback)))
    return c.drop("n", "model_score", "answered", "used", "good")
