"""What surrounds a generated answer: context, sources, citation checks, refusals. The answer itself is a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations, degraded, header, invented, passage, snippet, stripped

#: Fixed value: the answer to a question for which nothing was found.
REFUSAL = "I don't have enough information to answer this."


def contexts(chunks: DataFrame) -> DataFrame:
    """(qid, context, sources, chunks_used, media_chunks_degraded) of reranked chunks (qid, pos, text, source, page, modality, gcs_uri, fetched, score).

    pos counts from 1; fetched says whether the chunk's picture came. A question has the few
    chunks that reranking leaves, so they meet in one array. The score is the fused one.
    """
    c = F.col
    line = header(c("pos"), c("source"), c("page"), c("text"), c("modality"), c("gcs_uri"))
    source = F.struct(F.coalesce("source", F.lit("unknown")).alias("filename"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("score", F.lit(0.0)).alias("score"), snippet(c("text")).alias("snippet"))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), source.alias("source"))))
    lost = F.sum(degraded(c("modality"), c("gcs_uri"), c("fetched")).cast("int"))
    g = chunks.groupBy("qid").agg(rows.alias("r"), lost.cast("int").alias("media_chunks_degraded"))
    text = F.concat(F.lit("Context:\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n\n"))
    return g.select("qid", text.alias("context"), F.transform("r", lambda x: x["source"]).alias("sources"), F.size("r").alias("chunks_used"), "media_chunks_degraded")


def prompts(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, prompt) of questions (qid, question) that have chunks."""
    end = F.concat(F.lit("\n\nQuestion: "), "question", F.lit("\n\nAnswer:"))
    return questions.join(contexts(chunks), "qid").select("qid", F.concat("context", end).alias("prompt"))


def answers(questions: DataFrame, chunks: DataFrame, generated: DataFrame, model: str = "") -> DataFrame:
    """One row for each question: (qid, answer, sources, chunks_used, model, media_chunks_degraded, input_tokens, output_tokens, cited, invented, logged).

    generated is (qid, answer, input_tokens, output_tokens). Questions without chunks get the refusal and aren't logged.
    """
    g = generated.select("qid", stripped(F.col("answer")).alias("_a"), "input_tokens", "output_tokens")
    met = questions.select("qid").join(contexts(chunks), "qid", "left").join(g, "qid", "left")
    none = F.col("chunks_used").isNull()
    nought = lambda c: F.when(none, 0).otherwise(F.coalesce(c, F.lit(0)))
    answer = F.when(none, REFUSAL).otherwise(F.coalesce("_a", F.lit("")))
    out = met.select(
        "qid", answer.alias("answer"), F.coalesce("sources", F.array().cast("array<struct<filename:string,page:int,score:double,snippet:string>>")).alias("sources"), nought("chunks_used").alias("chunks_used"),
        F.lit(model).alias("model"), nought("media_chunks_degraded").alias("media_chunks_degraded"), nought("input_tokens").alias("input_tokens"), nought("output_tokens").alias("output_tokens"), (~none).alias("logged"))
    out = out.withColumn("cited", citations(F.col("answer")))
    return out.withColumn("invented", invented(F.col("cited"), F.col("chunks_used")))


def cited_sources(answered: DataFrame) -> DataFrame:
    """(qid, n, filename, page, score, snippet) of the sources that answers cite; numbers beyond the list are left out."""
    x = answered.select("qid", "sources", F.explode("cited").alias("n")).where("n BETWEEN 1 AND size(sources)")
    return x.select("qid", "n", F.element_at("sources", F.col("n").cast("int")).alias("s")).select("qid", "n", "s.*")


def passages(candidates: DataFrame) -> DataFrame:
    """(qid, pos, passage) that the reranker reads of candidates (qid, pos, text, modality, gcs_uri, fetched)."""
    shown = passage(F.col("text"), F.col("modality"), F.col("gcs_uri"), F.col("fetched"))
    return candidates.select("qid", "pos", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), shown).alias("passage"))
