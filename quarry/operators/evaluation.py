"""Evaluation runs: judges' outputs to scores, results of each question, runs and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import judged, stripped
from . import measures

#: Each judge's field in its output and highest score.
JUDGES = {"correctness": ("score", 5.0), "hallucination": ("hallucination_rate", 1.0), "faithfulness": ("score", 5.0), "precision": ("precision", 1.0)}
DRY_RUN = 5


def judge_contexts(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, context) as judges read the chunks (qid, pos, source, page, text); a note for questions without any."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("source", F.lit("unknown")), F.lit(" p"), F.coalesce("page", F.lit(0)).cast("string"), F.lit(": "), stripped(F.coalesce("text", F.lit(""))))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    g = chunks.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n").alias("context"))
    return questions.select("qid").join(g, "qid", "left").select("qid", F.coalesce("context", F.lit("(no chunks retrieved)")).alias("context"))


def judge_scores(outputs: DataFrame) -> DataFrame:
    """(qid, scores, reasoning) from outputs (qid, n_chunks, correctness, hallucination, faithfulness, precision) of the judges.

    Without chunks precision is 0 and its judge isn't asked. A null output is a judge
    that failed after its retries: then the question has no scores.
    """
    read = {name: judged(F.col(name), field, most) for name, (field, most) in JUDGES.items()}
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit("No chunks retrieved.").alias("reasoning"))
    read["precision"] = F.when(F.col("n_chunks") == 0, nothing).otherwise(read["precision"])
    asked = [F.col(name).isNotNull() if name != "precision" else (F.col("n_chunks") == 0) | F.col(name).isNotNull() for name in JUDGES]
    all_came = asked[0] & asked[1] & asked[2] & asked[3]
    part = lambda field: F.when(all_came, F.struct(*[c[field].alias(name) for name, c in read.items()]))
    return outputs.select("qid", part("score").alias("scores"), part("reasoning").alias("reasoning"))


def retrieved(chunks: DataFrame) -> DataFrame:
    """(qid, retrieved_chunks): text, source, page, modality and score, the reranked one if there is one, of chunks (qid, pos, ..., score, rerank_score)."""
    score = F.bround(F.coalesce("rerank_score", "score", F.lit(0.0)), 4)
    d = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(d("text", ""), d("source", ""), d("page", 0), d("modality", ""), score.alias("score")).alias("c"))))
    return chunks.groupBy("qid").agg(F.transform(rows, lambda x: x["c"]).alias("retrieved_chunks"))


def run(golden: DataFrame, answered: DataFrame, chunks: DataFrame, judges: DataFrame) -> DataFrame:
    """One result a golden question (id, query, category, source_modality, ground_truth).

    answered is (qid, answer, error, latency_ms, input_tokens, output_tokens): an error, or no row, makes
    the status error and leaves scores null; failed judges leave scores null with status ok.
    """
    a = answered.withColumnRenamed("qid", "id")
    met = golden.join(a, "id", "left").join(retrieved(chunks).withColumnRenamed("qid", "id"), "id", "left").join(judge_scores(judges).withColumnRenamed("qid", "id"), "id", "left")
    failed = F.col("error").isNotNull() | F.col("answer").isNull()
    ok = lambda c: F.when(~failed, c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    empty = F.array().cast("array<struct<text:string,source:string,page:int,modality:string,score:double>>")
    return met.select(
        F.col("id").alias("query_id"), "query", text("category"), text("source_modality"), F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, F.concat(F.lit("ERROR: "), F.coalesce("error", F.lit("no answer")))).otherwise(F.col("answer")).alias("generated_answer"), text("ground_truth"),
        F.coalesce(ok(F.col("retrieved_chunks")), empty).alias("retrieved_chunks"), F.round(F.coalesce("latency_ms", F.lit(0.0)), 1).alias("latency_ms"), F.coalesce(ok(F.col("input_tokens")), F.lit(0)).alias("input_tokens"),
        F.coalesce(ok(F.col("output_tokens")), F.lit(0)).alias("output_tokens"), ok(F.col("scores")).alias("scores"), ok(F.col("reasoning")).alias("reasoning"))


def flat(results: DataFrame) -> DataFrame:
    """Results with their scores as columns, as the measures take them."""
    return results.select("*", *[F.col(f"scores.{name}").alias(name) for name in JUDGES]).drop("scores", "reasoning")


def run_row(results: DataFrame, run_id: str, timestamp: str, dataset_version: str = "1.0") -> DataFrame:
    """The run's row (run_id, timestamp, dataset_version and the summary)."""
    s = measures.eval_summary(flat(results))
    return s.select(F.lit(run_id).alias("run_id"), F.lit(timestamp).alias("timestamp"), F.lit(dataset_version).alias("dataset_version"), *s.columns)


def query_logs(results: DataFrame, timestamp: str) -> DataFrame:
    """Log rows of a run: questions whose pipeline succeeded count as traffic."""
    return results.where("status = 'ok'").select(
        F.lit(timestamp).alias("timestamp"), F.col("query").alias("query_text"), "latency_ms", "input_tokens", "output_tokens", F.lit("hybrid").alias("retrieval_strategy"), F.lit(1).alias("reranker_used"))


def dry_run(golden: DataFrame, order: str, n: int = DRY_RUN) -> DataFrame:
    """The first n questions in the file's order."""
    return golden.orderBy(order).limit(n)


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("run_id"))


def chosen_run(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The row of a run, or of the newest; no rows if there is none."""
    return newest_first(runs).limit(1) if run_id is None else runs.where(F.col("run_id") == run_id)


def default_comparison(runs: DataFrame) -> DataFrame:
    """(run_id, role) of the two newest runs: B the newest, A the one before."""
    two = newest_first(runs).limit(2)
    n = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("timestamp"), F.desc("run_id")))  # of two rows
    return two.select("run_id", F.when(n == 1, "B").otherwise("A").alias("role"))
