"""Stores as Parquet tables: chunks, query logs, evaluation runs and their results; the keyword index has its own (``keyword_store``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import insert_if_absent
from .files import append, read_or_empty, results_name

LOGS = "timestamp string, query_text string, latency_ms double, input_tokens int, output_tokens int, retrieval_strategy string, reranker_used int"
RUNS = """run_id string, timestamp string, dataset_version string, num_queries long, failed_queries long, avg_latency_ms double, input_tokens long, output_tokens long,
    avg_correctness double, avg_hallucination double, avg_faithfulness double, avg_context_precision double, p50_latency_ms double, p95_latency_ms double"""


def add_chunks(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Adds chunks (chunk_id, ...) that the store lacks; of an id repeated in the batch one row."""
    append(insert_if_absent(read_or_empty(spark, path, batch.schema), batch.dropDuplicates(["chunk_id"])), path)


def log_queries(rows: DataFrame, path: str) -> None:
    append(rows, path)


def recent_logs(logs: DataFrame, as_of: Column | str, days: int = 30) -> DataFrame:
    """Log rows of the last days, newest first. Timestamps are ISO text in UTC, whose order is that of time."""
    end = F.lit(as_of) if isinstance(as_of, str) else as_of
    cut = F.date_format(end.cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd'T'HH:mm:ss")
    return logs.where(F.col("timestamp") >= cut).orderBy(F.desc("timestamp"))


def all_logs(logs: DataFrame) -> DataFrame:
    """What the summary reads of every log row, newest first."""
    return logs.select("timestamp", "latency_ms", "input_tokens", "output_tokens").orderBy(F.desc("timestamp"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, LOGS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of any earlier layout: columns added since are null."""
    return read_or_empty(spark, path, RUNS)


def add_run(spark: SparkSession, path: str, run: DataFrame) -> None:
    """Adds a run unless its run_id is there."""
    append(insert_if_absent(read_runs(spark, path), run.dropDuplicates(["run_id"]), "run_id"), path)


def write_results(results: DataFrame, folder: str, run_id: str, timestamp: str) -> str:
    """Results as JSON lines under the run's file name, which is returned."""
    name = results.sparkSession.range(1).select(results_name(F.lit(timestamp)).alias("n")).first()["n"]
    results.withColumns({"run_id": F.lit(run_id), "timestamp": F.lit(timestamp)}).write.mode("overwrite").json(f"{folder}/{name}")
    return name


def read_results(spark: SparkSession, folder: str, run_id: str, timestamp: str | None = None) -> DataFrame:
    """A run's results: the file that its timestamp names, if it is there and holds the run, else by run_id among all files of the folder."""
    if timestamp is not None:
        name = spark.range(1).select(results_name(F.lit(timestamp)).alias("n")).first()["n"]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            named = spark.read.json(f"{folder}/{name}").where(F.col("run_id") == run_id)
            if not named.isEmpty():
                return named
    return spark.read.option("recursiveFileLookup", "true").json(folder).where(F.col("run_id") == run_id)


def health(chunks: DataFrame, docs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of counts of the three stores and whether anything is stored."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = n(chunks, "chunk_count").join(F.broadcast(n(docs, "index_size"))).join(F.broadcast(n(runs, "run_count")))
    return both.withColumn("is_empty", F.col("chunk_count") == 0)
