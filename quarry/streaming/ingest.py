"""Incremental ingestion: a file stream whose micro-batches insert absent chunks, so replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import insert_if_absent
from ..operators.keywords import searchable
from ..sources.files import append, read_or_empty
from ..sources.keyword_store import add_documents


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, index: str | None = None, stems: bool = False) -> StreamingQuery:
    """Chunks (chunk_id, ...) of arriving files go to the store; with an index path, their texts to the keyword index as well, clips aside."""

    def insert(batch: DataFrame, _: int) -> None:
        append(insert_if_absent(read_or_empty(spark, store, schema), batch.dropDuplicates(["chunk_id"])), store)
        if index:
            some = searchable(batch) if "modality" in batch.columns else batch
            add_documents(spark, index, some.select(F.col("chunk_id").alias("doc_id"), "text"), stems)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
