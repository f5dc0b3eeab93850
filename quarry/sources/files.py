"""File sources and sinks: uploads, golden questions, results, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean, stripped

FORMATS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "mp4": "video", "mov": "video"}
MAX_BYTES = 500 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def format_of(path: Column) -> Column:
    """pdf, image or video by the file's suffix; null if it isn't accepted."""
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[suffix(path)]


def accepted(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Files (path, length, ...) of an accepted suffix and at most ``most`` bytes, with their format."""
    return files.withColumn("format", format_of(F.col("path"))).where(F.col("format").isNotNull() & (F.col("length") <= most))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted files of a folder with their SHA-256."""
    return accepted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)).withColumn("file_hash", F.sha2("content", 256))


def golden_questions(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("queries").alias("q")).select("q.*")
    return rows if category is None else rows.where(F.col("category") == category)


def dispatched(files: DataFrame, pdf: Callable, image: Callable, video: Callable) -> DataFrame:
    """Chunks of accepted files: each format's rows go through its own function of a DataFrame, and the results stand together."""
    of = lambda kind: files.where(F.col("format") == kind)
    return pdf(of("pdf")).unionByName(image(of("image")), allowMissingColumns=True).unionByName(video(of("video")), allowMissingColumns=True)


def blob_name(uri: Column, bucket: str) -> Column:
    """The object's name in the bucket; the text itself if it is of another place."""
    start = f"gs://{bucket}/"
    return F.when(uri.startswith(start), F.substr(uri, F.lit(len(start) + 1))).otherwise(uri)


def with_media(chunks: DataFrame, media: DataFrame) -> DataFrame:
    """chunks (gcs_uri, ...) with the content of media (gcs_uri, content) and fetched, whether it came."""
    return chunks.join(media.select("gcs_uri", "content"), "gcs_uri", "left").withColumn("fetched", F.col("content").isNotNull())


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page, para_no, text) of pages (doc_id, page, blocks): cleaned, stripped blocks in order, empty ones left out; para_no runs through the document."""
    text = stripped(clean(F.col("b")))
    rows = pages.select("doc_id", "page", F.posexplode("blocks").alias("k", "b")).withColumn("text", text).where("text <> ''")
    return rows.select("doc_id", "page", (F.row_number().over(W.partitionBy("doc_id").orderBy("page", "k")) - 1).alias("para_no"), "text")


def title(metadata_title: Column, path: Column) -> Column:
    """The document's own title, or the name of its file."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(stripped(metadata_title), F.lit("")), stem)


def marked_titles(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Paragraphs with is_title: whether the text stands in the document's table of contents (doc_id, title)."""
    t = contents.select("doc_id", F.col("title").alias("text"), F.lit(True).alias("is_title")).distinct()
    return rows.join(t, ["doc_id", "text"], "left").withColumn("is_title", F.coalesce("is_title", F.lit(False)))


def results_name(timestamp: Column) -> Column:
    safe = F.replace(F.replace(F.replace(timestamp, F.lit(":"), F.lit("-")), F.lit("."), F.lit("-")), F.lit("+"), F.lit(""))
    return F.concat(F.lit("results_"), safe, F.lit(".json"))


def media_uri(bucket: str, file_hash: Column, modality: Column, index: Column, mime: Column) -> Column:
    """Where a chunk's picture goes; empty for text."""
    end = F.when(mime == "image/png", ".png").otherwise(".jpg")
    name = F.when(modality.startswith("image"), F.concat(F.lit("img_"), index, end)).when(modality == "video_clip", F.concat(F.lit("video_frame_"), index, F.lit(".jpg")))
    return F.coalesce(F.concat(F.lit(f"gs://{bucket}/media/"), file_hash, F.lit("/"), name), F.lit(""))


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at a path, or no rows if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
