"""Rows of image and video chunks from what detectors and captioners found; their pictures arrive as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import caption
from .chunking import rescue_box, scene_segments


def region_text(found: Column, filename: Column, region_type: Column, label: Column) -> Column:
    """Caption, or the image's name, with the region's type and label."""
    start = F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.concat(F.lit("Image: "), filename))
    return F.concat_ws(" | ", start, F.concat(F.lit("Region: "), region_type), label)


def image_chunks(images: DataFrame) -> DataFrame:
    """Chunks of images (image_id, filename, mime_type, width, height, caption, regions).

    regions is an array of (region_type, label, bbox, caption). Each image gives one
    chunk of the whole, index 0, and one for each valid region in order: the first of equal
    boxes, clamped or rescued; regions without type or a box of four are left out.
    """
    whole = F.col("image_id").alias("parent_image_id")
    name = F.concat(F.lit("Image: "), "filename")
    r = images.select("image_id", "filename", "mime_type", "width", "height", F.posexplode("regions").alias("pos", "r"))
    first = W.partitionBy("image_id", "r.bbox").orderBy("pos")
    r = r.withColumn("_n", F.row_number().over(first)).where("_n = 1 AND r.region_type IS NOT NULL AND size(r.bbox) = 4")
    box = rescue_box([F.get("r.bbox", F.lit(k)) for k in range(4)], F.col("width"), F.col("height"))
    r = r.withColumn("crop_bbox", box).where("crop_bbox IS NOT NULL")
    label = F.coalesce("r.label", "r.region_type")
    x1, y1, x2, y2 = (F.get("crop_bbox", F.lit(k)) for k in range(4))
    local = r.select(
        "image_id", F.lit("image").alias("type"), F.lit("image_local").alias("modality"), "mime_type", F.row_number().over(W.partitionBy("image_id").orderBy("pos")).alias("chunk_index"),
        region_text(caption(F.col("r.caption")), F.col("filename"), F.col("r.region_type"), label).alias("text"), F.lit(0).alias("page"), whole, F.col("r.region_type").alias("region_type"), label.alias("label"), "crop_bbox",
        F.array(x1 / F.col("width"), y1 / F.col("height"), x2 / F.col("width"), y2 / F.col("height")).alias("crop_bbox_normalized"), (x2 - x1).alias("width_px"), (y2 - y1).alias("height_px"))
    counts = local.groupBy(F.col("image_id").alias("_i")).agg(F.count("*").cast("int").alias("region_count"))
    full = images.join(counts, F.col("image_id") == F.col("_i"), "left").select(
        "image_id", F.lit("image").alias("type"), F.lit("image_global").alias("modality"), "mime_type", F.lit(0).alias("chunk_index"), F.coalesce(F.nullif(caption(F.col("caption")), F.lit("")), name).alias("text"),
        F.lit(0).alias("page"), whole, F.lit("full").alias("region_type"), F.coalesce("region_count", F.lit(0)).alias("region_count"))
    return full.unionByName(local, allowMissingColumns=True)


def scenes(videos: DataFrame) -> DataFrame:
    """(video_id, filename, scene_index, start, stop, forced) of videos (video_id, filename, duration, scenes): none found is one scene, if the video has a length."""
    whole = F.when(F.col("duration") > 0, F.array(F.struct(F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("stop"))))
    found = F.when(F.size("scenes") > 0, F.col("scenes")).otherwise(whole)
    segments = F.flatten(F.transform(found, lambda s: scene_segments(s["start"], s["stop"])))
    return videos.select("video_id", "filename", F.posexplode(segments).alias("scene_index", "s")).select("video_id", "filename", "scene_index", "s.start", "s.stop", "s.forced")


def video_chunks(clips: DataFrame) -> DataFrame:
    """Chunks of clips (video_id, filename, scene_index, start, stop, forced, clip_hash, summary).

    Each clip gives a row of its own and, if it has a summary, one of that. Clips that could not be cut
    (no clip_hash) give none, and the index counts the rows that are there.
    """
    summary = F.coalesce("summary", F.lit(""))
    text = F.when(summary != "", summary).otherwise(F.concat(F.lit("Video: "), "filename", F.lit(" scene "), F.col("scene_index").cast("string")))
    row = lambda kind, modality, forced: F.struct(F.lit(kind).alias("type"), F.lit(modality).alias("modality"), forced.alias("forced_split"))
    rows = F.array_compact(F.array(row("video", "video_clip", F.col("forced")), F.when(summary != "", row("document", "video_summary", F.lit(None).cast("boolean")))))
    x = clips.where("clip_hash IS NOT NULL").withColumn("_text", text).select("*", F.posexplode(rows).alias("_k", "_r"))
    at = F.row_number().over(W.partitionBy("video_id").orderBy("scene_index", "_k")) - 1
    return x.select(
        "video_id", "_r.type", "_r.modality", F.col("_text").alias("text"), F.lit(0).alias("page"), at.alias("chunk_index"), F.col("clip_hash").alias("parent_scene_id"), F.col("start").alias("start_time_seconds"),
        F.col("stop").alias("end_time_seconds"), "scene_index", "_r.forced_split")


def stamped(chunks: DataFrame, source: Column, file_hash: Column) -> DataFrame:
    """Chunks that name the uploaded file and its content's hash."""
    return chunks.withColumns({"source": source, "file_hash": file_hash})


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks without what no index keeps: bytes and vectors."""
    return chunks.drop("image_bytes", "video_bytes", "embedding", "audio_bytes", "pdf_bytes")
