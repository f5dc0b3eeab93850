"""Chunks of paragraphs, tokens, scenes and image regions; their ids and insertion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import TOKEN, has_marker  # noqa: F401
from ..sources.scratch import materialise
from .blocks import number
from .counters import BytePairs, Words

MOST, OVERLAP = 800, 100
SCENE, BACK = 120.0, 5.0
BATCHES = {"image": 6, "document": 20, "video": 1}


def headings(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para_no, text, is_title) without titles, each with the last title before it or ''."""
    w = W.partitionBy("doc_id").orderBy("para_no").rowsBetween(W.unboundedPreceding, 0)
    return paragraphs.withColumn("heading", F.coalesce(F.last(F.when(F.col("is_title"), F.col("text")), ignorenulls=True).over(w), F.lit(""))).where(~F.col("is_title")).drop("is_title")


def overlap_tail(paragraphs: DataFrame, most: int = OVERLAP) -> DataFrame:
    """The longest suffix of whole paragraphs (doc_id, para_no, n_tokens) within ``most`` tokens."""
    w = W.partitionBy("doc_id").orderBy(F.desc("para_no")).rowsBetween(W.unboundedPreceding, 0)
    return paragraphs.withColumn("tail_tokens", F.sum("n_tokens").over(w)).where(F.col("tail_tokens") <= most)


def token_windows(n: Column, size: int = MOST, overlap: int = OVERLAP) -> Column:
    """Array of (start, stop) token windows of a text of n tokens."""
    step = size - overlap
    k = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((i * step).cast("long").alias("start"), F.least(i * step + size, n).cast("long").alias("stop")))


def scene_segments(start: Column, stop: Column, most: float = SCENE, back: float = BACK) -> Column:
    """Array of (start, stop, forced): a scene as it is or, if longer than ``most`` seconds, in overlapping segments."""
    length, step = stop - start, most - back
    k = F.when(length <= most, 0).otherwise(F.ceil((length - most) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((start + i * step).alias("start"), F.least(start + i * step + most, stop).alias("stop"), (length > most).alias("forced")))


def _sections(paragraphs: DataFrame, most: int, overlap: int) -> DataFrame:
    """Paragraphs (doc_id, idx, heading, n_tokens) with section, carry, before, tail and tail_before.

    What a document's chunks look like from a new heading on, or from a paragraph after one
    above ``most``, doesn't depend on what came before but for the paragraphs carried over:
    there the open chunk is closed in any case. Such places begin sections, which fold apart.
    before: tokens ahead of the paragraph. tail: the first paragraph of those that a chunk closed here would
    carry over, which is a range of the running sums; tail_before: the tokens ahead of that.
    """
    own = W.partitionBy("doc_id").orderBy("idx")
    p = paragraphs.withColumn("before", F.sum("n_tokens").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens"))
    big_before = F.coalesce(F.lag("n_tokens").over(own) > most, F.lit(False))
    turned = F.coalesce(F.lag("heading").over(own) != F.col("heading"), F.lit(False))
    begins = (F.col("idx") == 1) | turned | big_before | (F.col("n_tokens") > most)
    p = p.withColumns({"carry": turned & ~big_before, "begins": begins.cast("int")})
    reach = W.partitionBy("doc_id").orderBy("before").rangeBetween(-overlap, 0)
    return p.withColumns({"section": F.sum("begins").over(own.rowsBetween(W.unboundedPreceding, 0)), "tail": F.min("idx").over(reach), "tail_before": F.min("before").over(reach)}).drop("begins")


def section_chunks(rows: Iterable[tuple], most: int) -> Iterator[tuple]:
    """(doc_id, section, heading, k, first, end): the chunks of sections as ranges of paragraphs, the first of which may begin in what is carried over.

    rows (doc_id, section, heading, idx, n_tokens, before, carry, tail, tail_before) are in order; those of a section follow each other.
    """
    key, heading, k, first, since, last = None, "", 0, 0, 0, 0
    for doc, section, own, at, n, before, carry, tail, tail_before in rows:
        if (doc, section) != key:
            if key:
                yield *key, heading, k, first, last + 1
            key, heading, k = (doc, section), own, 0
            first, since = (tail, tail_before) if carry else (at, before)
            if n > most and first < at:  # what is carried to it is a chunk of its own
                yield *key, heading, k, first, at
                k, first, since = 1, at, before
        if first < at and before + n - since > most:
            yield *key, heading, k, first, at
            k, first, since = k + 1, tail, tail_before
        last = at
    if key:
        yield *key, heading, k, first, last + 1


def fold_chunks(paragraphs: DataFrame, most: int = MOST, overlap: int = OVERLAP, counter: Words | BytePairs | None = None) -> DataFrame:
    """(doc_id, chunk_index, page, heading, text) from paragraphs (doc_id, para_no, page, heading, text).

    A chunk takes paragraphs up to ``most`` tokens and ends at a new heading; the next begins with the last ones of it, of at most
    ``overlap`` tokens, under the new heading. A paragraph above ``most`` is cut into windows. Chunks that hold a marker go but use up an index.

    Only numbers meet by document (running sums) and by section (the fold); texts are joined to the chunks they belong to, so
    a document of any length spreads over tasks. ``counter`` says what a token is (None: words and punctuation marks). A null
    heading is '', a null text is empty; paragraphs without a doc_id belong to no document; paragraphs of one number are in the order of their texts. Ids keep their type.
    """
    counter = counter or Words()
    clean = paragraphs.where("doc_id IS NOT NULL").select("doc_id", "para_no", "page", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = F.row_number().over(W.partitionBy("doc_id").orderBy("para_no", "text"))
    kept = materialise(counter.counted(clean).withColumn("idx", numbered))
    sections = _sections(kept.select("doc_id", "idx", "heading", "n_tokens"), most, overlap)
    kind = dict(kept.dtypes)["doc_id"]

    columns = ["doc_id", "section", "heading", "idx", "n_tokens", "before", "carry", "tail", "tail_before"]
    made = ["doc_id", "section", "heading", "k", "first", "end"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        found = section_chunks(rows, most)
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], made)

    types = [to_arrow_type(kept.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    ordered = sections.repartition("doc_id", "section").sortWithinPartitions("doc_id", "section", "idx")
    chunks = materialise(ordered.mapInArrow(fold, f"doc_id {kind}, section long, heading string, k int, first int, end int"))
    cut = F.pandas_udf(lambda ts: ts.map(lambda t: None if t is None else counter.windows(t, most, overlap)), "array<string>")
    # Places of chunks come from numbers, so texts need not meet by document again.
    long_ones = kept.where(F.col("n_tokens") > most).select("doc_id", F.col("idx").alias("first"), F.size(cut("text")).alias("pieces"))
    pieces = F.coalesce(F.when(F.col("end") - F.col("first") == 1, F.col("pieces")), F.lit(1))
    before = F.sum("pieces").over(W.partitionBy("doc_id").orderBy("section", "k").rowsBetween(W.unboundedPreceding, 0)) - F.col("pieces")
    chunks = chunks.join(long_ones, ["doc_id", "first"], "left").withColumn("pieces", pieces).withColumn("place", before)
    parts = chunks.withColumn("idx", F.explode(F.sequence("first", F.col("end") - 1))).join(kept.select("doc_id", "idx", "page", "text", "n_tokens"), ["doc_id", "idx"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n")
    whole = parts.groupBy("doc_id", "section", "k").agg(
        F.first("heading").alias("heading"), F.first("place").alias("place"), F.min_by("page", "idx").alias("page"), F.max("n_tokens").alias("n"), F.count("*").alias("size"), texts.alias("text"))
    long = F.when((F.col("n") > most) & (F.col("size") == 1), F.col("text"))  # a UDF sees all rows, whatever stands around it
    pieces = F.coalesce(cut(long), F.array("text"))
    out = whole.select("doc_id", "place", "heading", "page", F.posexplode(pieces).alias("part", "text"))
    at = (F.col("place") + F.col("part")).cast("int")
    return out.select("doc_id", at.alias("chunk_index"), F.col("page").cast("int").alias("page"), "heading", "text").where(~has_marker(F.col("text")))


def clamp_box(box: list[Column], width: Column, height: Column, least: int = 10) -> Column:
    """Array x1 y1 x2 y2 within the image; null if a side comes below ``least``."""
    x1, y1, x2, y2 = (F.greatest(F.lit(0), F.least(c, m)) for c, m in zip(box, (width, height, width, height), strict=True))
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), F.array(x1, y1, x2, y2).cast("array<int>"))


def rescue_box(box: list[Column], width: Column, height: Column, lowest: float = 0.75) -> Column:
    """The clamped box; if that is null, the box scaled down by its overshoot on each axis, unless by under ``lowest``."""
    x1, y1, x2, y2 = box
    sx = F.when(x2 > width, width / x2).otherwise(1.0)
    sy = F.when(y2 > height, height / y2).otherwise(1.0)
    scaled = [F.bround(c * s).cast("int") for c, s in ((x1, sx), (y1, sy), (x2, sx), (y2, sy))]
    return F.coalesce(clamp_box(box, width, height), F.when((sx >= lowest) & (sy >= lowest), clamp_box(scaled, width, height)))


def chunk_id(file_hash: Column, index: Column) -> Column:
    return F.sha2(F.concat(file_hash, F.lit(":"), index.cast("string")), 256)


def insert_if_absent(store: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of batch whose key the store lacks; stored rows are never changed."""
    return batch.join(store.select(key).distinct(), key, "left_anti")


def first_regions(regions: DataFrame) -> DataFrame:
    """The first of equal boxes (image_id, pos, bbox, ...), numbered from 1 in each image."""
    first = W.partitionBy("image_id", "bbox").orderBy("pos")
    once = regions.where("bbox IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("chunk_index", F.row_number().over(W.partitionBy("image_id").orderBy("pos")))


def batches(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, type) with batch and place by the type's batch size; unknown types are left out."""
    out = None
    for kind, size in BATCHES.items():
        own = number(chunks.where(F.col("type") == kind).select("doc_id", "type"), "doc_id")
        own = own.select("doc_id", "type", F.floor(F.col("n") / size).cast("long").alias("batch"), (F.col("n") % size).cast("long").alias("place"))
        out = own if out is None else out.unionByName(own)
    return out
