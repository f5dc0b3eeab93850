"""Substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds.

- Written ones: lines of LEAST words or more, and whole texts of up to TEXT words,
  however short. Each has BANDS bands of ROWS minimum hashes of its 5-word shingles; at
  a Jaccard similarity of 0.8 two paragraphs collide in some band with a probability of
  0.98, by which BANDS and ROWS are chosen. Paragraphs that collide are compared
  by exact Jaccard similarity, and those of 0.8 or more link.
- Cut ones: passages often begin in the middle of a line, so windows of LENGTH words
  begin where the 5-word shingle has the smallest hash of REACH neighbours (winnowing).
  Texts that share REACH + LENGTH - 1 words in a row, 50 here, share a window, however
  the words around differ. Windows are too short for an edit at a similarity of 0.8, so
  only equal ones link: an edited passage is found in the stretches between the edits.

Equal paragraphs collapse to one content before anything meets by a band. In a bucket,
only pairs that aren't connected yet are compared and a spanning forest is emitted. A
bucket of more than HOT contents (lines that hold one common passage, for instance) is
dealt anew by FINE_BANDS bands of FINE_ROWS minima each, again 0.98 at 0.8, which
lines of lower similarity seldom share. Linked contents join into components; a
component found in two documents or more is a repeat, of which the first place (by
doc_id, place) stays and the others are removals. Removals of a document that overlap or
adjoin merge to spans.

Texts are read twice: once for paragraphs, once for the shingles of those contents
that share a bucket (found through a bitmap of 16 MB at most, then joined exactly).

Words are lower-cased (A-Z); white space between them doesn't count. Nulls: a null
text has no paragraphs; a null doc_id sorts first; ids keep their type. Repeated rows are documents of their
own. Empty tables give empty results. Lines under LEAST words in longer texts are no
paragraphs: they are as short as common phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, arrow_texts, bitmap, bits_for, components, forest, in_bitmap, materialise, minhash_multipliers, mixed, runs, shingle_hashes, word_hashes

LEAST, TEXT = 20, 100
LENGTH, REACH = 26, 25
BANDS, ROWS = 6, 3
HOT, FINE_BANDS, FINE_ROWS = 256, 24, 8
BLOCK = 200_000
_WORD = re.compile(rb"[^ \t-\r]+")
_ONE = np.zeros(1, np.uint64)


# ---------------------------------------------------------------- paragraphs of a text


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(shingles: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places of the smallest shingle in every ``reach`` neighbours (in fewer: of all). Equal shingles all count."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    reach = min(reach, len(shingles))
    low = _sliding_min(shingles, reach)
    # A place is an anchor if it equals the minimum of a window that holds it.
    padded = np.concatenate((np.zeros(reach - 1, np.uint64), low, np.zeros(reach - 1, np.uint64)))
    most = ~_sliding_min(~padded, reach)
    return np.flatnonzero(most == shingles)


def _placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each word and its place in the paragraph; their sum stands for the words in order."""
    return mixed(hashes ^ mixed(place.astype(np.uint64) + np.uint64(1)))


def _written(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, shingles, first words, lengths, contents) of a text's written paragraphs."""
    lines = [x.split() for x in text.lower().split(b"\n")]
    hashes = word_hashes(list(chain.from_iterable(lines)))
    n, shingles = len(hashes), shingle_hashes(hashes)
    if not n:
        return hashes, shingles, *[np.zeros(0, np.int64)] * 2, hashes
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.cumsum(size) - size
    long = (size >= LEAST) & ((size < n) | (n > TEXT))
    inside = np.append(_placed(hashes, np.arange(n) - np.repeat(first, size)), np.uint64(0))
    start, length = first[long], size[long]
    content = np.add.reduceat(inside, np.ravel(np.column_stack((start, start + length))))[::2] if len(start) else _ONE[:0]
    if n <= TEXT:
        start, length, content = np.append(0, start), np.append(n, length), np.append(_placed(hashes, np.arange(n)).sum(dtype=np.uint64), content)
    return hashes, shingles, start, length, mixed(content)


def _windows(hashes: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, contents) of the cut paragraphs."""
    if len(hashes) < LENGTH:
        return np.zeros(0, np.int64), _ONE[:0]
    at, inside = anchors(shingles), np.arange(LENGTH)
    at = at[at + LENGTH <= len(hashes)]
    return at, ~mixed(_placed(hashes[at[:, None] + inside], inside).sum(axis=1, dtype=np.uint64))


def _minima(shingles: np.ndarray, bounds: np.ndarray, n: int, seed: int) -> Iterator[np.ndarray]:
    """n minimum hashes for paragraphs, whose shingles lie between bounds[2k] and bounds[2k + 1]; shingles has one more at its end."""
    for m in minhash_multipliers(n, seed):
        h = shingles * m
        yield np.minimum.reduceat(h ^ (h >> np.uint64(31)), bounds)[::2]


def bands(shingles: np.ndarray, bounds: np.ndarray, n: int = BANDS, rows: int = ROWS, seed: int = 11) -> np.ndarray:
    """(paragraphs, n) band keys."""
    if not len(bounds):
        return np.zeros((0, n), np.uint64)
    keys = []
    for k, low in enumerate(_minima(np.append(shingles, np.uint64(0)), bounds, n * rows, seed)):
        if k % rows == 0:
            keys.append(np.full(len(low), np.uint64(k + 1)))
        keys[-1] = mixed(keys[-1] ^ low)
    return np.stack(keys, axis=1)


def _bounds(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where the shingles of paragraphs begin and end; under five words make one shingle."""
    return np.ravel(np.column_stack((start, start + np.maximum(1, length - SHINGLE + 1))))


# ---------------------------------------------------------------- scans


def _read(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.col(text).alias("_text"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple] = []
        size = 0
        for row, doc, text in zip(batch.column("_row").to_pylist(), batch.column("_id").to_pylist(), arrow_texts(batch, "_text"), strict=True):
            hashes, shingles, start, length, content = _written(text)
            at, cut = _windows(hashes, shingles)
            if len(start) + len(at):
                held.append((row, doc, shingles, start, length, content, at, cut))
                size += len(hashes)
            if size > BLOCK:
                yield _found(held, batch.column("_id").type)
                held, size = [], 0
        if held:
            yield _found(held, batch.column("_id").type)


def _found(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    rows, docs, shingles, start, length, content, at, cut = zip(*held, strict=True)
    offset = np.cumsum([0, *(len(s) + 1 for s in shingles)])[:-1]
    joined = np.concatenate([x for s in shingles for x in (s, _ONE)])  # a place at each end, so that bounds lie inside
    keys = bands(joined, np.concatenate([_bounds(s, n) + o for s, n, o in zip(start, length, offset, strict=True)])).view(np.int64)
    written, windows = [len(s) for s in start], [len(a) for a in at]
    lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
    keys = pa.concat_arrays([lists, pa.nulls(sum(windows), pa.list_(pa.int64()))])
    spread = lambda x: [v for counts in (written, windows) for v, n in zip(x, counts, strict=True) for _ in range(n)]
    n_words = np.concatenate([*length, np.full(sum(windows), LENGTH)])
    cols = [pa.array(spread(rows), pa.int64()), pa.array(spread(docs), kind), pa.array(np.concatenate([*start, *at]).astype(np.int32)), pa.array(n_words.astype(np.int32)), pa.array(np.concatenate([*content, *cut]).view(np.int64)), keys]
    return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "place", "n", "content", "keys"])


def _shingles_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(content, shingles) of the wanted contents of written paragraphs; shingles are sorted, different ones, 8 bytes each."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bitmap(wanted, bits_for(wanted.count())))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = sent.value, set()
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for t in arrow_texts(batch, "_text"):
                _, shingles, start, length, content = _written(t)
                bounds = _bounds(start, length)
                for k in np.flatnonzero(in_bitmap(marks, content)):
                    c = int(content[k : k + 1].view(np.int64)[0])
                    if c not in seen:
                        seen.add(c)
                        out.append((c, np.unique(shingles[bounds[2 * k] : bounds[2 * k + 1]]).tobytes()))
                if len(seen) >= 500_000:
                    seen.clear()  # only spares repeats
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.binary())], ["content", "shingles"])

    texts = docs.select(F.col(text).alias("_text")).mapInArrow(again, "content long, shingles binary")
    return materialise(texts.groupBy("content").agg(F.max("shingles").alias("shingles")))


# ---------------------------------------------------------------- links


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in runs(batches, "key"):
        content, shingles = table.column("content").to_numpy(), table.column("shingles").to_pylist()
        edges: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(starts) > 1):
            base = int(starts[k])
            sets = [np.frombuffer(x, np.uint64) for x in shingles[base : starts[k + 1]]]
            size = np.fromiter(map(len, sets), np.int64, len(sets))

            def linked(i: int, others: np.ndarray, sets=sets, size=size) -> np.ndarray:
                out = np.zeros(len(others), bool)
                like = np.minimum(size[others], size[i]) >= SIMILARITY * np.maximum(size[others], size[i])
                for j in np.flatnonzero(like):
                    out[j] = similarity(sets[i], sets[others[j]]) >= SIMILARITY - 1e-9
                return out

            edges += [(base + i, base + j) for i, j in forest(len(sets), linked)]
        if edges:
            pairs = np.array(edges, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(content[pairs[:, 0]]), pa.array(content[pairs[:, 1]])], ["a", "b"])


def _fine_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        end = np.cumsum([len(s) + 1 for s in sets])
        bounds = np.ravel(np.column_stack((end - [len(s) + 1 for s in sets], end - 1)))
        keys = bands(np.concatenate([x for s in sets for x in (s, _ONE)]), bounds, FINE_BANDS, FINE_ROWS, seed=13)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column("content").to_numpy(), FINE_BANDS))], ["key", "content"])


def _buckets(members: DataFrame) -> DataFrame:
    """(key, content, size) of the keys that several contents have."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return materialise(members.join(sizes, "key"))


def near_contents(docs: DataFrame, contents: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect different contents of like shingles; contents has one row (content, keys) for each."""
    buckets = _buckets(contents.select("content", F.explode("keys").alias("key")))
    texts = _shingles_of(docs, buckets.select("content").distinct(), text)
    meet = lambda b: b.select("key", "content").join(texts, "content").repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges, "a long, b long")
    edges = meet(buckets.where(F.col("size") <= hot))
    large = buckets.where(F.col("size") > hot).select("content").distinct()
    if not large.isEmpty():
        edges = edges.unionByName(meet(_buckets(large.join(texts, "content").mapInArrow(_fine_keys, "key long, content long"))))
    return edges.distinct()


# ---------------------------------------------------------------- repeats


def paragraphs(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(row, doc_id, place, n, content, component, removed), one row for each place of a paragraph that repeats across documents.

    row numbers documents, place and n count words, component is the smallest content
    (a signed hash) of the component, of which one place isn't removed.
    """
    read = _read(docs, text, id_column)
    found = materialise(read.mapInArrow(_scan, f"row long, doc_id {read.schema['_id'].dataType.simpleString()}, place int, n int, content long, keys array<bigint>"))
    first = F.min(F.struct("doc_id", "row", "place")).alias("first")
    spread = [first, F.min("row").alias("low"), F.max("row").alias("high")]

    # Windows: hashes alone are shuffled to see which repeat; the rest of the rows goes only for those.
    cut = found.where("keys IS NULL").drop("keys")
    twice = materialise(cut.groupBy("content").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("content"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(twice, bits_for(twice.count())))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(sent.value, batch.column("content").to_numpy())))

    cut = cut.mapInArrow(repeated, cut.schema)
    cut_classes = cut.groupBy("content").agg(*spread).where("low < high").select("content", F.col("content").alias("component"), "first")

    # Written paragraphs: one row for each content before any meet by key, so a common line is no heavier there.
    contents = materialise(found.where("keys IS NOT NULL").groupBy("content").agg(*spread, F.first("keys").alias("keys")))
    roots = components(near_contents(docs, contents, text))
    named = contents.drop("keys").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("root", "content"))
    classes = named.groupBy("component").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("component", "first")
    line_classes = named.select("content", "component").join(classes, "component").select("content", "component", "first")

    places = cut.unionByName(found.where("keys IS NOT NULL").drop("keys"))
    out = places.join(materialise(cut_classes.unionByName(line_classes)), "content")
    kept = (F.col("first.row") == F.col("row")) & (F.col("first.place") == F.col("place"))
    return out.select("row", "doc_id", "place", "n", "content", "component", (~kept).alias("removed"))


def repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, first_word, n_words, removed, n_paragraphs, component): spans of the documents that repeat.

    A span merges the removed paragraphs, or those that stay, that overlap or adjoin; component is its
    smallest. Spans of one document that stay may overlap some that go.
    """
    own = W.partitionBy("row", "removed").orderBy("place", "n")
    end = F.col("place") + F.col("n")
    begins = F.coalesce(F.max(end).over(own.rowsBetween(W.unboundedPreceding, -1)) < F.col("place"), F.lit(True))
    spans = paragraphs(docs, text, id_column).withColumn("_new", begins.cast("int")).withColumn("_span", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("row", "removed", "_span").agg(
        F.first("doc_id").alias("doc_id"), F.min("place").alias("first_word"), (F.max(end) - F.min("place")).alias("n_words"), F.count("*").alias("n_paragraphs"), F.min("component").alias("component"))
    return merged.select("doc_id", "first_word", "n_words", "removed", "n_paragraphs", "component")


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """UTF-8 byte spans of a text's spans (first_word, n_words), merged."""
    at = [m.span() for m in _WORD.finditer(text.encode())]
    out: list[list[int]] = []
    for first, n in sorted(spans):
        a, b = at[first][0], at[first + n - 1][1]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
