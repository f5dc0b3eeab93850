"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so MinHash of whole documents would find
nothing. Items are partitioned by size (powers of two of their 5-word shingles, repeats
counted, as windows count them); for each size class present, documents are cut into overlapping windows
of 1.25 times the class's upper bound, in steps of a quarter, so that an item
anywhere in a document lies in a window of like size. An item and a window are
candidates if they agree on one of 48 minimum hashes: a window that holds 0.8 of an
item is missed with a probability of about 5e-8, an exact copy with less. Candidates
are verified by exact containment of the item's shingles in the whole document.

Windows' minima are first held against a bitmap of the items' minima (16 MB at most:
beyond some ten million minima it gets less selective), then joined exactly. A
document that passes sends those of its shingles that pass a like bitmap.

Shingles are compared by 64-bit hashes of lower-cased (A-Z) words; a text of fewer
words than five is one shingle, and no text matches a text without words. Nulls: a
null text has no words; rows with null ids are handled like others. Empty tables:
no items leave all documents clean. Repeated rows are each reported or removed;
items of one id are held against documents one by one and the best row is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILARITY, arrow_texts, bitmap, bits_for, in_bitmap, materialise, minhash_multipliers, mixed, put_back, set_apart, shingle_hashes, word_hashes

HASHES = 48
#: Slots of the bitmaps for each of the items' hashes: a long document asks thousands of times.
SLOTS = 1024
LEAST_CLASS = 2


def _shingles(text: bytes) -> np.ndarray:
    return shingle_hashes(word_hashes(text.lower().split()))


def size_class(n: int) -> int:
    """Power of two that is above n, as an exponent; LEAST_CLASS at least."""
    return max(LEAST_CLASS, int(n).bit_length())


def _tagged(minima: np.ndarray, cls: int) -> np.ndarray:
    """Keys (as signed longs) for minima of shape (HASHES, windows): hash number and class are mixed in."""
    tag = mixed(np.arange(HASHES, dtype=np.uint64) * np.uint64(64) + np.uint64(cls))
    return mixed(minima ^ tag[:, None])


def _minima(shingles: np.ndarray, cls: int | None) -> np.ndarray:
    """(HASHES, windows) minima: of all shingles, or of windows of five quarters of 2 ** cls."""
    n, quarter = len(shingles), None if cls is None else max(1, (1 << cls) // 4)
    out = []
    for m in minhash_multipliers(HASHES):
        h = shingles * m
        h ^= h >> np.uint64(29)
        if quarter is None:
            out.append(h.min(keepdims=True))
            continue
        q = np.minimum.reduceat(h, np.arange(0, n, quarter))
        k = max(1, len(q) - 4)
        w = q[:k].copy()
        for i in range(1, min(5, len(q))):
            np.minimum(w, q[i : i + k], out=w)
        out.append(w)
    return np.array(out)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, shingles, keys, classes, rows = [], [], [], [], []
        for row, item, text in zip(batch.column("_item_row").to_pylist(), batch.column("item_id").to_pylist(), arrow_texts(batch), strict=True):
            s = _shingles(text)
            if len(s):
                cls = size_class(len(s))
                s = np.unique(s)
                rows.append(row)
                items.append(item)
                classes.append(cls)
                shingles.append(s.view(np.int64))
                keys.append(np.unique(_tagged(_minima(s, None), cls)).view(np.int64))
        yield pa.RecordBatch.from_pydict(
            {"item_row": pa.array(rows, pa.int64()), "item_id": pa.array(items, batch.column("item_id").type), "cls": pa.array(classes, pa.int32()), "item_shingles": pa.array(shingles, pa.list_(pa.int64())), "keys": pa.array(keys, pa.list_(pa.int64()))})


def candidates(docs: DataFrame, items: DataFrame, text: str, id_column: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(items with shingles and keys; documents (doc_row, doc_id, hits, shingles) of which a window meets an item)."""
    spark = docs.sparkSession
    named = items.select(F.monotonically_increasing_id().alias("_item_row"), F.col("item_id"), F.col("text"))
    item_kind, doc_kind = (df.select(F.col(c)).schema[0].dataType.simpleString() for df, c in ((items, "item_id"), (docs, id_column)))
    index = materialise(named.mapInArrow(_item_rows, f"item_row long, item_id {item_kind}, cls int, item_shingles array<bigint>, keys array<bigint>"))
    classes = sorted(r[0] for r in index.select("cls").distinct().collect())
    smallest = index.agg(F.min(F.size("item_shingles"))).first()[0] or 1
    need = math.ceil(least * smallest - 1e-9)  # no item is held by fewer shingles
    total = lambda c: index.agg(F.sum(F.size(c))).first()[0] or 0
    sent = spark.sparkContext.broadcast(tuple(bitmap(index.select(F.explode(c)), bits_for(total(c), SLOTS)) for c in ("keys", "item_shingles")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_map, shingle_map = sent.value
        for batch in batches:
            out: list[tuple] = []
            for row, doc, t in zip(batch.column("_row").to_pylist(), batch.column("_id").to_pylist(), arrow_texts(batch, "_text"), strict=True):
                s = _shingles(t)
                if not len(s):
                    continue
                known = in_bitmap(shingle_map, s)
                if known.sum() < need:
                    continue
                found = []
                for cls in classes:
                    keys = _tagged(_minima(s, cls), cls).ravel()
                    found.append(keys[in_bitmap(keys_map, keys)])
                hits = np.unique(np.concatenate(found))
                if len(hits):
                    out.append((row, doc, hits.view(np.int64), np.unique(s[known]).view(np.int64)))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), batch.column("_id").type, pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_row", "doc_id", "hits", "shingles"])

    read = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return index, materialise(read.mapInArrow(scan, f"doc_row long, doc_id {doc_kind}, hits array<bigint>, shingles array<bigint>"))


def find(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): documents that hold least of an item's shingles."""
    index, met = candidates(docs, items, text, id_column, least)
    keys = index.select("item_row", F.explode("keys").alias("key"))
    pairs = met.select("doc_row", F.explode("hits").alias("key")).join(keys, "key").select("doc_row", "item_row").distinct()
    both = pairs.join(met.select("doc_row", "doc_id", "shingles"), "doc_row").join(index.drop("keys", "cls"), "item_row")
    shared = F.size(F.array_intersect("shingles", "item_shingles")).cast("long")
    scored = both.select("doc_row", "doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"), shared.alias("n_shared"))
    scored = scored.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= least)
    best = scored.groupBy("doc_row", "doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles", "n_shared")).alias("b"))
    return best.select("doc_row", "doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """docs without those that hold an item; rows that share a doc_id go together, rows without one by a hash of their text.

    The leaks' ids are written first, so Spark knows their size when it chooses the join.
    """
    inner, names = set_apart(docs)
    own, words = names[id_column], names[text]
    key = F.coalesce(F.concat(F.lit("id "), F.col(own).cast("string")), F.concat(F.lit("text "), F.xxhash64(words).cast("string")))
    leaks = find(inner.select(key.alias("key"), F.col(words).alias("text")), items, id_column="key", least=least)
    leaks = materialise(leaks.select(F.col("doc_id").alias("_leak")).distinct())
    return put_back(inner.join(leaks, key == F.col("_leak"), "left_anti"), names)
