"""Pieces that several operators share: words, shared tables, runs and components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Runs of characters other than ASCII white space. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.8


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ..., and the new name of each: names inside an operator can't clash with them then."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def put_back(docs: DataFrame, names: dict[str, str], *more: str | Column) -> DataFrame:
    """The columns that were set apart under their own names, and more."""
    return docs.select(*[F.col(new).alias(own) for own, new in names.items()], *more)


def arrow_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


@contextlib.contextmanager
def short_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of some ``size`` bytes, a row at least. A task holds a batch several times over, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---------------------------------------------------------------- shingles

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_hashes(x: np.ndarray) -> np.ndarray:
    """As the xxhash64 function of Spark, of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = x * p2
    x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * p1 ^ (p5 + np.uint64(42 + 8))
    x = ((x << np.uint64(27)) | (x >> np.uint64(37))) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each window of k words; fewer words make one shingle, none make none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _MUL + hashes[i : n - k + 1 + i]
    return mixed(out)


def minhash_multipliers(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- bitmaps of hashes

LEAST_BITS, MOST_BITS = 18, 27


def bits_for(n: int, slots: int = 8) -> int:
    """Size of a bitmap for n hashes, as an exponent: ``slots`` a hash or up to twice that, 32 KB at least and 16 MB at most."""
    return min(MOST_BITS, max(LEAST_BITS, (slots * n).bit_length()))


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """Which of 2 ** bits slots (their top bits) the longs of the first column fall in.

    Executors build it in pieces of 4 KB, of which 2 ** (bits - 15) reach the driver.
    A bitmap only spares rows a shuffle: what passes is joined exactly, so a full one costs time, not results.
    """
    slot = F.shiftrightunsigned(values.columns[0], 64 - bits)
    pieces = values.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(32767))).alias("marks"))
    out = np.zeros((1 << bits) // 32768, "V4096")
    for piece, marks in pieces.collect():
        out[piece] = np.void(bytes(marks))
    return out.view(np.uint8)


def in_bitmap(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (8 * len(marks)).bit_length() - 1
    slot = values.view(np.uint64) >> np.uint64(64 - bits)
    return (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- runs of equal keys in sorted partitions


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) for batches of a partition that is sorted by an integer key: no run of one key is cut. starts has an end mark."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if keys[0] == keys[-1] and (len(held) == 1 or held[0].column(key)[0].as_py() == keys[0]):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        yield table.slice(0, last), _starts(keys[:last])
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table.column(key).to_numpy())


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what the links connect among n things, at most n - 1.

    linked(i, others) says which others i links to. A thing is only held against
    things outside its present component, so a dense group costs a few passes.
    """
    label = np.arange(n)
    edges = []
    for i in range(n):
        others = np.flatnonzero(label != label[i])
        others = others[others > i]
        if not len(others):
            continue
        for j in others[linked(i, others)]:
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]
    return edges


# ---------------------------------------------------------------- rows packed by bucket


def bucket_bits(n: int) -> int:
    """How many buckets n rows take, as an exponent: some 2 ** 17 rows each, 2 ** 20 buckets at most."""
    return min(20, max(8, (n >> 17).bit_length()))


def packed(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """(buckets, columns) of rows in order of their buckets: one row for each bucket, a column's values there as bytes.

    What is shuffled is then a few large rows, not many small ones.
    """
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
    ends = np.append(first, len(bucket))
    size = lambda c: c.nbytes // max(1, len(c))
    bytes_of = lambda c: [None, pa.py_buffer((ends * size(c)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]
    return bucket[first], [pa.Array.from_buffers(pa.binary(), len(first), bytes_of(c)) for c in columns]


def unpacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The values of a packed column, end to end."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def low_bytes(values: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def from_low_bytes(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view("<u8").ravel()


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that agree in all columns begin, of rows in order."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edge table: root is the smallest node of its component.

    Each round sends every node to its smallest neighbour, follows that pointer
    twice more and contracts the edges; the number of edges falls geometrically.
    All tables are distributed and end in the shared folder after each round.
    """
    e = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    label = materialise(nodes.select("node", F.col("node").alias("root")))
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p")
        step = materialise(step)
        for _ in range(2):
            up = step.select(F.col("node").alias("p"), F.col("p").alias("q"))
            step = step.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        step = materialise(step)
        to = lambda c, name: step.select(F.col("node").alias(c), F.col("p").alias(name))
        e = materialise(e.join(to("a", "x"), "a").join(to("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        label = materialise(label.join(to("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return label
