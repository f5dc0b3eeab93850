"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows fall by hash into input partitions, whose sizes are counted. How many rows
partition p sends to each cell of each shard follows the multivariate hypergeometric
law, as a uniform permutation of all rows would deal them. The matrix is drawn on the
executors: halves of the partitions share the cells' room by one seeded draw, their
halves again, and each partition draws the path down to its own row; so nobody holds
more than a row, and all agree. Each partition then deals its rows in a random order
along its row of the matrix, the cells are exchanged and each is permuted again. Shard
sizes differ by one row at most.

Random orders come from seeded hashes of the row's id and text and of its number among
the rows that are equal in both, so reruns agree, a lost task is redone alike and
repeated rows fall apart as any others. Nulls: a null text has no bytes; null ids hash
as null. Empty tables give an empty result. Further columns may have any names but
shard and slot, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import put_back, set_apart

ROW_BYTES = 16


#: The generator draws from fewer things than this at once.
LIMIT = 10**9
#: Rows are counted in so many hash ranges; there are no more input partitions.
FINE = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn of good + bad, for any size.

    Of very many, each is first taken with the same chance, which gives two binomials;
    then as many as are missing, or too many, are drawn from the rest or put back.
    """
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    chance = n / (good + bad)
    a, b = int(rng.binomial(good, chance)), int(rng.binomial(bad, chance))
    if a + b <= n:
        return a + hypergeometric_few(rng, good - a, bad - b, n - a - b)
    return a - hypergeometric_few(rng, a, b, a + b - n)


def hypergeometric_few(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < LIMIT or n > 64:
        return hypergeometric(rng, good, bad, n)
    hit = 0
    for k in range(n):
        hit += rng.integers(good + bad - k) < good - hit
    return hit


def _draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How n rows fall into cells of that room."""
    if room.sum() < LIMIT:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out, left, rest = np.zeros(len(room), np.int64), n, int(room.sum())
    for k, r in enumerate(room.tolist()):
        rest -= r
        out[k] = hypergeometric(rng, r, rest, left)
        left -= out[k]
    return out


def matrix_row(p: int, sizes: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the matrix: what partition p sends to each cell. All rows add up to the cells, each to its size."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    first, last, room = 0, len(sizes), cells.astype(np.int64)
    while last - first > 1:
        mid = (first + last) // 2
        left = _draw(np.random.default_rng([seed, first, last]), room, int(total[mid] - total[first]))
        first, last, room = (first, mid, left) if p < mid else (mid, last, room - left)
    return room


def cell_sizes(rows: int, shards: int, cells: int) -> np.ndarray:
    """Sizes of the cells of all shards: shards differ by one row at most, and so do a shard's cells."""
    even = lambda n, k: n // k + (np.arange(k) < n % k)
    return np.concatenate([even(n, cells) for n in even(rows, shards)])


def assign(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text", seed: int = 20240229, partition_rows: int = 4_000_000, least_partitions: int = 256, least_cells: int = 8) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (0, 1, ... in the shard). Columns of docs with these names are replaced.

    partition_rows is the number of rows that a task sorts, as long as there are FINE partitions at most.
    """
    docs = docs.drop("shard", "slot")
    content = F.xxhash64(F.col(id_column), F.col(text))
    salt = lambda k: F.xxhash64(F.lit(seed + k), F.col("_content"), F.col("_copy"))
    first, second = salt(1), salt(2)

    def part(n: int) -> Column:
        return F.pmod(salt(0), F.lit(n)).cast("int")

    # Numbers from 1 for each content: the rows themselves needn't meet to be counted.
    copies = docs.select(content.alias("_content")).groupBy("_content").count().select("_content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("_copy"))
    counts = copies.groupBy(part(FINE).alias("p")).count().toPandas()
    rows = int(counts["count"].sum())
    n = min(FINE, max(least_partitions, 1 << (rows // partition_rows).bit_length()))  # a power of two, so that ranges fold
    k = max(least_cells, -(-rows // (shards * partition_rows)))
    sizes = np.bincount(counts["p"].to_numpy(np.int64) % n, counts["count"].to_numpy(np.float64), n).astype(np.int64)
    cells = cell_sizes(rows, shards, k)
    offsets = (np.cumsum(cells.reshape(shards, k), axis=1) - cells.reshape(shards, k)).ravel()

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"_p": pdf["id"], "_ends": [np.cumsum(matrix_row(p, sizes, cells, seed)) for p in pdf["id"]]})

    deal = docs.sparkSession.range(n).mapInPandas(rows_of, "_p int, _ends array<bigint>")
    # Places are dealt to (content, copy), a few bytes each; texts meet them at the end.
    ties = ["_content", "_copy"]
    dealt = copies.withColumn("_p", part(n)).withColumn("_at", F.row_number().over(W.partitionBy("_p").orderBy(first, *ties)))
    dealt = dealt.join(deal, "_p").withColumn("_cell", F.size(F.filter("_ends", lambda e: e < F.col("_at")))).drop("_ends", "_p", "_at")
    before = F.element_at(F.lit(offsets.tolist()).cast("array<bigint>"), F.col("_cell") + 1)
    slot = before + F.row_number().over(W.partitionBy("_cell").orderBy(second, *ties)) - 1
    dealt = dealt.withColumn("slot", slot.cast("long")).withColumn("shard", F.floor(F.col("_cell") / k).cast("int")).drop("_cell")
    inner, names = set_apart(docs)
    copy = F.row_number().over(W.partitionBy("_content").orderBy(F.xxhash64(*names.values())))
    numbered = inner.withColumn("_content", F.xxhash64(names[id_column], names[text])).withColumn("_copy", copy.cast("long"))
    return put_back(numbered.join(dealt, ties), names, "shard", "slot")


def size(text: Column) -> Column:
    """UTF-8 bytes plus ROW_BYTES."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
