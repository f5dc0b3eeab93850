"""What operators that join blocks of rows share: groups of sorted partitions, matrices, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of equal keys, of a partition that is sorted by them; one group is held at a time, and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            own = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= own[1:] != own[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != own[0]
        start = 0
        for cut in np.flatnonzero(new).tolist():
            held += [batch.slice(start, cut - start)] if cut > start else []
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by a key, in tables that cut no run of equal keys; a batch is held, and the run that it may break off."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(key).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(own[1:] != own[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held, batch = [], batch.slice(changes[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def first_rows(score: np.ndarray, rank: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(questions, rows) of each question's first ``top``, by descending score and ascending rank of the id. A score of minus infinity is none."""
    n = score.shape[1]
    if n > top:
        edge = np.partition(score, n - top, axis=1)[:, n - top]
        q, r = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
    else:
        q, r = np.nonzero(score > -np.inf)
    order = np.lexsort((rank[r], -score[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return q[place < top], r[place < top]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def few(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def large(df: DataFrame) -> DataFrame:
    """df marked for a join by sorting. Spark takes a table for as large as its compressed files, which may be a small part of its rows in memory, and would broadcast it."""
    return df.hint("merge")


def number(rows: DataFrame, column: str) -> DataFrame:
    """rows with n, counting from 0 in the order of a column of different values of any ordered type; nulls first.

    Spark samples the column for the bounds of its ranges, so neither outliers nor wide, text or
    hashed ids crowd one. Rows are numbered inside their range, ranges by their counts: one
    row a range meets in a window, never the rows themselves.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the partition
    placed = materialise(rows.repartitionByRange(parts, column).sortWithinPartitions(column).withColumns({"_range": F.spark_partition_id(), "_k": own}))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_in"))
    counts = counts.select("_range", (F.sum("_in").over(W.partitionBy(F.lit(1)).orderBy("_range")) - F.col("_in")).alias("_before"))
    return placed.join(F.broadcast(counts), "_range").withColumn("n", F.col("_before") + F.col("_k")).drop("_range", "_k", "_before")
