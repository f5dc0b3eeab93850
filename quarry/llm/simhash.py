"""SimHash near-dedup with deletion-variant signatures.

A text's fingerprint has 64 bits, each set if it is set in over half of its 3-word
shingles' hashes. Fingerprints of at most 3 differing bits link. Cut into two
segments of 32 bits, one segment of a linked pair differs by at most one bit; so
each distinct fingerprint is indexed under its two segments and under the 64
variants that leave out one bit of one segment. Equal keys meet in sorted
partitions, where links are verified on all 64 bits and thinned to a spanning
forest (dense groups emit no pairs; a key of many fingerprints is cut once more by equal
bytes of the other segment, which loses no link); components follow by contraction.

Exact copies collapse before the index. Nulls: a null text has no words, as an empty
one; texts without words have fingerprint zero, which links like any other. A null
doc_id is never a component's id unless all its documents have null. Empty tables
give empty results; repeated rows are all returned. Further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, forest, materialise, put_back, runs, set_apart

WORDS = 3
SEED = 42
DISTANCE = 3


def fingerprint(text: bytes) -> int:
    """Of lower-cased (A-Z) words; as a signed 64-bit integer."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < WORDS:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(w, w[1:], w[2:]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, SEED) for x in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").cast(pa.binary())
        found = pa.array((fingerprint(x.as_py() or b"") for x in texts), pa.int64(), size=batch.num_rows)
        keep = [k for k, name in enumerate(batch.schema.names) if name != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], [*(batch.schema.names[k] for k in keep), "fp"])


def with_fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns and fp, a signed 64-bit integer."""
    chosen = docs.select(*columns, F.col(text).alias("_text"))
    schema = chosen.drop("_text").schema.add("fp", "long")
    return chosen.mapInArrow(_fingerprints, schema)


def _index(fps: DataFrame) -> DataFrame:
    """(key, fp): the key holds segment number, position left out (32: none) and the segment without that bit."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("s"), low.alias("v")), F.struct(F.lit(1).cast("long").alias("s"), high.alias("v"))))
    x = fps.select("fp", segments.alias("seg")).select("fp", "seg.s", "seg.v", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("i"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    value = F.when(F.col("i") < 32, F.col("v").bitwiseAND(F.bitwise_not(bit))).otherwise(F.col("v"))
    key = F.shiftleft(F.col("s") * 64 + F.col("i"), 32).bitwiseOR(value)
    return x.select(key.alias("key"), "fp")


def _parts(fps: np.ndarray, high: bool, few: int = 256) -> Iterator[np.ndarray]:
    """Groups of a key's fingerprints in which every link lies in one at least.

    Few are one group. Of many, the segment that isn't shared is cut into four bytes:
    of two that differ in three bits at most, one byte is equal.
    """
    if len(fps) <= few:
        yield fps
        return
    for k in range(4):
        byte = (fps >> np.uint64(8 * k + 32 * high)) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for group in np.split(fps[order], np.flatnonzero(np.diff(byte[order])) + 1):
            if len(group) > 1:
                yield group


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in runs(batches, "key"):
        fps, keys = table.column("fp").to_numpy().view(np.uint64), table.column("key").to_numpy()
        a: list[int] = []
        b: list[int] = []
        for k in np.flatnonzero(np.diff(starts) > 1):
            f = fps[starts[k] : starts[k + 1]]
            high = int(keys[starts[k]]) >> 38 == 0  # the low segment is shared, so the others differ in the high one
            for part in _parts(f, high):
                for i, j in forest(len(part), lambda i, others, f=part: np.bitwise_count(f[others] ^ f[i]) <= DISTANCE):
                    a.append(int(part[i]))
                    b.append(int(part[j]))
        if a:
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (fp) as the links of all pairs do."""
    index = _index(fps)
    meeting = index.repartition("key").sortWithinPartitions("key")
    return meeting.mapInArrow(_meet, "a long, b long").distinct()


def _rooted(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of marked (doc_id, fp); root is the smallest fingerprint of its component."""
    own = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(own.select("fp")))
    joined = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(lowest, "root").select("fp", "root", "component_id")


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint of marked (doc_id, fp); component_id is the smallest doc_id that links reach."""
    return _rooted(marked).select("fp", "component_id")


def near_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each document."""
    marked = materialise(with_fingerprints(docs.select(F.col(id_column).alias("doc_id"), text), text=text))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(materialise(classes(marked)), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays, of rows that share that id one.

    Documents without an id stay only where their whole component has none, one of each. Texts are read again rather
    than shuffled: the ids that go are written first, so Spark knows their size when
    it chooses the join; only rows that share an id are sorted out in windows.
    """
    marked = materialise(with_fingerprints(docs.select(F.col(id_column).alias("doc_id"), text), text=text))
    rooted = materialise(_rooted(marked))
    classed = marked.join(rooted, "fp")
    gone = materialise(classed.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    shared = materialise(marked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_shared")))
    inner, names = set_apart(docs)
    own, words = names[id_column], names[text]
    kept = inner.join(gone, F.col(own) == F.col("_gone"), "left_anti")
    if not marked.where("doc_id IS NULL").isEmpty():
        without = inner.where(F.col(own).isNull()).select(F.struct(*inner.columns).alias("_doc"), F.col(words).alias("_t"))
        alone = with_fingerprints(without, ("_doc",), "_t").join(rooted.where("component_id IS NULL"), "fp")
        single = alone.groupBy("root").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc")).select("_doc.*")
        kept = kept.where(F.col(own).isNotNull()).unionByName(single)
    if shared.isEmpty():
        return put_back(kept, names)
    same = F.col(own) == F.col("_shared")
    order = W.partitionBy(own).orderBy(F.xxhash64(*inner.columns), words)
    one = kept.join(shared, same, "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return put_back(kept.join(shared, same, "left_anti").unionByName(one), names)
