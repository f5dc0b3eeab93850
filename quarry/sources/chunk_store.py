"""A chunk store that a batch is held against without reading all of it.

Rows lie in files by BUCKETS of their id's hash, at most ROWS a file. Beside each upload
lie blocked Bloom filters of its files: an id has a piece of 32,768 bits in its file's filter
and HASHES bits in that piece. A batch meets the filters of its ids' buckets in an
equi-join, and only files whose filter holds some id are read to see which are really there. A
filter never misses an id that its file has, so an id is never stored twice by replays; a false
hit costs reading a file.

An upload is there once its filters are complete: readers take the uploads that say so, so a failed
one shows nothing. Rows are never changed. Of an id repeated in a batch one row is stored; rows without an id
are left out. Two writers at once may both store an id that neither saw: keep one writer a store.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import insert_if_absent
from .scratch import materialise

BUCKETS, ROWS = 64, 200_000
#: Bits an id, in pieces of BITS; HASHES of them are set: about 1 % of other ids hit.
PER_ID, BITS, HASHES = 12, 32768, 5


class Added(NamedTuple):
    inserted: int
    files_read: int
    files: int


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _piece(key: Column, pieces: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("piece")), pieces).cast("int")


def _places(key: Column) -> Column:
    """The bits of an id in its piece."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BITS)) for k in range(HASHES)])


def _is_set(marks: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(marks, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def _uploads(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/filters")
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p):
        return []
    done = lambda f: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return sorted(f.getPath().getName() for f in files.listStatus(p) if done(f))


def _rows(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Rows of files, or of folders, under data."""
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in files]).drop("_upload", "_bucket")


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows stored; None if there are none."""
    names = _uploads(spark, path)
    return _rows(spark, path, [f"_upload={n}" for n in names]) if names else None


def _write(spark: SparkSession, path: str, rows: DataFrame, key: str, most: int) -> None:
    name = f"u{uuid.uuid4().hex}"
    at = f"{path}/data/_upload={name}"
    rows.withColumn("_bucket", _bucket(F.col(key))).repartition("_bucket").write.option("maxRecordsPerFile", most).partitionBy("_bucket").parquet(at)
    own = spark.read.parquet(at).select(F.col("_bucket").alias("bucket"), F.col(key).alias("key"), F.regexp_extract(F.input_file_name(), "/data/(.*)$", 1).alias("file"))
    sizes = own.groupBy("file").agg(F.ceil(F.count("*") * PER_ID / F.lit(float(BITS))).cast("int").alias("pieces"))
    placed = own.join(sizes, "file").select("bucket", "file", "pieces", _piece(F.col("key"), F.col("pieces")).alias("piece"), F.explode(_places(F.col("key"))).alias("place"))
    placed.groupBy("bucket", "file", "pieces", "piece").agg(F.bitmap_construct_agg("place").alias("marks")).write.parquet(f"{path}/filters/{name}")


def files_for(spark: SparkSession, path: str, batch: DataFrame, key: str = "chunk_id") -> tuple[list[str], int]:
    """(files that may hold ids of the batch, number of files): names only, of which a store has one for ROWS chunks or so."""
    names = _uploads(spark, path)
    if not names:
        return [], 0
    filters = spark.read.parquet(*[f"{path}/filters/{n}" for n in names])
    files = filters.select("bucket", "file", "pieces").distinct()
    ids = batch.select(F.col(key).alias("key"), _bucket(F.col(key)).alias("bucket"))
    asked = ids.join(files, "bucket").select("file", "key", _piece(F.col("key"), F.col("pieces")).alias("piece"))
    met = asked.join(filters.select("file", "piece", "marks"), ["file", "piece"])
    every = F.forall(_places(F.col("key")), lambda p: _is_set(F.col("marks"), p))
    return sorted(r["file"] for r in met.where(every).select("file").distinct().collect()), files.count()


def add_chunks(spark: SparkSession, path: str, batch: DataFrame, key: str = "chunk_id", most: int = ROWS) -> Added:
    """Stores the rows of batch whose id isn't there yet; says how many, and how many of the store's files were read for it."""
    new = materialise(batch.where(F.col(key).isNotNull()).dropDuplicates([key]))
    held, files = files_for(spark, path, new, key)
    if held:
        new = materialise(insert_if_absent(_rows(spark, path, held), new, key))
    n = new.count()
    if n:
        _write(spark, path, new, key, most)
    return Added(n, len(held), files)
