"""A keyword index that grows: immutable segments under a manifest that is switched as a whole.

An upload becomes a segment of its own (postings, bounds and document counts by term,
ids), written under a name that no other has. Then the next manifest, which lists all segments
with their documents and tokens, is created; that fails if another writer has made it
meanwhile, in which case the upload is held against the new manifest and tried again. Readers take the
newest manifest that is whole and never see half a segment. Counts of documents, tokens
and terms add up across segments, so a search over several equals one over a single build:
weights and the mean length are derived from the sums, and bounds are widened to the
common mean. ``compact`` rewrites the segments as one.

Documents that the index has are left out of an upload, so replays change nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keywords import Index, bounds_of, index, weighed
from .scratch import materialise

FORMAT = 3
TABLES = ("postings", "bounds", "df", "docs")


class Conflict(RuntimeError):
    """Another writer has made this version of the manifest."""


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest whole manifest; None if there is none, or it is of another format."""
    p, files = _files(spark, f"{path}/manifests")
    if not files.exists(p):
        return None
    names = sorted((f.getPath().getName() for f in files.listStatus(p)), reverse=True)
    for name in names:
        stream = files.open(_files(spark, f"{path}/manifests/{name}")[0])
        try:
            found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # is being written
            continue
        except Py4JJavaError as e:  # is being written, and its checksum is not there yet
            if "ChecksumException" not in e.java_exception.getClass().getName():
                raise
            continue
        finally:
            stream.close()
        return found if found.get("format") == FORMAT else None
    return None


def commit(spark: SparkSession, path: str, found: dict) -> None:
    """Creates the manifest of a version, once."""
    p, files = _files(spark, f"{path}/manifests/{found['version']:012d}.json")
    try:
        out = files.create(p, False)
    except Exception as e:
        if files.exists(p):
            raise Conflict(f"version {found['version']}") from e
        raise
    out.write(bytearray(json.dumps(found).encode()))
    out.close()


def _segment(own: Index, path: str) -> dict:
    """Writes an index as a segment, in the order of terms: a search for few terms skips most row groups of a file."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    own.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/postings")
    own.bounds.write.parquet(f"{at}/bounds")
    own.terms.select("term", "df").write.parquet(f"{at}/df")
    own.docs.write.parquet(f"{at}/docs")
    stats = own.stats.first()
    return {"name": name, "n": stats["n"], "tokens": round(stats["n"] * stats["avgdl"])}


def _read(spark: SparkSession, path: str, found: dict, table: str) -> DataFrame:
    return spark.read.parquet(*[f"{path}/segments/{s['name']}/{table}" for s in found["segments"]])


def read_index(spark: SparkSession, path: str) -> Index | None:
    """The index as of now; None if nothing was added or it is of another format. Later uploads don't change it."""
    found = manifest(spark, path)
    if not found or not found["segments"]:
        return None
    postings, bounds, df, docs = (_read(spark, path, found, t) for t in TABLES)
    n, total = (sum(s[c] for s in found["segments"]) for c in ("n", "tokens"))
    stats = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total / n if n else 0.0).alias("avgdl"))
    return Index(postings, bounds, weighed(df.groupBy("term").agg(F.sum("df").alias("df")), stats), stats, docs, found["stems"])


def _first_rows(batch: DataFrame) -> DataFrame:
    """One row of each id; texts of ids that are not repeated stay where they are."""
    twice = materialise(batch.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return batch
    return batch.join(twice, "doc_id", "left_anti").unionByName(batch.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def add_documents(spark: SparkSession, path: str, docs: DataFrame, stems: bool = False) -> int:
    """Adds the documents (doc_id, text) that the index lacks; of an id repeated in the batch one row. Returns the version, 0 for an index that never had any."""
    batch = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    while True:
        found = manifest(spark, path) or {"format": FORMAT, "version": 0, "stems": stems, "segments": []}
        if found["stems"] != stems:
            raise ValueError("the index was built with other stems")
        new = batch.join(_read(spark, path, found, "docs"), "doc_id", "left_anti") if found["segments"] else batch
        new = materialise(_first_rows(new))
        if new.isEmpty():
            return found["version"]
        segment = _segment(index(new, stems), path)
        try:
            commit(spark, path, found | {"version": found["version"] + 1, "segments": [*found["segments"], segment]})
            return found["version"] + 1
        except Conflict:  # some of the batch may be there by now
            _remove(spark, path, segment["name"])


def compact(spark: SparkSession, path: str) -> int:
    """Rewrites all segments as one; those added meanwhile stay beside it. Returns the version."""
    found = manifest(spark, path)
    if not found or len(found["segments"]) < 2:
        return found["version"] if found else 0
    own = read_index(spark, path)
    mean = own.stats.first()["avgdl"]
    segment = _segment(own._replace(bounds=bounds_of(own.postings, mean)), path)
    old = {s["name"] for s in found["segments"]}
    while True:
        now = manifest(spark, path)
        later = [s for s in now["segments"] if s["name"] not in old]
        if len(later) + len(old) != len(now["segments"]):  # compacted by another
            _remove(spark, path, segment["name"])
            return now["version"]
        try:
            commit(spark, path, now | {"version": now["version"] + 1, "segments": [segment, *later]})
            return now["version"] + 1
        except Conflict:
            continue


def _remove(spark: SparkSession, path: str, name: str) -> None:
    p, files = _files(spark, f"{path}/segments/{name}")
    files.delete(p, True)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the segments that the manifest doesn't list, and returns their names. For times without writers, or readers of older versions."""
    found, (p, files) = manifest(spark, path), _files(spark, f"{path}/segments")
    kept = {s["name"] for s in found["segments"]} if found else set()
    gone = [f.getPath().getName() for f in files.listStatus(p) if f.getPath().getName() not in kept] if files.exists(p) else []
    for name in gone:
        _remove(spark, path, name)
    return gone
