"""Tables of a session in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder(spark: SparkSession) -> str:
    """A subfolder of spark.checkpoint.dir for this session's tables; it goes when Python ends."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quarry-"))
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/quarry-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files, quiet = path.getFileSystem(sc._jsc.hadoopConfiguration()), contextlib.suppress(Exception)

    def remove() -> None:
        with quiet:  # the JVM may have ended before
            files.delete(path, True)

    atexit.register(remove)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """Where driver and executors share tables: under spark.checkpoint.dir, which a cluster must have set."""
    return _own_folder(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the tables of the session that df reads. Only for tables that nothing, made before or after, will read again."""
    sc, own = df.sparkSession.sparkContext, _own_folder(df.sparkSession)
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if folder.rsplit("/", 1)[0].endswith(own.rsplit("/", 1)[1]):
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
