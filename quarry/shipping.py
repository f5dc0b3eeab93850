"""The package on the executors, where it isn't installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: Python workers find it whatever their working folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="quarry-")  # the driver serves the file from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = shutil.copytree(here, f"{folder}/all/{os.path.basename(here)}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{folder}/quarry-package", "zip", os.path.dirname(copy)))
        _shipped.add(sc.applicationId)
