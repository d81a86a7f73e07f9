"""Gives executors the package's code, so that Python functions run there without an installation."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package, zipped, to the files that Spark sends to executors; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkwright_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sparkwright-"), "sparkwright.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._sparkwright_shipped = True
