"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the executors' path, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("codeloom", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
