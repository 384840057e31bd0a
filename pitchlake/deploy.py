"""Give this package to a session's Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session (Spark serves the file), so that they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="package-")), os.path.basename(here))
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
        _sent.add(app)
