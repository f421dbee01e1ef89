"""Python workers get this package from the driver, so a session need not have it on every machine's path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    folder = tempfile.TemporaryDirectory()  # the driver serves the file from here until it ends
    shutil.copytree(package, f"{folder.name}/own/{name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder.name}/{name}", "zip", f"{folder.name}/own"))
    _SHIPPED[context.applicationId] = folder
