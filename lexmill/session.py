"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a context, send this package's modules to the executors' Python workers."""
    context = spark.sparkContext
    if getattr(context, "_lexmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexmill_zip_"), "lexmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexmill", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._lexmill_shipped = True
