"""Gives executors this package, which on a cluster lies on the driver alone."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python path, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(_ROOT)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_ROOT)))
    path = os.path.join(tempfile.mkdtemp(), "lociframe.zip")
    with open(path, "wb") as f:
        f.write(content.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
