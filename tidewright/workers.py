"""This package's code for Python workers that don't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python path, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=f"{here.name}-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/{here.name}_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in here.rglob("*.py"):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(target)
    _sent.add(app)
