"""Send this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let workers import the package wherever the driver was started; once per application.

    The archive lies in the driver's own temporary folder only until Spark's file
    server hands it to the executors, also to those that join later.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or not PACKAGE.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
