"""A local session for tests and benchmarks; clusters bring their own."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(name: str, cpus: str = "8") -> SparkSession:
    """Checkpoint and local folders stay as the environment sets them."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
