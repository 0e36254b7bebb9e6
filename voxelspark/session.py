"""Session defaults for jobs and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "voxelspark", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own settings."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Colour expressions are long; above this size the JVM would not compile the fused method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VOXELSPARK_DRIVER_MEMORY", "12g"))
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
