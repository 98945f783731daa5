"""The session every entry point uses."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, app: str = "newsgrain") -> SparkSession:
    """UTC, adaptive execution and Arrow on; local with ``cpus`` threads unless a master is already configured."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", os.environ.get("NEWSGRAIN_MEMORY", "8g")).config("spark.ui.enabled", "false")
    return builder.getOrCreate()
