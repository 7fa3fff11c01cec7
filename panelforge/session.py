"""Session settings that the operators expect: UTC, ANSI, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("panelforge")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
