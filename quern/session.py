"""Session factory with the settings every quern query is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str = "local[8]", app: str = "quern", **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
