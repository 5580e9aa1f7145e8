"""A session with the settings the engine is meant to run under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(name: str = "lexispark", **conf: str) -> SparkSession:
    """Settings given by the cluster stay; only what is unset is filled in."""
    cpus = os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.appName(name)
    if "SPARK_REMOTE" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    return builder.config(map=defaults | conf).getOrCreate()
