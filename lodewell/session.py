"""A SparkSession with the settings the plans here are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", app: str = "lodewell", **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; `conf` overrides any of it.

    Shuffle partitions are left to the cluster's own setting: adaptive execution merges
    small ones but never makes more, so a low number here would bind at any size.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
