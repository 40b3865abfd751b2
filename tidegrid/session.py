"""Session settings the engine is tuned for; every operator also works on a session built elsewhere."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "tidegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and a UTC session time zone.

    ``conf`` keys are written with ``__`` for ``.``: ``spark__sql__shuffle__partitions="64"``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
