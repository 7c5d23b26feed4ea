"""The Spark session that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lakemill", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI mode stays on, times are UTC and plans adapt at run time; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
