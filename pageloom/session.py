"""Sessions with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pageloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings are taken as they come."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
