"""Session defaults: UTC, AQE, ANSI."""

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return builder.config(map=settings | conf).getOrCreate()
