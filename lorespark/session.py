"""Session settings for a cluster; tests and the bench pass their own master."""

from pyspark.sql import SparkSession


def session(app: str = "lorespark", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and last-wins maps; settings override."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
