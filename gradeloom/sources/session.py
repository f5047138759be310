"""Session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; the rest is left to the cluster.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "gradeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive planning; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory of tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
