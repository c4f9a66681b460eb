"""Session settings shared by the tests, the bench and ad-hoc use.

Library code never builds a session: it works on the one that owns the input DataFrames.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators are written for. Everything else (executors, memory, shuffle
# partitions) belongs to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
