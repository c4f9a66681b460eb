"""Intermediate results kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is not set, a local session (tests) gets one of its own; a cluster must set it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` computed once, its lineage cut. For small results: Spark removes the files by itself."""
    folder(frame.sparkSession)
    return frame.checkpoint()


def stored_table(frame: DataFrame) -> DataFrame:
    """``frame`` written once as columns. For large results; the files stay until the folder is cleared."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
