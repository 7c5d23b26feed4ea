"""Where tables that a query writes go: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only a local master, as in tests, gets a local folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not getattr(spark, "_lakemill_workspace", None):
            spark._lakemill_workspace = tempfile.mkdtemp(prefix="lakemill-")
        named = spark._lakemill_workspace
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new path and read again: computed once, however often and by whomever it is read."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
