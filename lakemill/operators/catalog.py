"""Databases and their tables in the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators.workspace import workspace


def create_database(spark: SparkSession, prefix: str) -> str:
    """A new database with its files in the shared folder; gives its name."""
    path = workspace(spark, prefix)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{path}'")
    return name


def create_table_as(spark: SparkSession, table: str, select: str, **frames: DataFrame) -> DataFrame:
    """CREATE TABLE AS the rows of a SELECT over ``frames``; gives the table as its name reads."""
    spark.sql(f"CREATE TABLE {table} USING parquet AS {select}", **frames)
    return spark.table(table)


def columns(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, column_name, data_type, place) of all tables of a database."""
    found = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables(database) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1)]
    return spark.createDataFrame(found, "table_name string, column_name string, data_type string, place int").select("table_name", "column_name", "data_type", F.col("place"))
