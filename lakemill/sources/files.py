"""File sources and sinks: typed and all-string CSV, column drift, dialects, Parquet and probes."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.sources.fs import Files


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, infer: bool = False, **options: str) -> DataFrame:
    """A CSV file with a header: by ``schema``, by inference or, without either, as text columns."""
    reader = spark.read.option("header", "true").options(**options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", str(infer).lower()).csv(path)


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Quote ", escape \\, separator , and a header."""
    return read_csv(spark, path, schema, quote='"', escape="\\", sep=",")


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of ``paths``, which are files or folders, by the columns that their first lines name."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        files = Files(spark, path)
        for full, name, size in files.listing(path):
            if size and name[0] not in "._":
                found.setdefault(tuple(next(csv.reader([files.first_line(full)]))), []).append(full)
    return found


def read_drifting_csv(spark: SparkSession, paths: Sequence[str], by_header: Mapping[tuple[str, ...], list[str]] | None = None) -> DataFrame:
    """Files whose columns differ, as text, united by name; one reader over all would shift columns by place.

    Files with one header are read together, so the plan grows with the number of headers only.
    """
    out = None
    for columns, files in (by_header or headers(spark, paths)).items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        one = read_csv(spark, files, schema).select("*", F.col("_metadata.file_path").alias("source_file")) if by_header else read_csv(spark, files, schema)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file")
    return out


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``single`` is for small reports: one task writes one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", "true").csv(path)


def with_audit(df: DataFrame, load_type: str, clock: str) -> DataFrame:
    """Adds the file, a fixed ingestion time and the kind of load."""
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.lit(clock).cast("timestamp").alias("ingestion_ts"), F.lit(load_type).alias("load_type"))


def with_sequence(df: DataFrame) -> DataFrame:
    """Adds ``ingest_seq``, which rises in the order that rows are read in, within a file and from part to part."""
    return df.withColumn("ingest_seq", F.monotonically_increasing_id())


def probe(df: DataFrame) -> DataFrame:
    """Name and size of each file behind a file scan, without reading rows' columns."""
    return df.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size")).distinct()


def copy(spark: SparkSession, source: str, target: str) -> int:
    """Copies a CSV folder and checks that no row is lost."""
    rows = read_csv(spark, source)
    write_csv(rows, target)
    n, m = rows.count(), read_csv(spark, target).count()
    if n != m:
        raise RuntimeError(f"{n} rows read and {m} written")
    return m
