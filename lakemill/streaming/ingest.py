"""Files that arrive, ingested exactly once: drain what is there, then stop."""

from __future__ import annotations

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.operators.tables import VersionedTable
from lakemill.sources.files import headers, read_drifting_csv
from lakemill.sources.fs import Files

#: Files of one micro-batch at most; their names are what the driver holds.
FILES = 1000


class SchemaChanged(RuntimeError):
    """Files have columns that the schema log did not know. It does now: the next run goes on from the same files."""


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, file_format: str = "parquet", load_type: str = "incremental", glob: str | None = None, **options: str) -> None:
    """Appends every file of ``source`` not seen before to ``target``; one query and checkpoint for each feed.

    ``schema`` is the declared superset: columns that a file lacks are null. A rerun adds no row.
    """
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(source).withColumns({"source_file": F.col("_metadata.file_path"), "load_type": F.lit(load_type)})
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()


def _arrivals(spark: SparkSession, source: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).options(pathGlobFilter="*.csv", maxFilesPerTrigger=FILES, recursiveFileLookup="true").load(source).select("path")


def ingest_drifting_csv(spark: SparkSession, source: str, target: str, checkpoint: str, columns: list[str]) -> None:
    """CSV files whose headers differ, united by name; a column that is not among ``columns`` ends the run.

    A batch overwrites its own folder, so a batch that runs again after a failure adds nothing twice.
    """

    def land(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # FILES names at most
        if paths:
            rows = read_drifting_csv(spark, paths)
            if new := sorted(set(rows.columns) - set(columns)):
                raise ValueError(f"columns not declared: {new}")
            rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    _arrivals(spark, source).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class SchemaLog:
    """The columns that a feed is known to have, oldest first; each change is a new file."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.files = path.rstrip("/"), Files(spark, path)

    def _names(self) -> list[str]:
        return [n for n in self.files.names(self.path) if n[0] != "."]

    def columns(self) -> list[str]:
        names = self._names()
        return json.loads(self.files.read(f"{self.path}/{names[-1]}")) if names else []

    def extend(self, columns: list[str]) -> None:
        self.files.publish(f"{self.path}/{len(self._names()):06d}.json", json.dumps(self.columns() + columns))


def ingest_feed(spark: SparkSession, source: str, table: VersionedTable, checkpoint: str, log: SchemaLog, clock: str, load_type: str = "incremental") -> None:
    """Appends the CSV files of ``source`` that are new to ``table``, as text with audit columns.

    The first batch tells the feed's columns. Where later files have others, the run ends with ``SchemaChanged``
    after the log has learnt them, and the next run takes the same files up again; the table then gets the columns,
    null in its older rows. A commit names its batch, so one that runs again after a failure adds nothing twice.
    """
    new: list[str] = []

    def land(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # FILES names at most
        name = f"{checkpoint}#{number}"
        if not paths or any(e.get("batch") == name for e in table.entries()):
            return
        by_header, known = headers(spark, paths), log.columns()
        new.extend(c for c in dict.fromkeys(c for h in by_header for c in h) if c not in known)
        if new:
            log.extend(new)
            if known:
                raise SchemaChanged(str(new))
            new.clear()
        rows = read_drifting_csv(spark, paths, by_header)
        rows = rows.withColumns({"ingestion_ts": F.lit(clock).cast("timestamp"), "load_type": F.lit(load_type)})
        table.commit(rows, mode="append", operation="STREAM", evolve=True, batch=name)

    query = _arrivals(spark, source).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if new:
            raise SchemaChanged(f"new columns: {new}") from e
        raise


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
