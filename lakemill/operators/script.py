"""Files of numbered SQL statements: split, run one by one, report rows and failures."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Observation, Row, SparkSession
from pyspark.sql import functions as F

from lakemill.sources.fs import Files

HEADING = re.compile(r"^--\s*(\d+)\.\s*(.+)$", re.MULTILINE)


def split(text: str) -> list[tuple[str, str]]:
    """(title, statement) for every ``-- N. title`` heading."""
    marks = list(HEADING.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [(m.group(2).strip(), text[m.end() : end].strip().rstrip(";")) for m, end in zip(marks, ends, strict=True)]


def run(spark: SparkSession, text: str, preview: int = 10) -> list[tuple[str, list[Row], int, str | None]]:
    """(title, first rows, count of all rows, error) of each statement; one that fails does not stop the others.

    Each result is computed whole, every row and column, so a failure on any row is told. Only ``preview`` rows come
    to the driver.
    """
    out = []
    for title, statement in split(text):
        try:
            found, total = spark.sql(statement), Observation()
            rows = found.take(preview)
            found.observe(total, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            out.append((title, rows, total.get["n"], None))
        except PySparkException as e:
            out.append((title, [], 0, type(e).__name__))
    return out


def write(spark: SparkSession, text: str, path: str, preview: int = 10) -> None:
    """Runs a file of statements and writes each title, its columns, first rows and number of rows, or its error."""
    lines = []
    for title, rows, total, error in run(spark, text, preview):
        lines.append(f"== {title}")
        if error:
            lines.append(f"ERROR: {error}")
        else:
            lines += [" | ".join(rows[0].__fields__)] if rows else []
            lines += [" | ".join(map(str, row)) for row in rows]
            lines.append(f"{total} rows in all")
    Files(spark, path).write(path, "".join(f"{x}\n" for x in lines), overwrite=True)
