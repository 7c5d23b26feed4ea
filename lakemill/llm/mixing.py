"""Mixing of sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm import common

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Rows of one source and size class that one window task orders, about.
CELL_ROWS = 500
#: Cells whose counts are summed up together before sums of sums are.
BRANCH = 1024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Monotone in ``size``: the number of digits, then the first three of them."""
    digits = size.cast("string")
    return F.length(digits) * 1000 + F.substring(digits, 1, 3).cast("int")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size): all sizes shared by weight, none above ``max_copies`` times its own.

    Weights go round by the order of source names. With the sources in ascending order of cap over weight, the level
    that the rest would get after capping all before rises up to the last capped one and falls after it, so the
    final level is the largest. The windows see one row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    every = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - capped).cast("double") / left.cast("double")
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    share = F.col("level") * F.col("weight")
    return ranked.select("source", "source_size", F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _ahead(counts: DataFrame, within: list[str], order: str) -> DataFrame:
    """``counts`` with ``ahead``: the sum of ``n`` over the rows before within the same columns."""
    before = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def copies(sized: DataFrame, seed: int = 0, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds source_size, target and copies to ``sized`` (doc_id, source, size and any columns of the caller's).

    A document's expected copies are its source's target over its source's size. They are prefix-summed within the
    source in the order of size class and a hash of doc_id, one offset drawn for the source is added, and a document
    is emitted once for each integer that its step crosses: a systematic sample, stratified by size.

    The prefix sum is split: a source is cut into size classes, of which there are some thousands at most, and each
    class by the hash into cells of about ``cell_rows``; rows are numbered within cells, and counts of cells, of
    BRANCH cells and of classes are summed up before them. So no task holds a source or a class, however large.
    """
    class_key, cell = ["name", "unnamed", "size_class"], ["name", "unnamed", "size_class", "salt"]
    sized = sized.withColumns({"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull(), "size_class": size_class(F.col("size"))})
    classes = common.cut(sized.groupBy(*class_key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "classes")
    sources = classes.groupBy("name", "unnamed").agg(F.sum("words").alias("source_size"))
    sources = targets(sources.withColumn("source", F.when(~F.col("unnamed"), F.col("name"))), weights, max_copies)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    sources = sources.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "target", offset.alias("offset"))
    told = _ahead(classes, ["name", "unnamed"], "size_class").join(sources, ["name", "unnamed"])
    told = common.cut(told.select(*class_key, F.col("n").alias("class_rows"), F.col("ahead").alias("class_ahead"), "source_size", "target", "offset"), "told")
    placed = common.hot_join(sized, told, class_key, "class_rows", "doc_id", "size")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    salt = F.floor(F.conv(F.substring("order_key", 1, 10), 16, 10).cast("double") / (1 << 40) * F.ceil(F.col("class_rows") / cell_rows))
    placed = placed.withColumn("order_key", key).withColumn("salt", salt)
    cells = common.cut(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("branch", F.floor(F.col("salt") / BRANCH)), "cells")
    branches = _ahead(cells.groupBy(*class_key, "branch").agg(F.sum("n").alias("n")), class_key, "branch").select(*class_key, "branch", F.col("ahead").alias("branch_ahead"))
    cells = _ahead(cells, [*class_key, "branch"], "salt").join(branches, [*class_key, "branch"]).select(*cell, (F.col("ahead") + F.col("branch_ahead")).alias("ahead"))
    numbered = placed.withColumn("at", F.row_number().over(W.partitionBy(*cell).orderBy("order_key", "size", "doc_id")))
    placed = numbered.join(cells, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    at = (F.col("class_ahead") + F.col("ahead") + F.col("at")).cast("double")
    crossed = F.floor(at * rate + F.col("offset")) - F.floor((at - 1) * rate + F.col("offset"))
    placed = placed.withColumn("copies", F.least(crossed, F.lit(max_copies)).cast("long"))
    return placed.drop(*cell, "order_key", "at", "ahead", "offset", "class_rows", "class_ahead")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """The documents without their texts, each with its number of words, as a table in the shared folder."""
    return common.cut(docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sized")


@common.tidy
def sample_counts(docs: DataFrame, seed: int = 0, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each document: size, its source's size and target, and how often the mix takes it.

    Defined results: a null text has size 0; null sources are one source, named last; a source without words has
    target 0 and its documents are not taken; ties in the order are broken by size and doc_id, and rows that agree
    in these are interchangeable; an empty table gives no rows; other columns are ignored.
    """
    rows = sized(docs)
    return copies(rows, seed, weights, max_copies, cell_rows)


@common.tidy
def mix(docs: DataFrame, seed: int = 0, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the sample takes it.

    Defined results are those of ``sample_counts``: null and empty texts are not taken unless their class's turn
    comes, repeated rows each count, an empty table gives no rows, and all columns stay, whatever their names.
    """
    rows = common.cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix", compression="zstd")
    counted = sized(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), "row")
    taken = copies(counted, seed, weights, max_copies).where("copies > 0").select("row", "copies")
    return rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sample_counts(common.table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= top * weight THEN CAST(cap AS DOUBLE) ELSE top * weight END AS target,
    CAST(CAST('0x' || substr(md5('0|' || coalesce(source, '')), 1, 4) AS BIGINT) AS DOUBLE) / 65536 AS off
  FROM (SELECT *, max(level) OVER () AS top FROM levels)),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.off,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(row_number() OVER (PARTITION BY s.source ORDER BY
      length(CAST(size AS VARCHAR)) * 1000 + CAST(substr(CAST(size AS VARCHAR), 1, 3) AS INTEGER),
      md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size, s.doc_id NULLS FIRST) AS DOUBLE) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(floor(place * rate + off) - floor((place - 1) * rate + off), 3) AS BIGINT) AS taken
FROM placed
"""
