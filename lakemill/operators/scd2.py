"""Slowly changing dimensions of type 2, and joins to the version that held on a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions.cleaning import row_hash
from lakemill.operators.dedup import latest

OPEN_END = "9999-12-31"


def _keyed(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    return df.withColumn("hash_value", row_hash(*map(F.col, attributes))).withColumn(f"{key}_sk", row_hash(F.col(key), F.col("effective_start_date")))


def rebuild(changes: DataFrame, key: str, attributes: Sequence[str], date: str, order: Sequence[str], seed: DataFrame | None = None) -> DataFrame:
    """All versions of a dimension from full-row changes, in one shuffle by key.

    The last change of a day counts, by ``order``; a change that alters nothing opens no version. ``seed`` rows
    (key, attributes, date) come before all changes. A version ends the day before the next one starts.
    """
    daily = latest(changes, [key, date], [F.col(c).desc() for c in order])
    rows = daily.select(key, *attributes, F.col(date).alias("effective_start_date"), F.lit(1).alias("__ord"))
    if seed is not None:
        rows = seed.select(key, *attributes, F.col(date).alias("effective_start_date"), F.lit(0).alias("__ord")).unionByName(rows)
    by_key = W.partitionBy(key).orderBy("__ord", "effective_start_date")
    rows = rows.withColumn("hash_value", row_hash(*map(F.col, attributes)))
    rows = rows.withColumn("__before", F.lag("hash_value").over(by_key)).where("__before IS NULL OR __before <> hash_value")
    following = F.lead("effective_start_date").over(by_key)
    rows = rows.withColumn("__next", following)
    rows = rows.withColumns({"effective_end_date": F.coalesce(F.date_sub("__next", 1), F.lit(OPEN_END).cast("date")), "is_current": F.col("__next").isNull(), f"{key}_sk": row_hash(F.col(key), F.col("effective_start_date"))})
    return rows.select(f"{key}_sk", key, *attributes, "effective_start_date", "effective_end_date", "is_current", "hash_value")


def apply_day(dimension: DataFrame, changes: DataFrame, key: str, attributes: Sequence[str], date: str, order: Sequence[str]) -> DataFrame:
    """The dimension after one day's changes: changed current versions are closed and new ones opened."""
    daily = latest(changes, [key, date], [F.col(c).desc() for c in order])
    new = _keyed(daily.select(key, *attributes, F.col(date).alias("effective_start_date")), key, attributes)
    current = dimension.where("is_current").select(key, "hash_value")
    opened = new.join(current, [key, "hash_value"], "left_anti")
    closing = opened.select(F.col(key).alias("__key"), F.date_sub("effective_start_date", 1).alias("__end"))
    closed = dimension.join(closing, (F.col(key) == F.col("__key")) & F.col("is_current"), "left")
    hit = F.col("__key").isNotNull()
    closed = closed.withColumns({"effective_end_date": F.when(hit, F.col("__end")).otherwise(F.col("effective_end_date")), "is_current": F.col("is_current") & ~hit}).drop("__key", "__end")
    opened = opened.withColumns({"effective_end_date": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True)})
    return closed.unionByName(opened)


def as_of(facts: DataFrame, dimension: DataFrame, key: str, day: str, attributes: Sequence[str]) -> DataFrame:
    """``facts`` with the key and attributes of the version that held on ``day``; nulls where none did.

    An equi-join on the key with the interval as a residual condition: versions of a key do not overlap, so no fact
    is doubled.
    """
    dim = dimension.select(F.col(key).alias("__key"), f"{key}_sk", *attributes, "effective_start_date", "effective_end_date")
    held = (F.col(key) == F.col("__key")) & F.col(day).between(F.col("effective_start_date"), F.col("effective_end_date"))
    return facts.join(dim, held, "left").drop("__key", "effective_start_date", "effective_end_date")


def as_of_strict(facts: DataFrame, dimension: DataFrame, key: str, day: str, attributes: Sequence[str]) -> DataFrame:
    """``as_of`` without the facts whose key has versions, but none that held on ``day``."""
    known = dimension.select(F.col(key).alias("__known")).distinct()
    held = as_of(facts, dimension, key, day, attributes).join(known, F.col(key) == F.col("__known"), "left")
    return held.where(F.col(f"{key}_sk").isNotNull() | F.col("__known").isNull()).drop("__known")


def with_fallback(facts: DataFrame, dimension: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Facts that no version held for take the key's earliest one, and say so in ``{key}_is_estimated``.

    Of two that start on one day the earliest is the one that ended first: a seed that a change replaced on its own day.
    """
    cols = [f"{key}_sk", *attributes]
    first = dimension.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*cols), F.struct("effective_start_date", "effective_end_date")).alias("__first"))
    joined = facts.join(first, F.col(key) == F.col("__key"), "left")
    estimated = F.col(f"{key}_sk").isNull() & F.col("__first").isNotNull()
    filled = {c: F.coalesce(F.col(c), F.col(f"__first.{c}")) for c in cols}
    return joined.withColumn(f"{key}_is_estimated", estimated).withColumns(filled).drop("__key", "__first")
