"""Where queries register: a DataFrame plan and the statement it is held against, under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder; each attribute reads one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its own name."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or plan.__name__
        QUERIES[key] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return plan

    return add


def money(c: str | Column) -> Column:
    """Exact to the cent, so that sums do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def double(c: Column) -> Column:
    return c.cast("double")


def revenue() -> Column:
    """Price less discount, exact."""
    return money("l_extendedprice") * (F.lit(1).cast("decimal(2,0)") - F.col("l_discount").cast("decimal(4,2)"))


#: The same in SQL.
REVENUE = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
