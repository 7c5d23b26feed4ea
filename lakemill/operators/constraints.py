"""Constraints as checks: rows that a table would reject, with the name of the first constraint they break."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(rows: DataFrame, checks: Mapping[str, Column] = {}, unique: Mapping[str, Sequence[str]] = {}, order: Sequence[str] = (), foreign: Mapping[str, tuple[str, DataFrame, str]] = {}) -> DataFrame:  # noqa: B006
    """``rows`` with ``violated``: a constraint's name, or null.

    A check is broken when false, not when null. Of rows with one key the first by ``order`` is accepted; keys with
    a null never clash. A foreign key is (column, parent, parent column); a null refers to nothing and is accepted.
    """
    told: list[Column] = [F.when(~F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]
    drop = []
    for i, (name, keys) in enumerate(unique.items()):
        rows = rows.withColumn(f"__rn{i}", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        told.append(F.when((F.col(f"__rn{i}") > 1) & whole, F.lit(name)))
        drop.append(f"__rn{i}")
    for i, (name, (column, parent, key)) in enumerate(foreign.items()):
        parents = parent.select(F.col(key).alias(f"__k{i}")).distinct().withColumn(f"__p{i}", F.lit(True))
        rows = rows.join(parents, F.col(column) == F.col(f"__k{i}"), "left")
        told.append(F.when(F.col(column).isNotNull() & F.col(f"__p{i}").isNull(), F.lit(name)))
        drop += [f"__k{i}", f"__p{i}"]
    return rows.withColumn("violated", F.coalesce(*told) if told else F.lit(None).cast("string")).drop(*drop)


def split(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not, null counting as not: each row is in exactly one."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)
