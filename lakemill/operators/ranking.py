"""Places, ranks and running sums over all rows, in one task where they are few and in many where they are not."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.operators.workspace import settled

#: Rows that one task orders at most, about.
ONE_TASK = 1_000_000


def ordered(df: DataFrame, value: str, ties: Sequence[str] = (), sums: Mapping[str, str] = {}, most: int = ONE_TASK) -> DataFrame:  # noqa: B006
    """``df`` from the highest ``value`` to the lowest, nulls last, then by ``ties``.

    Adds place (from 1), rank (as SQL has it), rows and, for each of ``sums`` (a name and its column), the sum so far
    as running_<name> and of all rows as total_<name>. Rows are cut into ranges of ``value`` of about ``most`` rows;
    a range's counts and sums are added up over those before it, one row a range, and only a range is ordered in one
    task. Equal values are in one range.
    """
    rows = settled(df, "ordered")
    ranges = max(1, math.ceil(rows.count() / most))
    lows = rows.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    lows = sorted({x for x in lows or [] if x is not None})
    above = F.size(F.filter(F.array(*map(F.lit, lows)), lambda low: low > F.col(value))) if lows else F.lit(0)
    rows = rows.withColumn("__range", F.when(F.col(value).isNull(), F.lit(len(lows))).otherwise(above))
    parts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__sum_{name}") for name, c in sums.items()))
    every, before = W.partitionBy(), W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    told = {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "rows": F.sum("__n").over(every)}
    for name in sums:
        told |= {f"__before_{name}": F.sum(f"__sum_{name}").over(before), f"total_{name}": F.sum(f"__sum_{name}").over(every)}
    parts = parts.select("__range", *(c.alias(name) for name, c in told.items()))  # one row a range
    by_value = W.partitionBy("__range").orderBy(F.col(value).desc_nulls_last())
    by_place = W.partitionBy("__range").orderBy(F.col(value).desc_nulls_last(), *ties)
    so_far = by_place.rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumns({"place": F.row_number().over(by_place), "rank": F.rank().over(by_value), **{f"running_{name}": F.sum(c).over(so_far) for name, c in sums.items()}})
    found = found.join(F.broadcast(parts), "__range")
    found = found.withColumns({"place": F.col("place") + F.col("__before"), "rank": F.col("rank") + F.col("__before")})
    for name in sums:
        found = found.withColumn(f"running_{name}", F.when(F.col(f"__before_{name}").isNull(), F.col(f"running_{name}")).otherwise(F.coalesce(F.col(f"running_{name}"), F.lit(0)) + F.col(f"__before_{name}")))
    return found.drop("__range", "__before", *(f"__before_{name}" for name in sums))


def tile(k: int) -> Column:
    """Which of ``k`` tiles of all but equal size a row of ``ordered`` is in; the first ones have a row more."""
    size, longer = F.floor(F.col("rows") / k), F.col("rows") % k
    inside = F.col("place") - 1 - longer
    return F.when(F.col("place") <= longer * (size + 1), F.ceil(F.col("place") / (size + 1))).otherwise(F.floor(inside / F.greatest(size, F.lit(1))) + 1).cast("int")
