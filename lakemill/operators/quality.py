"""Counters of what cleaning a shop's tables finds, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.functions import cleaning as C
from lakemill.sources.fs import Files


def counters(parents: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, items: DataFrame) -> DataFrame:
    """(name, n): one aggregate a table. ``parents`` (order_id) are the orders that items may belong to."""
    n = lambda name, cond: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    told = [
        orders.agg(n("wrong_format", F.trim("order_date").rlike(r"^\d{2}-\d{2}-\d{4}$")), n("unparseable", C.guess_timestamp(F.col("order_date")).isNull()), n("no_customer", F.col("customer_id").isNull())),
        products.agg(n("renamed", C.title_case(F.col("product_name")) != F.col("product_name"))),
        customers.agg(n("invalid_email", C.invalid_email(F.col("email")))),
        items.join(parents, "order_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans")),
        items.agg(n("bad_discount", ~F.col("discount").between(0, 100)), n("returns", F.col("quantity") < 0), n("no_pieces", F.col("quantity") == 0)),
    ]
    out = None
    for one in told:
        rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns))).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_report(found: DataFrame, path: str) -> None:
    lines = ["DATA QUALITY REPORT", *(f"{r['name']}: {r['n']}" for r in found.collect())]  # one row a counter
    Files(found.sparkSession, path).write(path, "".join(f"{x}\n" for x in lines), overwrite=True)
