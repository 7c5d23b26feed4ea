"""Period reports against the period of equal length before, and data-quality counters."""

from __future__ import annotations

import argparse
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.cleaning import percent_change
from lakemill.sources.fs import Files


def previous_period(first: date, last: date) -> tuple[date, date]:
    """The days of equal number that end on the day before ``first``."""
    end = first - timedelta(days=1)
    return end - (last - first), end


def _within(first: date, last: date) -> Column:
    """From the start of the first day to the end of the last, as a range that files are pruned by."""
    return (F.col("o_orderdate") >= F.lit(str(first)).cast("timestamp")) & (F.col("o_orderdate") < F.lit(str(last + timedelta(days=1))).cast("timestamp"))


def _period(first: str, last: str) -> tuple[date, date]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    if b < a:
        raise ValueError("the period ends before it starts")
    return a, b


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


def period_comparison(orders: DataFrame, first: str, last: str, lines: DataFrame | None = None) -> DataFrame:
    """Orders, customers and revenue of a period and the one before, and the changes; both periods in one scan.

    Revenue is that of ``lines``, or of the orders' totals without them. Lines are summed by order before they meet it.
    """
    a, b = _period(first, last)
    c, d = previous_period(a, b)
    inside = orders.where(_within(c, b))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    if lines is not None:
        sold = lines.groupBy("l_orderkey").agg(F.sum(_price()).alias("sold"))
        inside, price = inside.join(sold, F.col("o_orderkey") == F.col("l_orderkey"), "left"), F.col("sold")
    now, before = _within(a, b), _within(c, d)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, price)), F.lit(0)).cast("double")
    count = lambda cond, key: F.countDistinct(F.when(cond, F.col(key)))
    sums = inside.agg(
        count(now, "o_orderkey").alias("orders"), count(now, "o_custkey").alias("customers"), total(now).alias("revenue"),
        count(before, "o_orderkey").alias("orders_before"), count(before, "o_custkey").alias("customers_before"), total(before).alias("revenue_before"),
    )
    return sums.withColumn("change", percent_change(F.col("revenue"), F.col("revenue_before")))


def top_products(lineitem: DataFrame, orders: DataFrame, first: str, last: str, k: int = 3) -> DataFrame:
    inside = orders.where(_within(*_period(first, last)))
    sold = lineitem.join(inside, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_partkey").agg(F.sum(_price()).cast("double").alias("revenue"))
    return sold.orderBy(F.desc("revenue"), "l_partkey").limit(k)


def report_lines(spark: SparkSession, sf_dir: str, kind: str, first: str, last: str) -> list[str]:
    """A printable report; ``kind`` is a label, the dates alone decide what is counted."""
    orders, items, parts = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "part"))
    x = period_comparison(orders, first, last, items).first()
    a, b = previous_period(*_period(first, last))

    def change(name: str) -> str:
        now, before = x[name], x[f"{name}_before"]
        return f"{before:,} -> {now:,} ({f'{round((now - before) / before * 100, 2):+}%' if before else 'n/a'})"

    best = top_products(items, orders, first, last).join(parts, F.col("l_partkey") == F.col("p_partkey")).orderBy(F.desc("revenue"), "l_partkey").collect()  # three rows
    told = [f"  {i}. {r['p_name']} (no. {r['l_partkey']}): {r['revenue']:,.2f}" for i, r in enumerate(best, 1)] or ["  none"]
    return [f"{kind.upper()} REPORT {first} to {last}", f"Orders: {x['orders']:,}", f"Customers: {x['customers']:,}", f"Revenue: {x['revenue']:,.2f}", "Top products:", *told, f"Against {a} to {b}:", *(f"  {n.capitalize()}: {change(n)}" for n in ("orders", "revenue", "customers"))]


def report_text(spark: SparkSession, sf_dir: str, kind: str, first: str, last: str) -> str:
    return "\n".join(report_lines(spark, sf_dir, kind, first, last))


def main(argv: list[str] | None = None) -> int:
    from lakemill.session import session

    parser = argparse.ArgumentParser(description="Sales of a period against the one before")
    parser.add_argument("sf_dir")
    parser.add_argument("first", type=date.fromisoformat)
    parser.add_argument("last", type=date.fromisoformat)
    parser.add_argument("--out", help="a file to write the report to, on any file system")
    parser.add_argument("--type", choices=["daily", "weekly", "monthly"], default="monthly")
    args = parser.parse_args(argv)
    spark = session("report")
    text = report_text(spark, args.sf_dir, args.type, str(args.first), str(args.last))
    if args.out:
        Files(spark, args.out).write(args.out, f"{text}\n", overwrite=True)
    print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
