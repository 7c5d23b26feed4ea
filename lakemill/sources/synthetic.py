"""Rows made from their number alone, so any partitioning makes the same ones, with the dirt that cleaning is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("NEW", "PAID", "SENT", "DONE", "BACK")


def orders(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Orders with some missing customers, one status code after the other and prices from a hash."""
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100_000))
    return spark.range(n).select(
        F.col("id").alias("order_id"),
        F.when(draw % 20 != 0, draw % 600).alias("customer_id"),
        (F.col("id") % len(STATUSES)).alias("status_code"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("id") % len(STATUSES) + 1).cast("int")).alias("status"),
        (draw / 100).cast("decimal(18,2)").alias("amount"),
    )


def _dirty(good: Column, **bad: int) -> Column:
    """``good`` as text, but for every nth number one of the ``bad`` texts, which are named by underscores."""
    out = None
    for text, n in bad.items():
        case = F.when if out is None else out.when
        out = case(F.col("id") % n == 1, F.lit(text.strip("_").replace("_", " ")))
    return out.otherwise(good.cast("string")) if out is not None else good.cast("string")


def _with_copies(rows: DataFrame, every: int) -> DataFrame:
    """Each ``every``-th row once more, as it is."""
    return rows.unionAll(rows.where(F.col("id") % every == 0)).drop("id")


def customers(spark: SparkSession, n: int) -> DataFrame:
    """Some have no id, city or segment, or a signup date that is none; every 25th row comes twice."""
    number = F.col("id").cast("string")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 700).cast("int"))
    rows = spark.range(n).select("id", _dirty(number, _=60).alias("customer_id"), F.concat(F.lit("Customer "), number).alias("customer_name"), F.concat(F.lit("c"), number, F.when(F.col("id") % 50 != 3, "@mail.example").otherwise(".example")).alias("email"), _dirty(F.concat(F.lit("City "), F.col("id") % 12), _=25).alias("city"), _dirty(F.concat(F.lit("Segment "), F.col("id") % 4), _=33).alias("segment"), _dirty(day, not_a_date=40).alias("signup_date"))
    return _with_copies(rows, 25)


def products(spark: SparkSession, n: int) -> DataFrame:
    """Some have no id, or a price with a sign before it, below zero or of letters; every 12th row comes twice."""
    price = (F.col("id") % 500 + 1).cast("decimal(18,2)")
    rows = spark.range(n).select("id", _dirty(F.col("id"), _=16).alias("product_id"), F.concat(F.lit("Product "), "id").alias("product_name"), _dirty(F.concat(F.lit("Category "), F.col("id") % 9), _=21).alias("category"), F.when(F.col("id") % 7 == 2, F.concat(F.lit("$"), price)).otherwise(_dirty(price, unknown=17)).alias("unit_price"))
    return _with_copies(rows, 12)


def stores(spark: SparkSession, n: int) -> DataFrame:
    rows = spark.range(n).select("id", F.concat(F.lit("S"), "id").alias("store_id"), F.concat(F.lit("Store "), "id").alias("store_name"), F.concat(F.lit("City "), F.col("id") % 12).alias("city"), F.concat(F.lit("Region "), F.col("id") % 5).alias("region"))
    return _with_copies(rows, 6)


def sales(spark: SparkSession, n: int, day: str, n_customers: int, n_products: int, n_stores: int) -> DataFrame:
    """The orders of a day: some 3 to 10 days late, some without a customer, a date or a count; every 33rd twice."""
    late = F.when(F.col("id") % 12 == 5, F.col("id") % 8 + 3).otherwise(F.lit(0)).cast("int")
    on = F.date_sub(F.lit(day).cast("date"), late)
    rows = spark.range(n).select("id", F.concat(F.lit(day), F.lit("/"), "id").alias("order_id"), _dirty(F.col("id") % n_customers, _=64).alias("customer_id"), _dirty(F.col("id") % n_products, _=80).alias("product_id"), F.concat(F.lit("S"), F.col("id") % n_stores).alias("store_id"), _dirty(on, not_a_date=81).alias("order_date"), _dirty(F.col("id") % 5 + 1, two=107).alias("quantity"), _dirty((F.col("id") % 90 + 10).cast("decimal(18,2)"), unknown=83).alias("unit_price"))
    return _with_copies(rows, 33)


def items(spark: SparkSession, n: int, n_orders: int, n_products: int) -> DataFrame:
    """Lines of orders: some of none that is there, some returned, some of no pieces and some discounts over 100."""
    k = F.col("id")
    quantity = F.when(k % 34 == 1, -1).when(k % 40 == 2, 0).otherwise(k % 6 + 1)
    return spark.range(n).select(k.alias("item_id"), F.when(k % 125 == 3, k + n_orders).otherwise(k % n_orders).alias("order_id"), (k % n_products).alias("product_id"), quantity.cast("int").alias("quantity"), (k % 97 + 1).cast("decimal(18,2)").alias("unit_price"), F.when(k % 200 == 4, 150).otherwise(k % 51).cast("int").alias("discount_percent"))


def changes(spark: SparkSession, n: int, day: str, n_customers: int) -> DataFrame:
    """A day's changes of customers: most move to another segment, every tenth is new; some change twice."""
    key = F.when(F.col("id") % 10 == 9, F.col("id") + n_customers).otherwise(F.col("id") * 7 % n_customers)
    return spark.range(n).select(key.cast("string").alias("customer_id"), F.concat(F.lit("Customer "), key).alias("customer_name"), F.concat(F.lit("c"), key, F.lit("@mail.example")).alias("email"), F.concat(F.lit("City "), key % 12).alias("city"), F.concat(F.lit("Segment "), (key + F.col("id")) % 4).alias("segment"), F.lit(day).alias("change_date"), F.col("id").alias("seq"))
