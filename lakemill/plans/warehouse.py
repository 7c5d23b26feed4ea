"""The retail warehouse in full: raw text feeds, clean and quarantined rows, dimensions with history, facts and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions import cleaning as C
from lakemill.operators import scd2
from lakemill.operators.constraints import split
from lakemill.operators.dedup import latest
from lakemill.operators.tables import VersionedTable
from lakemill.operators.workspace import settled, workspace
from lakemill.plans.registry import Tables, double, query

#: Start of dimension rows that have no date of their own.
FIRST_DAY = "2020-01-01"
LATER = 1_000_000_000_000

# --- raw feeds: text columns with dirt, made from the driver's tables -----------------------------------------------


def _cases(key: Column, n: int, good: Column, **bad: str | None) -> Column:
    """``good``, but a text of ``bad`` (k1=..., k2=...) where ``key`` modulo n is that number."""
    out = None
    for name, text in bad.items():
        condition = key % n == int(name[1:])
        value = F.lit(text).cast("string")
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(good.cast("string"))


def raw_customers(t: Tables) -> DataFrame:
    """Some customers come again later, in another segment."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    rows = t.customer.select(_cases(k, 29, k, k7="").alias("customer_id"), F.col("c_name").alias("customer_name"), F.concat(F.lit("c"), k, F.lit("@mail.example")).alias("email"), _cases(k, 25, F.concat(F.lit("City"), "c_nationkey"), k3="", k4=None).alias("city"), _cases(k, 33, F.col("c_mktsegment"), k5="").alias("segment"), _cases(k, 31, day, k1="0000-00-00", k2="31/02/2025", k3="not_a_date", k4="").alias("signup_date"), k.alias("ingest_seq"))
    again = rows.where("ingest_seq % 17 = 6").withColumns({"segment": F.lit("UPDATED"), "ingest_seq": F.col("ingest_seq") + LATER})
    return rows.unionByName(again)


RAW_CUSTOMERS = f"""raw_customers AS (
  SELECT CASE WHEN c_custkey % 29 = 7 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS customer_id, c_name AS customer_name, 'c' || c_custkey || '@mail.example' AS email,
    CASE c_custkey % 25 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'City' || c_nationkey END AS city, CASE WHEN c_custkey % 33 = 5 THEN '' WHEN s.later = 1 THEN 'UPDATED' ELSE c_mktsegment END AS segment,
    CASE c_custkey % 31 WHEN 1 THEN '0000-00-00' WHEN 2 THEN '31/02/2025' WHEN 3 THEN 'not_a_date' WHEN 4 THEN '' ELSE strftime(DATE '2023-06-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') END AS signup_date,
    c_custkey + s.later * {LATER} AS ingest_seq FROM customer, (VALUES (0), (1)) s(later) WHERE s.later = 0 OR c_custkey % 17 = 6)""".replace("CASE WHEN c_custkey % 33 = 5 THEN '' WHEN s.later = 1 THEN 'UPDATED'", "CASE WHEN s.later = 1 THEN 'UPDATED' WHEN c_custkey % 33 = 5 THEN ''")


def raw_products(t: Tables) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    dirty = F.when(k % 12 == 2, F.concat(F.lit("$"), price)).when(k % 12 == 3, F.concat(F.lit("Rs."), price)).otherwise(_cases(k, 12, price, k0="unknown", k1="N/A", k4="-1", k5=""))
    rows = t.part.select(_cases(k, 41, k, k9="").alias("product_id"), F.col("p_name").alias("product_name"), _cases(k, 19, F.col("p_type"), k2="").alias("category"), dirty.alias("unit_price"), k.alias("ingest_seq"))
    return rows.unionByName(rows.where("ingest_seq % 23 = 8").withColumns({"category": F.lit("MOVED"), "ingest_seq": F.col("ingest_seq") + LATER}))


RAW_PRODUCTS = f"""raw_products AS (
  SELECT CASE WHEN p_partkey % 41 = 9 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS product_id, p_name AS product_name, CASE WHEN s.later = 1 THEN 'MOVED' WHEN p_partkey % 19 = 2 THEN '' ELSE p_type END AS category,
    CASE p_partkey % 12 WHEN 0 THEN 'unknown' WHEN 1 THEN 'N/A' WHEN 2 THEN '$' || CAST(p_retailprice AS DECIMAL(18,2)) WHEN 3 THEN 'Rs.' || CAST(p_retailprice AS DECIMAL(18,2)) WHEN 4 THEN '-1' WHEN 5 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS unit_price,
    p_partkey + s.later * {LATER} AS ingest_seq FROM part, (VALUES (0), (1)) s(later) WHERE s.later = 0 OR p_partkey % 23 = 8)"""


def raw_stores(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.concat(F.lit("S"), k).alias("store_id"), F.col("s_name").alias("store_name"), F.concat(F.lit("City"), "s_nationkey").alias("city"), _cases(k, 13, F.concat(F.lit("Region"), F.col("s_nationkey") % 5), k5=None).alias("region"), k.alias("ingest_seq"))
    return rows.unionByName(rows.where("ingest_seq % 9 = 1").withColumns({"city": F.lit("MOVED"), "ingest_seq": F.col("ingest_seq") + LATER}))


RAW_STORES = f"""raw_stores AS (
  SELECT 'S' || s_suppkey AS store_id, s_name AS store_name, CASE WHEN s.later = 1 THEN 'MOVED' ELSE 'City' || s_nationkey END AS city, CASE WHEN s_suppkey % 13 = 5 THEN NULL ELSE 'Region' || (s_nationkey % 5) END AS region,
    s_suppkey + s.later * {LATER} AS ingest_seq FROM supplier, (VALUES (0), (1)) s(later) WHERE s.later = 0 OR s_suppkey % 9 = 1)"""


def raw_orders(t: Tables) -> DataFrame:
    """A batch, and a later feed with a column more; some orders come in both."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day = F.date_format(F.date_add(F.lit("2023-12-15").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd")
    dirty = F.when(k % 61 == 1, F.concat(F.lit("$"), price)).otherwise(_cases(k, 61, price, k2="unknown", k3="-5", k4="abc"))
    rows = t.orders.select(_cases(k, 53, k, k11="").alias("order_id"), _cases(k, 47, F.col("o_custkey"), k3="").alias("customer_id"), _cases(k, 59, k % 230, k5="").alias("product_id"), F.concat(F.lit("S"), k % 12).alias("store_id"), _cases(k, 43, day, k1="2026-13-40", k2="not_a_date", k3="", k4="00/00/0000").alias("order_date"), _cases(k, 37, k % 5 + 1, k1="", k2="two", k3="-1").alias("quantity"), dirty.alias("unit_price"), k.alias("ingest_seq"))
    batch = rows.where("ingest_seq % 2 = 0 OR ingest_seq % 33 = 9")
    feed = rows.where("ingest_seq % 2 = 1").withColumn("coupon_code", F.concat(F.lit("C"), F.col("ingest_seq") % 3)).withColumn("ingest_seq", F.col("ingest_seq") + LATER)
    return batch.unionByName(feed, allowMissingColumns=True)


RAW_ORDERS = f"""raw_orders AS (
  SELECT CASE WHEN o_orderkey % 53 = 11 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS order_id, CASE WHEN o_orderkey % 47 = 3 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
    CASE WHEN o_orderkey % 59 = 5 THEN '' ELSE CAST(o_orderkey % 230 AS VARCHAR) END AS product_id, 'S' || (o_orderkey % 12) AS store_id,
    CASE o_orderkey % 43 WHEN 1 THEN '2026-13-40' WHEN 2 THEN 'not_a_date' WHEN 3 THEN '' WHEN 4 THEN '00/00/0000' ELSE strftime(DATE '2023-12-15' + CAST(o_orderkey % 60 AS INTEGER), '%Y-%m-%d') END AS order_date,
    CASE o_orderkey % 37 WHEN 1 THEN '' WHEN 2 THEN 'two' WHEN 3 THEN '-1' ELSE CAST(o_orderkey % 5 + 1 AS VARCHAR) END AS quantity,
    CASE o_orderkey % 61 WHEN 1 THEN '$' || CAST(o_totalprice AS DECIMAL(18,2)) WHEN 2 THEN 'unknown' WHEN 3 THEN '-5' WHEN 4 THEN 'abc' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS unit_price,
    CASE WHEN s.later = 1 THEN 'C' || (o_orderkey % 3) END AS coupon_code, o_orderkey + s.later * {LATER} AS ingest_seq
  FROM orders, (VALUES (0), (1)) s(later) WHERE s.later = o_orderkey % 2 OR (s.later = 0 AND o_orderkey % 33 = 9))"""

# --- clean rows and those in quarantine -----------------------------------------------------------------------------


def _named(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    return latest(rows, [key], [F.desc("ingest_seq")])


def customers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A signup date that cannot be read is null and no reason for quarantine."""
    typed = raw_customers(t).withColumns({"signup_date": F.try_to_date("signup_date", "yyyy-MM-dd"), "city": C.blank_to(F.col("city"), "Unknown"), "segment": C.blank_to(F.col("segment"), "Unknown")})
    good, bad = split(typed, _named("customer_id"))
    return _newest(good, "customer_id").drop("ingest_seq"), bad


CUSTOMERS = f"""{RAW_CUSTOMERS},
typed_customers AS (SELECT customer_id, customer_name, email, coalesce(nullif(city, ''), 'Unknown') AS city, coalesce(nullif(segment, ''), 'Unknown') AS segment, CAST(TRY_STRPTIME(signup_date, '%Y-%m-%d') AS DATE) AS signup_date, ingest_seq FROM raw_customers),
customers AS (SELECT * EXCLUDE (rn, ingest_seq) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ingest_seq DESC) AS rn FROM typed_customers WHERE customer_id IS NOT NULL AND customer_id <> '') x WHERE rn = 1)"""


def products(t: Tables) -> tuple[DataFrame, DataFrame]:
    price = F.regexp_extract("unit_price", r"(\d+\.?\d*)", 1).try_cast("decimal(18,2)")
    typed = raw_products(t).withColumns({"unit_price": price, "category": C.blank_to(F.col("category"), "Unknown")})
    good, bad = split(typed, _named("product_id") & (F.col("unit_price") > 0))
    return _newest(good, "product_id").drop("ingest_seq"), bad


PRODUCTS = rf"""{RAW_PRODUCTS},
typed_products AS (SELECT product_id, product_name, coalesce(nullif(category, ''), 'Unknown') AS category, TRY_CAST(regexp_extract(unit_price, '(\d+\.?\d*)', 1) AS DECIMAL(18,2)) AS unit_price, ingest_seq FROM raw_products),
products AS (SELECT * EXCLUDE (rn, ingest_seq) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingest_seq DESC) AS rn FROM typed_products WHERE product_id <> '' AND unit_price > 0) x WHERE rn = 1)"""


def stores(t: Tables) -> DataFrame:
    return _newest(raw_stores(t), "store_id").select("store_id", "store_name", "city", "region")


STORES = f"""{RAW_STORES},
stores AS (SELECT store_id, store_name, city, region FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ingest_seq DESC) AS rn FROM raw_stores) x WHERE rn = 1)"""


def orders(t: Tables) -> tuple[DataFrame, DataFrame]:
    typed = raw_orders(t).withColumns({"price": F.regexp_extract("unit_price", r"(-?\d+\.?\d*)", 1).try_cast("decimal(18,2)"), "count": F.col("quantity").try_cast("int"), "day": F.try_to_date("order_date", "yyyy-MM-dd")})
    valid = _named("order_id") & _named("customer_id") & _named("product_id") & F.col("day").isNotNull() & (F.col("price") > 0) & (F.col("count") > 0)
    good, bad = split(typed, valid)
    names = ["order_id", "customer_id", "product_id", "store_id", F.col("day").alias("order_date"), F.col("count").alias("quantity"), F.col("price").alias("unit_price"), "coupon_code"]
    return _newest(good, "order_id").select(*names), bad


ORDERS = rf"""{RAW_ORDERS},
typed_orders AS (SELECT *, TRY_CAST(regexp_extract(unit_price, '(-?\d+\.?\d*)', 1) AS DECIMAL(18,2)) AS price, TRY_CAST(quantity AS INTEGER) AS pieces, CAST(TRY_STRPTIME(order_date, '%Y-%m-%d') AS DATE) AS day FROM raw_orders),
valid_orders AS (SELECT *, coalesce(order_id <> '' AND customer_id <> '' AND product_id <> '' AND day IS NOT NULL AND price > 0 AND pieces > 0, false) AS valid FROM typed_orders),
clean_orders AS (SELECT order_id, customer_id, product_id, store_id, day AS order_date, pieces AS quantity, price AS unit_price, coupon_code
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ingest_seq DESC) AS rn FROM valid_orders WHERE valid) x WHERE rn = 1)"""


@query(f"WITH {CUSTOMERS} SELECT customer_id, customer_name, email, city, segment, signup_date FROM customers")
def clean_customers(t: Tables) -> DataFrame:
    return customers(t)[0].select("customer_id", "customer_name", "email", "city", "segment", "signup_date")


@query(f"WITH {PRODUCTS} SELECT product_id, product_name, category, CAST(unit_price AS DOUBLE) AS unit_price FROM products")
def clean_products(t: Tables) -> DataFrame:
    return products(t)[0].withColumn("unit_price", double(F.col("unit_price")))


@query(f"WITH {STORES} SELECT * FROM stores")
def clean_stores(t: Tables) -> DataFrame:
    return stores(t)


@query(f"WITH {ORDERS} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price) FROM clean_orders")
def clean_orders(t: Tables) -> DataFrame:
    return orders(t)[0].withColumn("unit_price", double(F.col("unit_price")))


@query(f"""WITH {CUSTOMERS}, {PRODUCTS}, {ORDERS}
    SELECT 'customers' AS name, CAST(count(*) FILTER (WHERE customer_id = '') AS BIGINT) AS rows FROM raw_customers UNION ALL SELECT 'products', CAST(count(*) FILTER (WHERE NOT coalesce(product_id <> '' AND unit_price > 0, false)) AS BIGINT) FROM typed_products
    UNION ALL SELECT 'orders', CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) FROM valid_orders""")
def quarantined_rows(t: Tables) -> DataFrame:
    told = [bad.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, (_, bad) in (("customers", customers(t)), ("products", products(t)), ("orders", orders(t)))]
    return told[0].unionByName(told[1]).unionByName(told[2])


# --- dimensions with history ----------------------------------------------------------------------------------------

CUSTOMER = ["customer_name", "email", "city", "segment"]
PRODUCT = ["product_name", "category", "unit_price"]


def _seed(rows: DataFrame, key: str, attributes: list[str], day: Column) -> DataFrame:
    """One row of each key, from its own day or else the first of all."""
    return rows.select(key, *attributes, F.coalesce(day, F.lit(FIRST_DAY).cast("date")).alias("change_date"))


def customer_seed(t: Tables) -> DataFrame:
    return _seed(customers(t)[0], "customer_id", CUSTOMER, F.col("signup_date"))


def product_seed(t: Tables) -> DataFrame:
    return _seed(products(t)[0], "product_id", PRODUCT, F.lit(None).cast("date"))


def customer_changes(t: Tables) -> DataFrame:
    user = F.col("user_id")
    return t.events.select(user.cast("string").alias("customer_id"), F.concat(F.lit("Customer "), user).alias("customer_name"), F.concat(F.lit("c"), user, F.lit("@mail.example")).alias("email"), F.concat(F.lit("City"), user % 7).alias("city"), F.col("event_type").alias("segment"), F.to_date("ts").alias("change_date"), "ts", "event_id")


def product_changes(t: Tables) -> DataFrame:
    key = F.col("event_id") % 50
    return t.events.select(key.cast("string").alias("product_id"), F.concat(F.lit("Product "), key).alias("product_name"), F.concat(F.lit("Cat"), F.col("user_id") % 4).alias("category"), F.col("value").cast("decimal(18,2)").alias("unit_price"), F.to_date("ts").alias("change_date"), "ts", "event_id")


def customer_dimension(t: Tables) -> DataFrame:
    return scd2.rebuild(customer_changes(t), "customer_id", CUSTOMER, "change_date", ["ts", "event_id"], customer_seed(t))


def product_dimension(t: Tables) -> DataFrame:
    return scd2.rebuild(product_changes(t), "product_id", PRODUCT, "change_date", ["ts", "event_id"], product_seed(t))


def _dimension_sql(name: str, key: str, attributes: list[str], seed: str, changes: str) -> str:
    """Seeds come before all changes; a change that alters nothing opens no version."""
    text = " || '||' || ".join(f"coalesce(CAST({a} AS VARCHAR), '')" for a in attributes)
    cols = ", ".join(attributes)
    return f"""{name}_daily AS (SELECT {key}, {cols}, change_date, 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY {key}, change_date ORDER BY ts DESC, event_id DESC) AS rn FROM ({changes}) c) d WHERE rn = 1),
{name}_all AS (SELECT *, {text} AS content FROM (SELECT {key}, {cols}, change_date, 0 AS ord FROM ({seed}) s UNION ALL SELECT * FROM {name}_daily) u),
{name}_kept AS (SELECT * FROM (SELECT *, lag(content) OVER (PARTITION BY {key} ORDER BY ord, change_date) AS before FROM {name}_all) l WHERE before IS NULL OR before <> content),
{name} AS (SELECT sha256({key} || '||' || strftime(change_date, '%Y-%m-%d')) AS {key}_sk, {key}, {cols}, change_date AS effective_start_date,
  coalesce(CAST(lead(change_date) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end_date, lead(change_date) OVER w IS NULL AS is_current FROM {name}_kept WINDOW w AS (PARTITION BY {key} ORDER BY ord, change_date))"""


CUSTOMER_CHANGES = "SELECT CAST(user_id AS VARCHAR) AS customer_id, 'Customer ' || user_id AS customer_name, 'c' || user_id || '@mail.example' AS email, 'City' || (user_id % 7) AS city, event_type AS segment, CAST(ts AS DATE) AS change_date, ts, event_id FROM events"
PRODUCT_CHANGES = "SELECT CAST(event_id % 50 AS VARCHAR) AS product_id, 'Product ' || (event_id % 50) AS product_name, 'Cat' || (user_id % 4) AS category, CAST(value AS DECIMAL(18,2)) AS unit_price, CAST(ts AS DATE) AS change_date, ts, event_id FROM events"
CUSTOMER_DIMENSION = _dimension_sql("dim_customer", "customer_id", CUSTOMER, f"SELECT * EXCLUDE (signup_date), coalesce(signup_date, DATE '{FIRST_DAY}') AS change_date FROM customers", CUSTOMER_CHANGES)
PRODUCT_DIMENSION = _dimension_sql("dim_product", "product_id", PRODUCT, f"SELECT *, DATE '{FIRST_DAY}' AS change_date FROM products", PRODUCT_CHANGES)
DIMENSION = "effective_start_date, effective_end_date, is_current"


@query(f"WITH {CUSTOMERS} SELECT sha256(customer_id || '||' || strftime(start, '%Y-%m-%d')) AS customer_id_sk, customer_id, segment, start AS effective_start_date, DATE '9999-12-31' AS effective_end_date, true AS is_current FROM (SELECT *, coalesce(signup_date, DATE '{FIRST_DAY}') AS start FROM customers) s")
def scd2_seed(t: Tables) -> DataFrame:
    """The dimension before any change: one open version of each key."""
    none = customer_changes(t).where(F.lit(False))
    return scd2.rebuild(none, "customer_id", CUSTOMER, "change_date", ["ts", "event_id"], customer_seed(t)).select("customer_id_sk", "customer_id", "segment", "effective_start_date", "effective_end_date", "is_current")


@query(f"WITH {CUSTOMERS}, {CUSTOMER_DIMENSION} SELECT customer_id_sk, customer_id, customer_name, email, city, segment, {DIMENSION} FROM dim_customer")
def dim_customer_scd2(t: Tables) -> DataFrame:
    return customer_dimension(t).drop("hash_value")


@query(f"WITH {PRODUCTS}, {PRODUCT_DIMENSION} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price) FROM dim_product")
def dim_product_scd2(t: Tables) -> DataFrame:
    return product_dimension(t).drop("hash_value").withColumn("unit_price", double(F.col("unit_price")))


@query(f"WITH {PRODUCTS}, {PRODUCT_DIMENSION} SELECT product_id_sk, product_id, category, {DIMENSION} FROM dim_product")
def scd2_daily_loop(t: Tables) -> DataFrame:
    """The same dimension day by day, each day a version of a table; the days of the calendar are few."""
    table = VersionedTable(t.spark, workspace(t.spark, "dim_product"))
    changes = settled(product_changes(t), "changes")
    order = ["ts", "event_id"]
    table.commit(scd2.rebuild(changes.where(F.lit(False)), "product_id", PRODUCT, "change_date", order, product_seed(t)), operation="SEED")
    for (day,) in changes.select("change_date").distinct().orderBy("change_date").collect():
        table.commit(scd2.apply_day(table.read(), changes.where(F.col("change_date") == F.lit(day)), "product_id", PRODUCT, "change_date", order), operation="CHANGES")
    return table.read().select("product_id_sk", "product_id", "category", "effective_start_date", "effective_end_date", "is_current")


# --- facts and marts ------------------------------------------------------------------------------------------------


def facts(t: Tables) -> DataFrame:
    """Orders with the customer and product versions of their day, or else the earliest ones, and their store."""
    rows = orders(t)[0].withColumn("revenue", F.col("quantity") * F.col("unit_price"))
    people, things = customer_dimension(t), product_dimension(t)
    rows = scd2.with_fallback(scd2.as_of(rows, people, "customer_id", "order_date", ["segment"]), people, "customer_id", ["segment"])
    rows = scd2.with_fallback(scd2.as_of(rows, things, "product_id", "order_date", ["category"]), things, "product_id", ["category"])
    rows = rows.join(stores(t).select(F.col("store_id").alias("store_sk"), F.col("region").alias("store_region")), F.col("store_id") == F.col("store_sk"), "left")
    names = {"customer_id_sk": "customer_sk", "product_id_sk": "product_sk", "category": "product_category", "segment": "customer_segment", "customer_id_is_estimated": "customer_key_is_estimated", "product_id_is_estimated": "product_key_is_estimated"}
    rows = rows.withColumnsRenamed(names)
    return rows.select("order_id", "customer_sk", "product_sk", "store_sk", "order_date", "quantity", "unit_price", "revenue", "coupon_code", "product_category", "customer_segment", "store_region", "customer_id", "product_id", "customer_key_is_estimated", "product_key_is_estimated")


def _resolved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(rows, F.col("customer_sk").isNotNull() & F.col("product_sk").isNotNull())


FACTS = f"""{CUSTOMERS}, {PRODUCTS}, {STORES}, {ORDERS}, {CUSTOMER_DIMENSION}, {PRODUCT_DIMENSION},
first_customer AS (SELECT customer_id, customer_id_sk, segment FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY effective_start_date) AS rn FROM dim_customer) x WHERE rn = 1),
first_product AS (SELECT product_id, product_id_sk, category FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY effective_start_date) AS rn FROM dim_product) x WHERE rn = 1),
facts AS (SELECT o.order_id, coalesce(c.customer_id_sk, fc.customer_id_sk) AS customer_sk, coalesce(p.product_id_sk, fp.product_id_sk) AS product_sk, s.store_id AS store_sk, o.order_date, o.quantity, o.unit_price, o.quantity * o.unit_price AS revenue, o.coupon_code,
    coalesce(p.category, fp.category) AS product_category, coalesce(c.segment, fc.segment) AS customer_segment, s.region AS store_region, o.customer_id, o.product_id,
    c.customer_id_sk IS NULL AND fc.customer_id_sk IS NOT NULL AS customer_key_is_estimated, p.product_id_sk IS NULL AND fp.product_id_sk IS NOT NULL AS product_key_is_estimated
  FROM clean_orders o LEFT JOIN dim_customer c ON o.customer_id = c.customer_id AND o.order_date BETWEEN c.effective_start_date AND c.effective_end_date
  LEFT JOIN dim_product p ON o.product_id = p.product_id AND o.order_date BETWEEN p.effective_start_date AND p.effective_end_date
  LEFT JOIN stores s ON o.store_id = s.store_id LEFT JOIN first_customer fc ON o.customer_id = fc.customer_id LEFT JOIN first_product fp ON o.product_id = fp.product_id),
resolved AS (SELECT * FROM facts WHERE customer_sk IS NOT NULL AND product_sk IS NOT NULL)"""


def _doubles(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: double(F.col(c)) for c in ("unit_price", "revenue")})


@query(f"WITH {FACTS} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(revenue AS DOUBLE) AS revenue) FROM resolved")
def pit_fact_full(t: Tables) -> DataFrame:
    return _doubles(_resolved(facts(t))[0])


@query(f"WITH {FACTS} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(revenue AS DOUBLE) AS revenue) FROM facts WHERE customer_sk IS NULL OR product_sk IS NULL")
def fact_quarantine(t: Tables) -> DataFrame:
    return _doubles(_resolved(facts(t))[1])


@query(f"""WITH {CUSTOMERS}, {ORDERS}, {CUSTOMER_DIMENSION}, merged AS (SELECT o.order_id, c.customer_id_sk, c.segment, c.effective_start_date AS start, o.order_date BETWEEN c.effective_start_date AND c.effective_end_date AS inside FROM clean_orders o LEFT JOIN dim_customer c ON o.customer_id = c.customer_id)
    SELECT order_id, customer_id_sk, segment FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY start) AS rn FROM merged WHERE inside OR start IS NULL) x WHERE rn = 1""")
def pit_strict(t: Tables) -> DataFrame:
    """Orders of a known customer but before all versions are left out; those of an unknown one stay, without a key."""
    return scd2.as_of_strict(orders(t)[0], customer_dimension(t), "customer_id", "order_date", ["segment"]).select("order_id", "customer_id_sk", "segment")


def _sales(rows: DataFrame, by: str) -> DataFrame:
    """An order is one row of the fact table, so orders are counted as rows."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total_orders"), F.sum("revenue").alias("total_revenue"), F.sum("quantity").alias("total_units"))


SALES = "CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders, CAST(sum(revenue) AS DOUBLE) AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_units"


@query(f"WITH {FACTS} SELECT order_date, {SALES}, CAST(round(sum(revenue) / CAST(count(DISTINCT order_id) AS DECIMAL(18,0)), 2) AS DOUBLE) AS avg_order_value FROM (SELECT * REPLACE (CAST(revenue AS DECIMAL(28,8)) AS revenue) FROM resolved) r GROUP BY 1".replace("sum(revenue) / CAST(count(DISTINCT order_id) AS DECIMAL(18,0))", "CAST(CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id) AS DECIMAL(28,10))"))
def fact_daily_sales(t: Tables) -> DataFrame:
    daily = _sales(_resolved(facts(t))[0], "order_date").withColumn("total_revenue", double(F.col("total_revenue")))
    return daily.withColumn("avg_order_value", C.rounded(F.col("total_revenue") / F.col("total_orders")))


@query(f"WITH {FACTS} SELECT product_category, {SALES} FROM resolved GROUP BY 1")
def fact_category_sales(t: Tables) -> DataFrame:
    return _sales(_resolved(facts(t))[0], "product_category").withColumn("total_revenue", double(F.col("total_revenue")))


@query(f"WITH {FACTS} SELECT customer_segment, CAST(count(DISTINCT customer_sk) AS BIGINT) AS unique_customers, CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM resolved GROUP BY 1")
def fact_segment_sales(t: Tables) -> DataFrame:
    """``unique_customers`` counts versions of customers. Each version has one segment, so it is summed up first."""
    versions = _resolved(facts(t))[0].groupBy("customer_segment", "customer_sk").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r"))
    return versions.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("unique_customers"), F.sum("n").alias("total_orders"), double(F.sum("r")).alias("total_revenue"))


@query(f"WITH {FACTS} SELECT store_region, {SALES} FROM resolved GROUP BY 1")
def fact_region_sales(t: Tables) -> DataFrame:
    """Orders of stores that are unknown or have no region are a group of their own."""
    return _sales(_resolved(facts(t))[0], "store_region").withColumn("total_revenue", double(F.col("total_revenue")))
