"""Whole chains: product listings, relational loads, scripts and the path from raw files to a mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions import cleaning as C
from lakemill.operators import quality, script
from lakemill.operators.constraints import split
from lakemill.operators.dedup import latest
from lakemill.operators.tables import VersionedTable
from lakemill.operators.workspace import workspace
from lakemill.plans.registry import Tables, double, money, query
from lakemill.sources import files


@query("""WITH filled AS (SELECT p_partkey, p_brand, p_name, p_size, last_value(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM part)
    SELECT DISTINCT p_name AS title, category, CAST(p_size * 1000 AS DOUBLE) AS price, CAST(p_size * 2000 AS DOUBLE) AS total FROM filled WHERE p_size > 5 AND p_partkey % 3 <> 0 AND category IS NOT NULL""")
def web_products_pipeline(t: Tables) -> DataFrame:
    """Fill forward, keep rated rows, clean prices, drop what has none, derive, deduplicate."""
    text = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit('"₹'), F.format_number(F.col("p_size") * 1000, 0), F.lit('" ')))
    raw = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("gap"), text.alias("price"), F.col("p_size").cast("string").alias("rating"))
    filled = raw.withColumn("category", C.forward_fill("gap", ["p_brand"], ["p_partkey"]))
    rated = filled.where(F.col("rating").try_cast("double") > 5).select("title", "category", C.strip_currency(F.col("price")).alias("price"))
    return rated.dropna(subset=["price", "category"]).withColumn("total", F.col("price") * 2).dropDuplicates()


@query("SELECT CAST(count(*) AS BIGINT) AS kept, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def relational_load(t: Tables) -> DataFrame:
    """Items without their order are dropped as the tables are loaded."""
    orders, items = (VersionedTable(t.spark, workspace(t.spark, n)) for n in ("orders", "items"))
    orders.commit(t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.to_date("o_orderdate").alias("day")))
    items.commit(t.lineitem.select("l_orderkey", "l_quantity").join(orders.read(), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"))
    return items.read().agg(F.count(F.lit(1)).alias("kept"), double(F.sum(money("l_quantity"))).alias("quantity"))


@query("SELECT * FROM (VALUES ('regions', CAST(5 AS BIGINT), NULL), ('broken', 0, 'AnalysisException'), ('preview', 10, NULL)) x(title, shown, error)")
def script_runner(t: Tables) -> DataFrame:
    t.region.createOrReplaceTempView("script_region")
    t.customer.createOrReplaceTempView("script_customer")
    text = "-- 1. regions\nSELECT * FROM script_region;\n-- 2. broken\nSELECT nothing FROM script_region;\n-- 3. preview\nSELECT * FROM script_customer;\n"
    found = [(title, len(rows), error) for title, rows, _, error in script.run(t.spark, text)]
    return t.spark.createDataFrame(found, "title string, shown long, error string")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'n/a' WHEN s_suppkey % 3 = 1 THEN '+' || format('{:,.1f}', CAST(s_suppkey * 1000 AS DOUBLE)) || '%' ELSE '-' || format('{:,.1f}', CAST(s_suppkey * 1000 AS DOUBLE)) || '%' END AS change FROM supplier""")
def number_format(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") * 1000
    x = F.when(k % 3 == 1, k.cast("double")).when(k % 3 == 2, -k.cast("double"))
    return t.supplier.select("s_suppkey", C.signed_percent(x).alias("change"))


@query("SELECT o_orderkey, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_day FROM orders")
def lead_next_order(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lead(F.to_date("o_orderdate")).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_day"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def keep_last(t: Tables) -> DataFrame:
    """The last row of each key in the order of arrival, which is a column here."""
    return latest(t.events, ["user_id"], [F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def membership_filter(t: Tables) -> DataFrame:
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return t.orders.join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH valid AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS orders, CAST(sum(price) AS DOUBLE) AS revenue FROM valid JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def raw_to_mart(t: Tables) -> DataFrame:
    """Raw text files to a text table, typed and split into clean and quarantined rows, then a mart; each a table."""
    base = workspace(t.spark, "medallion")
    dirty = t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"))
    files.write_csv(dirty, f"{base}/raw")
    bronze, clean, quarantine = (VersionedTable(t.spark, f"{base}/{n}") for n in ("bronze", "clean", "quarantine"))
    bronze.commit(files.with_audit(files.read_csv(t.spark, f"{base}/raw", "o_orderkey string, o_custkey string, day string, price string"), "batch", "2024-01-01 00:00:00"))
    typed = bronze.read().select(F.col("o_orderkey").try_cast("long").alias("order_id"), F.col("o_custkey").try_cast("long").alias("customer_id"), F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.col("price").try_cast("decimal(18,2)").alias("price"))
    good, bad = split(typed, F.col("order_id").isNotNull() & F.col("day").isNotNull() & (F.col("price") > 0))
    clean.commit(latest(good, ["order_id"], [F.desc("day")]))
    quarantine.commit(bad)
    joined = clean.read().join(t.customer, F.col("customer_id") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), double(F.sum("price")).alias("revenue"))


@query("SELECT title, CAST(n AS BIGINT) AS n FROM (VALUES ('regions', (SELECT count(*) FROM region)), ('customers', (SELECT count(*) FROM customer))) x(title, n)")
def script_result_file(t: Tables) -> DataFrame:
    """Each statement's title, first rows and number of rows, written to a file; here its titles and numbers."""
    path = f"{workspace(t.spark, 'script')}/results.txt"
    t.region.createOrReplaceTempView("script_region")
    t.customer.createOrReplaceTempView("script_customer")
    script.write(t.spark, "-- 1. regions\nSELECT * FROM script_region;\n-- 2. customers\nSELECT * FROM script_customer ORDER BY c_custkey;\n", path)
    lines = t.spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)== [^\n]+\n.*?\d+ rows in all"), F.lit(0))).alias("part"))
    return lines.select(F.regexp_extract("part", "== ([^\n]+)", 1).alias("title"), F.regexp_extract("part", r"(\d+) rows in all", 1).cast("long").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date, CAST(count(*) AS BIGINT) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def relational_load_csv(t: Tables) -> DataFrame:
    """Cleaned CSV files, ISO dates, items without their order dropped, tables replaced, laid out by what is asked for, and a view."""
    base = workspace(t.spark, "cleaned")
    files.write_csv(t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("order_date")), f"{base}/orders")
    files.write_csv(t.lineitem.select("l_orderkey", "l_linenumber"), f"{base}/items")
    orders, items = (VersionedTable(t.spark, f"{base}/{n}_table") for n in ("orders", "items"))
    orders.commit(t.spark.range(0).select(F.lit("old").alias("gone")))
    loaded = files.read_csv(t.spark, f"{base}/orders", "o_orderkey long, order_date string")
    loaded = loaded.withColumn("order_date", F.date_format(C.parse_timestamp(F.col("order_date")), "yyyy-MM-dd HH:mm:ss"))
    orders.commit(loaded.repartitionByRange("order_date").sortWithinPartitions("order_date"), operation="REPLACE")
    rows = files.read_csv(t.spark, f"{base}/items", "l_orderkey long, l_linenumber int")
    items.commit(rows.join(orders.read(), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"))
    orders.read().createOrReplaceTempView("loaded_orders")
    items.read().createOrReplaceTempView("loaded_items")
    return t.spark.sql("SELECT order_date, count(*) AS items FROM loaded_items JOIN loaded_orders ON l_orderkey = o_orderkey WHERE order_date >= '1998-01-01' GROUP BY 1")


@query("""WITH filled AS (SELECT p_partkey, p_brand, p_name, p_size, last_value(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM part)
    SELECT p_name AS title, category, CAST(p_size * 1000 AS DOUBLE) AS price, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT p_name, category, p_size, p_partkey % 2 AS kind FROM filled WHERE p_size > 5 AND p_partkey % 3 <> 0) x WHERE category IS NOT NULL GROUP BY 1, 2, 3""")
def web_products_csv(t: Tables) -> DataFrame:
    """Rows are deduplicated by their raw texts, before prices are cleaned: two spellings of one price both stay. Ends in a CSV file."""
    price = F.format_number(F.col("p_size") * 1000, 0)
    text = F.when(F.col("p_partkey") % 3 == 0, "n/a").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"₹'), price, F.lit('" '))).otherwise(price)
    raw = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("gap"), text.alias("price"), F.col("p_size").cast("string").alias("rating"))
    filled = raw.withColumn("category", C.forward_fill("gap", ["p_brand"], ["p_partkey"]))
    rated = filled.where(F.col("rating").try_cast("double") > 5).select("title", "category", "price").dropDuplicates()
    clean = rated.withColumn("price", C.strip_currency(F.col("price"))).dropna(subset=["price", "category"])
    path = workspace(t.spark, "listing")
    files.write_csv(clean, path)
    return files.read_csv(t.spark, path, "title string, category string, price double").groupBy("title", "category", "price").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN NULL WHEN 0 THEN o_orderdate + to_hours(5) WHEN 1 THEN o_orderdate + to_hours(5) ELSE o_orderdate END AS at FROM orders""")
def event_timestamps(t: Tables) -> DataFrame:
    """The four patterns of the event feed, days first; a date that is none is null."""
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate") + F.expr("INTERVAL 5 HOURS")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 4, "31/02/2024").otherwise(F.date_format(d, "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", C.parse_timestamp(text, C.EVENT_FORMATS).cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate END AS at FROM orders")
def order_timestamps(t: Tables) -> DataFrame:
    """Two formats, then a guess."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "MM/dd/yyyy")).when(k == 4, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("2026-13-40")
    return t.orders.select("o_orderkey", C.guess_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("""SELECT name, CAST(n AS BIGINT) AS n FROM (VALUES ('wrong_format', (SELECT count(*) FROM orders WHERE o_orderkey % 12 = 0)), ('unparseable', (SELECT count(*) FROM orders WHERE o_orderkey % 12 = 1)), ('no_customer', (SELECT count(*) FROM orders WHERE o_custkey % 20 = 0)),
    ('renamed', (SELECT count(*) FROM part WHERE p_partkey % 4 < 2)), ('invalid_email', (SELECT count(*) FROM customer WHERE c_custkey % 5 IN (0, 3))), ('orphans', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))),
    ('bad_discount', (SELECT count(*) FROM lineitem WHERE l_linenumber = 3 OR l_linenumber = 4)), ('returns', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2)), ('no_pieces', (SELECT count(*) FROM lineitem WHERE l_linenumber = 2))) x(name, n)""")
def quality_report_full(t: Tables) -> DataFrame:
    """Every counter of the cleaning report, as a text file of one line each, read again."""
    k, d = F.col("o_orderkey") % 12, F.col("o_orderdate")
    day = F.when(k == 0, F.date_format(d, "dd-MM-yyyy")).when(k == 1, "not a date").otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    email = F.when(F.col("c_custkey") % 5 == 0, "no-at.example").when(F.col("c_custkey") % 5 != 3, F.concat("c_name", F.lit("@mail.example")))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("  "), F.initcap("p_name"))).when(F.col("p_partkey") % 4 == 1, F.upper("p_name")).otherwise(F.initcap("p_name"))
    line = F.col("l_linenumber")
    items = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.when(line == 2, 0).when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), F.when(line == 3, 150).when(line == 4, -1).otherwise(F.col("l_discount") * 100).alias("discount"))
    counters = quality.counters(
        t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id")),
        t.orders.select(F.when(F.col("o_custkey") % 20 != 0, F.col("o_custkey")).alias("customer_id"), day.alias("order_date")),
        t.customer.select(email.alias("email")), t.part.select(name.alias("product_name")), items,
    )
    path = f"{workspace(t.spark, 'quality')}/report.txt"
    quality.write_report(counters, path)
    return t.spark.read.text(path).where("value LIKE '%: %'").select(F.split("value", ": ")[0].alias("name"), F.split("value", ": ")[1].cast("long").alias("n"))
