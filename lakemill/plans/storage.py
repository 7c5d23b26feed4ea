"""Versioned tables, constraints, transactions, file round trips and streaming ingestion as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators import catalog
from lakemill.operators.constraints import violations
from lakemill.operators.tables import CommitConflict, ConstraintViolation, Transaction, VersionedTable
from lakemill.operators.workspace import workspace
from lakemill.plans.registry import Tables, double, query
from lakemill.sources import files, fs, synthetic
from lakemill.streaming.ingest import SchemaChanged, SchemaLog, ingest, ingest_feed


def _customers(t: Tables) -> VersionedTable:
    table = VersionedTable(t.spark, workspace(t.spark, "customers"), clock=iter(range(100)).__next__)
    table.commit(t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment"), operation="CREATE")
    return table


def _feed(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name", F.lit("UPDATED").alias("c_mktsegment"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def merge_upsert(t: Tables) -> DataFrame:
    table = _customers(t)
    table.merge(_feed(t), ["c_custkey"])
    return table.read()


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def merge_update_only(t: Tables) -> DataFrame:
    table = _customers(t)
    table.merge(_feed(t), ["c_custkey"], when_matched=F.col("t.c_mktsegment") == "BUILDING", values={"c_mktsegment": F.col("s.c_mktsegment")}, insert=False)
    return table.read()


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN p_size - 1 ELSE p_size END AS p_size FROM part")
def update_where(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, workspace(t.spark, "parts"))
    table.commit(t.part.select("p_partkey", "p_brand", "p_size"))
    table.update(F.col("p_brand") == "Brand#1", {"p_size": F.col("p_size") - 1})
    return table.read().select("p_partkey", "p_size")


@query("SELECT 'orders' AS name, CAST(count(*) + 1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS stock FROM orders UNION ALL SELECT 'parts', CAST(count(*) AS BIGINT), CAST(sum(p_size) - 2 AS BIGINT) FROM part")
def txn_insert_update(t: Tables) -> DataFrame:
    """An order is inserted and two stocks fall, seen together or not at all."""
    root = workspace(t.spark, "shop")
    orders, parts = VersionedTable(t.spark, f"{root}/orders"), VersionedTable(t.spark, f"{root}/parts")
    orders.commit(t.orders.select("o_orderkey", "o_custkey"))
    parts.commit(t.part.select("p_partkey", "p_size"))
    with Transaction(t.spark, root) as txn:
        txn.commit(orders, t.spark.createDataFrame([(-1, 7)], "o_orderkey long, o_custkey long"), mode="append")
        txn.commit(parts, parts.updated(F.col("p_partkey").isin(1, 2), {"p_size": F.col("p_size") - 1}))
    a = orders.read().agg(F.lit("orders").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("stock"))
    return a.unionAll(parts.read().agg(F.lit("parts").alias("name"), F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("stock")))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def time_travel_v0(t: Tables) -> DataFrame:
    table = _customers(t)
    table.merge(_feed(t), ["c_custkey"])
    return table.read(0)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, 'UPDATED' FROM customer WHERE c_custkey % 2 = 0")
def time_travel_as_of(t: Tables) -> DataFrame:
    """The state between the second and the third commit."""
    table = _customers(t)
    table.commit(_feed(t), mode="append")
    table.update(F.lit(True), {"c_mktsegment": F.lit("GONE")})
    return table.read_as_of(1.5)


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'CREATE', (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0)), (1, 'MERGE', (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0))) x(version, operation, rows)")
def history(t: Tables) -> DataFrame:
    table = _customers(t)
    table.merge(_feed(t), ["c_custkey"])
    return table.history().select("version", "operation", "rows")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), TIMESTAMP '1970-01-01 00:00:00', 'CREATE'), (1, TIMESTAMP '1970-01-01 00:00:01', 'MERGE'), (2, TIMESTAMP '1970-01-01 00:00:02', 'UPDATE')) x(version, timestamp, operation)")
def history_with_time(t: Tables) -> DataFrame:
    table = _customers(t)
    table.merge(_feed(t), ["c_custkey"])
    table.update(F.col("c_custkey") == 1, {"c_mktsegment": F.lit("GONE")})
    return table.history().select("version", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "operation")


@query("""SELECT 'rows' AS name, CAST((SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) + 1 AS BIGINT) AS n UNION ALL SELECT 'conflicts', CAST(2 AS BIGINT)
    UNION ALL SELECT 'gone', CAST(0 AS BIGINT)""")
def concurrent_writers(t: Tables) -> DataFrame:
    """An update and a transaction that another writer got ahead of fail; the row that was appended stays."""
    path = workspace(t.spark, "shared")
    one, other = VersionedTable(t.spark, path), VersionedTable(t.spark, path)
    one.commit(t.customer.where("c_custkey % 2 = 1").select("c_custkey", "c_name"))
    changed = one.updated(F.lit(True), {"c_name": F.lit("GONE")})
    txn, conflicts = Transaction(t.spark, path), 0
    txn.commit(one, changed)
    other.commit(t.spark.createDataFrame([(-1, "new")], "c_custkey long, c_name string"), mode="append")
    for attempt in (lambda: one.commit(changed, operation="UPDATE"), lambda: txn.__exit__(None, None, None)):
        try:
            attempt()
        except CommitConflict:
            conflicts += 1
    rows = other.read()
    told = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_name") == "GONE").alias("gone"), F.lit(conflicts).cast("long").alias("conflicts"))
    return told.select(F.explode(F.create_map(*(x for c in told.columns for x in (F.lit(c), F.col(c))))).alias("name", "n"))


@query("""SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(10,2)) AS price, 'new' AS state FROM part WHERE p_retailprice > 905
    UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'not_null_name', CAST(NULL AS DECIMAL(10,2)), 'rejected'), (-2, 'price_positive', NULL, 'rejected'), (-3, 'id_key', NULL, 'rejected'), (-4, 'brand_fk', NULL, 'rejected')) x""")
def constrained_table(t: Tables) -> DataFrame:
    """Constraints and a default are part of the table; a batch with a row that breaks one adds nothing."""
    root = workspace(t.spark, "constrained")
    brands = VersionedTable(t.spark, f"{root}/brands")
    brands.commit(t.part.select("p_brand").distinct())
    table = VersionedTable(t.spark, f"{root}/parts")
    table.create("id long, name string, price decimal(10,2), brand string, state string", not_null=["name"], defaults={"state": "'new'"}, checks={"price_positive": "price > 0"}, unique={"id_key": ["id"]}, foreign={"brand_fk": ("brand", f"{root}/brands", "p_brand")})
    table.insert(t.part.where("p_retailprice > 905").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand")))
    least = t.part.where("p_retailprice > 905").agg(F.min("p_partkey").alias("id"))
    new = t.spark.range(1).select(F.lit(-9).cast("long").alias("id"), F.lit("x").alias("name"), F.lit(1).alias("price"), F.lit(None).cast("string").alias("brand"))
    bad = [new.withColumn("name", F.lit(None)), new.withColumn("price", F.lit(-50)), least.select("id", F.lit("x").alias("name"), F.lit(1).alias("price"), F.lit(None).cast("string").alias("brand")), new.withColumn("brand", F.lit("nowhere"))]
    told = []
    for k, rows in enumerate(bad, 1):
        try:
            table.insert(rows)
        except ConstraintViolation as e:
            told.append((-k, *e.broken, None, "rejected"))
    return table.read().drop("brand").unionByName(t.spark.createDataFrame(told, "id long, name string, price decimal(10,2), state string"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS coupon_code FROM customer")
def schema_evolution(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, workspace(t.spark, "evolving"))
    table.commit(t.customer.where("c_custkey % 2 <> 0").select("c_custkey"))
    table.commit(t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("coupon_code")), mode="append", evolve=True)
    return table.read()


@query("SELECT p_partkey, CASE WHEN p_retailprice > 950 THEN 'price_range' WHEN p_size >= 40 THEN 'size_limit' END AS violated FROM part WHERE p_retailprice > 950 OR p_size >= 40")
def constraint_check(t: Tables) -> DataFrame:
    checks = {"price_range": F.col("p_retailprice").between(0, 950), "size_limit": F.col("p_size") < 40}
    return violations(t.part, checks).where("violated IS NOT NULL").select("p_partkey", "violated")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part) x WHERE rn > 1")
def constraint_unique(t: Tables) -> DataFrame:
    return violations(t.part, unique={"name_brand": ["p_name", "p_brand"]}, order=["p_partkey"]).where("violated = 'name_brand'").select("p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 9 = 0")
def constraint_fk(t: Tables) -> DataFrame:
    parents = t.customer.where("c_custkey % 9 <> 0")
    return violations(t.orders, foreign={"customer_fk": ("o_custkey", parents, "c_custkey")}).where("violated = 'customer_fk'").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = workspace(t.spark, "csv")
    files.write_csv(t.part.select("p_partkey", "p_name", "p_size"), path)
    return files.read_csv(t.spark, path, "p_partkey long, p_name string, p_size int")


@query("SELECT r_regionkey, r_name || ', \"quoted\"' AS name FROM region")
def csv_quoted_dialect(t: Tables) -> DataFrame:
    path = workspace(t.spark, "quoted")
    rows = t.region.select("r_regionkey", F.concat("r_name", F.lit(', "quoted"')).alias("name"))
    rows.write.option("header", "true").option("quote", '"').option("escape", "\\").csv(path)
    return files.read_quoted_csv(t.spark, path, "r_regionkey int, name string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_nationkey >= 10 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def csv_drift_glob(t: Tables) -> DataFrame:
    """Two feeds, the second with a new column in front."""
    a, b = workspace(t.spark, "drift"), workspace(t.spark, "drift")
    files.write_csv(t.nation.where("n_nationkey < 10").select("n_nationkey", "n_name"), a, single=True)
    files.write_csv(t.nation.where("n_nationkey >= 10").select("n_regionkey", "n_nationkey", "n_name"), b, single=True)
    return files.read_drifting_csv(t.spark, [a, b])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 <> 0")
def parquet_filter_csv(t: Tables) -> DataFrame:
    parquet, csv = workspace(t.spark, "p"), workspace(t.spark, "c")
    t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("user_id"), "o_custkey").write.parquet(parquet)
    files.write_csv(t.spark.read.parquet(parquet).where("user_id IS NOT NULL").select("o_orderkey", "o_custkey"), csv)
    return files.read_csv(t.spark, csv, "o_orderkey long, o_custkey long")


@query("SELECT CAST(count(*) AS BIGINT) AS copied FROM nation")
def copy_with_parity(t: Tables) -> DataFrame:
    a, b = workspace(t.spark, "in"), workspace(t.spark, "out")
    files.write_csv(t.nation, a)
    return t.spark.createDataFrame([(files.copy(t.spark, a, b),)], "copied long")


@query("SELECT 'supplier.parquet' AS file_name, true AS has_bytes")
def source_probe(t: Tables) -> DataFrame:
    return files.probe(t.supplier).select("file_name", (F.col("file_size") > 0).alias("has_bytes"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest_availablenow(t: Tables) -> DataFrame:
    """Drains the feed twice; the second run finds nothing new."""
    target, checkpoint = workspace(t.spark, "bronze"), workspace(t.spark, "checkpoint")
    for _ in range(2):
        ingest(t.spark, t.sf_dir, t.events.schema, target, checkpoint, glob="events.parquet")
    return t.spark.read.parquet(target).select("event_id", "user_id", "event_type", "value")


@query("SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def temp_view_sql(t: Tables) -> DataFrame:
    """Tables registered as views, then plain SQL."""
    t.orders.createOrReplaceTempView("shop_orders")
    t.customer.createOrReplaceTempView("shop_customers")
    return t.spark.sql("SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM shop_orders JOIN shop_customers ON o_custkey = c_custkey GROUP BY 1")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 10.5), (2, 'b', 20.0)) x(id, name, price)".replace("10.5", "CAST(10.5 AS DOUBLE)"))
def inline_rows(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "a", 10.5), (2, "b", 20.0)], "id long, name string, price double")


@query("SELECT 'shop_listing' AS name")
def catalog_listing(t: Tables) -> DataFrame:
    t.region.createOrReplaceTempView("shop_listing")
    return t.spark.sql("SHOW VIEWS LIKE 'shop_listing'").select(F.col("viewName").alias("name"))


@query("SELECT CAST(sum(range % 5) AS BIGINT) AS status_sum, CAST(count(*) AS BIGINT) AS n FROM range(2000)")
def synthetic_rows(t: Tables) -> DataFrame:
    """Generated rows depend on their number alone, so any partitioning makes the same ones."""
    return synthetic.orders(t.spark, 2000).agg(F.sum("status_code").alias("status_sum"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def layout_by_key(t: Tables) -> DataFrame:
    """What an index is for: files partitioned by the filtered column, so that a scan lists one folder."""
    path = workspace(t.spark, "layout")
    t.orders.select("o_orderkey", double(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    return t.spark.read.parquet(path).where("o_orderpriority = '5-LOW'").select("o_totalprice", "o_orderkey")


@query("SELECT column_name, data_type FROM (VALUES ('p_partkey', 'int'), ('p_name', 'string'), ('p_retailprice', 'double'), ('since', 'date')) x(column_name, data_type)")
def csv_infer_schema(t: Tables) -> DataFrame:
    """Types that the reader finds in a CSV file with a header."""
    path = workspace(t.spark, "infer")
    files.write_csv(t.part.select("p_partkey", "p_name", (F.col("p_retailprice") + 0.25).alias("p_retailprice"), F.lit("2024-01-02").alias("since")), path)
    found = files.read_csv(t.spark, path, infer=True)
    return t.spark.createDataFrame(found.dtypes, "column_name string, data_type string")


@query("SELECT * FROM (VALUES ('a.txt', CAST(5 AS BIGINT)), ('b.txt', 0)) x(name, size)")
def file_listing(t: Tables) -> DataFrame:
    path = workspace(t.spark, "listed")
    for name, text in (("a.txt", "hello"), ("b.txt", "")):
        fs.Files(t.spark, path).write(f"{path}/{name}", text)
    return fs.listing(t.spark, path)


@query("SELECT 'part.parquet' AS source_file, CAST(count(*) AS BIGINT) AS n FROM part")
def input_file_names(t: Tables) -> DataFrame:
    return t.part.select(F.regexp_extract(F.input_file_name(), r"([^/]+\.parquet)", 1).alias("source_file")).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, true AS in_order FROM part")
def sequenced_rows(t: Tables) -> DataFrame:
    """Rows of a file keep their order in ``ingest_seq``."""
    path = workspace(t.spark, "sequenced")
    files.write_csv(t.part.select("p_partkey").orderBy("p_partkey"), path, single=True)
    rows = files.with_sequence(files.read_csv(t.spark, path, "p_partkey long"))
    pairs = F.array_sort(F.collect_list(F.struct("ingest_seq", "p_partkey")))
    keys = F.transform(pairs, lambda x: x["p_partkey"])
    return rows.agg(F.countDistinct("ingest_seq").alias("n"), (keys == F.array_sort(keys)).alias("in_order"))


@query("""SELECT * FROM (VALUES ('customers', 'customer_id', 'bigint'), ('customers', 'segment', 'string'), ('orders', 'order_id', 'bigint'), ('orders', 'total', 'double')) x(table_name, column_name, data_type)""")
def catalog_tables(t: Tables) -> DataFrame:
    """Tables and columns of a database, as its catalog lists them."""
    shop = catalog.create_database(t.spark, "shop")
    catalog.create_table_as(t.spark, f"{shop}.customers", "SELECT DISTINCT c_custkey AS customer_id, c_mktsegment AS segment FROM {customer}", customer=t.customer)
    catalog.create_table_as(t.spark, f"{shop}.orders", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM {orders}", orders=t.orders)
    return catalog.columns(t.spark, shop).drop("place")


@query("SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def table_by_name(t: Tables) -> DataFrame:
    """A table of the catalog, written by a DataFrame and read by its name."""
    shop = catalog.create_database(t.spark, "named")
    t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")).write.mode("overwrite").saveAsTable(f"{shop}.customers")
    return t.spark.table(f"{shop}.customers").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, upper(c_name) AS name FROM customer")
def overwrite_schema(t: Tables) -> DataFrame:
    """An overwrite may bring another schema; older versions keep theirs."""
    table = VersionedTable(t.spark, workspace(t.spark, "replaced"))
    table.commit(t.customer.select("c_custkey", "c_acctbal"))
    table.commit(t.customer.select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name")))
    assert table.read(0).columns == ["c_custkey", "c_acctbal"]
    return table.read()


@query("""SELECT 'orders' AS feed, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1) AS BIGINT) AS coupons, CAST(1 AS BIGINT) AS stops FROM orders
    UNION ALL SELECT 'customers', CAST(count(*) AS BIGINT), 0, 0 FROM customer UNION ALL SELECT 'products', CAST(count(*) AS BIGINT), 0, 0 FROM part""")
def stream_three_feeds(t: Tables) -> DataFrame:
    """Three feeds of CSV files into tables. The second day's orders have a column more: the run stops, the next goes on."""
    base, told = workspace(t.spark, "landing"), []
    days = {
        "orders": [t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), t.orders.where("o_orderkey % 2 = 1").select(F.lit("C").alias("coupon_code"), "o_orderkey", "o_custkey")],
        "customers": [t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), t.customer.where("c_custkey % 2 = 1").select("c_custkey", "c_name")],
        "products": [t.part.select("p_partkey", "p_name")],
    }
    for feed, parts in days.items():
        table, log, stops = VersionedTable(t.spark, f"{base}/{feed}_table"), SchemaLog(t.spark, f"{base}/{feed}_schema"), 0
        run = lambda feed=feed, table=table, log=log: ingest_feed(t.spark, f"{base}/{feed}", table, f"{base}/{feed}_checkpoint", log, "2024-01-01 00:00:00")
        for day, rows in enumerate([*parts, None]):
            if rows is not None:
                files.write_csv(rows, f"{base}/{feed}/{day}", single=True)
            try:
                run()
            except SchemaChanged:
                stops += 1
                run()
        rows = table.read()
        coupons = F.count("coupon_code") if "coupon_code" in rows.columns else F.lit(0)
        told.append(rows.where("source_file IS NOT NULL AND load_type = 'incremental' AND ingestion_ts IS NOT NULL").agg(F.lit(feed).alias("feed"), F.count(F.lit(1)).alias("n"), coupons.cast("long").alias("coupons"), F.lit(stops).cast("long").alias("stops")))
    return told[0].unionByName(told[1]).unionByName(told[2])


NUMBERS = "SELECT CAST(count(*) AS BIGINT) FROM range({n}) r(i) WHERE {where}"


def _numbers(n: int, copies: int, where: str = "true") -> str:
    """How many of n rows fit, with every ``copies``-th row there twice."""
    return f"(({NUMBERS.format(n=n, where=where)}) + ({NUMBERS.format(n=n, where=f'({where}) AND i % {copies} = 0')}))"


@query(f"""SELECT * FROM (VALUES ('customers', {_numbers(1000, 25)}), ('no_customer_id', {_numbers(1000, 25, 'i % 60 = 1')}), ('products', {_numbers(1000, 12)}), ('stores', {_numbers(30, 6)}), ('sales', {_numbers(2000, 33)}),
    ('late', {_numbers(2000, 33, 'i % 12 = 5 AND i % 81 <> 1')}), ('no_order', ({NUMBERS.format(n=2000, where='i % 125 = 3')})), ('returned', ({NUMBERS.format(n=2000, where='i % 34 = 1')})), ('new_customers', ({NUMBERS.format(n=200, where='i % 10 = 9')}))) x(name, n)""")
def synthetic_entities(t: Tables) -> DataFrame:
    """Every kind of row that the generators make, with some of the dirt in them counted."""
    s, spark = synthetic, t.spark
    people, sold, lines = s.customers(spark, 1000), s.sales(spark, 2000, "2026-04-26", 1000, 300, 25), s.items(spark, 2000, 1000, 300)
    told = {
        "customers": people, "no_customer_id": people.where("customer_id = ''"), "products": s.products(spark, 1000), "stores": s.stores(spark, 30), "sales": sold,
        "late": sold.where("try_cast(order_date AS DATE) < DATE '2026-04-26'"), "no_order": lines.where("order_id >= 1000"), "returned": lines.where("quantity < 0"), "new_customers": s.changes(spark, 200, "2026-04-26", 1000).where("CAST(customer_id AS BIGINT) >= 1000"),
    }
    out = None
    for name, rows in told.items():
        one = rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT s_suppkey AS store_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def store_revenue_csv(t: Tables) -> DataFrame:
    """A small report as one CSV file with a header."""
    path = workspace(t.spark, "stores")
    by_store = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("r"))
    joined = by_store.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("store_id"), F.col("r").alias("revenue"))
    files.write_csv(joined.orderBy(F.desc("revenue"), "store_id"), path, single=True)
    return files.read_csv(t.spark, path, "store_id long, revenue double")
