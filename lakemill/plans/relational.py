"""Selections, aggregates, joins, subqueries and rankings over the retail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions.cleaning import blank_to, clip, forward_fill
from lakemill.operators.catalog import create_database, create_table_as
from lakemill.operators.dedup import duplicate_keys as duplicates
from lakemill.operators.dedup import latest
from lakemill.operators.ranking import ordered
from lakemill.plans.registry import REVENUE, Tables, double, money, query, revenue


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_project(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT * FROM customer")
def select_all(t: Tables) -> DataFrame:
    return t.customer


@query("SELECT DISTINCT p_type FROM part")
def distinct_category(t: Tables) -> DataFrame:
    return t.part.select("p_type").distinct()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def filter_gt(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice") > 400000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'ECONOMY' AND p_retailprice > 950")
def filter_and(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_type") == "ECONOMY") & (F.col("p_retailprice") > 950)).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 450000")
def filter_or(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 450000)).select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def filter_between(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def filter_not_eq(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def filter_sargable_year(t: Tables) -> DataFrame:
    """A half-open range instead of year(): Parquet statistics prune row groups by it."""
    start, end = (F.lit(f"{y}-01-01").cast("timestamp") for y in (1997, 1998))
    return t.orders.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in_list(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_custkey % 7, 0) IS NULL OR o_orderstatus = 'P')")
def filter_negated_compound(t: Tables) -> DataFrame:
    group = F.nullif(F.col("o_custkey") % 7, F.lit(0))
    return t.orders.where(~(group.isNull() | (F.col("o_orderstatus") == "P"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'")
def filter_future_dates(t: Tables) -> DataFrame:
    """Orders after a fixed clock, so that reruns agree."""
    return t.orders.where(F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp")).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-31'")
def filter_bound_parameters(t: Tables) -> DataFrame:
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate BETWEEN CAST(:first AS TIMESTAMP) AND CAST(:last AS TIMESTAMP)"
    return t.spark.sql(text, args={"first": "1998-03-01", "last": "1998-03-31"}, orders=t.orders)


@query("SELECT (o_custkey % 5 = 0) AS has_coupon, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def group_by_boolean(t: Tables) -> DataFrame:
    return t.orders.groupBy((F.col("o_custkey") % 5 == 0).alias("has_coupon")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 1.18 AS DOUBLE) AS price_with_tax FROM part")
def computed_tax_price(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", double(money("p_retailprice") * F.lit("1.18").cast("decimal(3,2)")).alias("price_with_tax"))


@query("SELECT p_partkey AS product_id, p_name AS product_name, CAST(p_size AS DOUBLE) AS size_as_double FROM part")
def rename_cast_drop(t: Tables) -> DataFrame:
    renamed = t.part.withColumnRenamed("p_partkey", "product_id").withColumnRenamed("p_name", "product_name")
    return renamed.withColumn("size_as_double", F.col("p_size").cast("double")).drop("p_brand", "p_type", "p_size", "p_retailprice")


@query("SELECT p_partkey, CASE WHEN p_retailprice < 925 THEN 'Budget' WHEN p_retailprice < 975 THEN 'Mid-Range' ELSE 'Premium' END AS tier FROM part")
def case_price_tier(t: Tables) -> DataFrame:
    tier = F.when(F.col("p_retailprice") < 925, "Budget").when(F.col("p_retailprice") < 975, "Mid-Range").otherwise("Premium")
    return t.part.select("p_partkey", tier.alias("tier"))


@query("SELECT CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS delivered, CAST(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS pending FROM orders")
def case_count_delivered(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("delivered"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("pending"))


@query("SELECT CAST(count(*) FILTER (WHERE nullif(o_custkey % 7, 0) IS NULL) AS BIGINT) AS null_customers, CAST(count(*) FILTER (WHERE nullif(o_orderkey % 11, 0) IS NULL) AS BIGINT) AS null_orders FROM orders")
def null_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.nullif(F.col("o_custkey") % 7, F.lit(0)).isNull()).alias("null_customers"), F.count_if(F.nullif(F.col("o_orderkey") % 11, F.lit(0)).isNull()).alias("null_orders"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END AS segment FROM customer")
def fill_blank_unknown(t: Tables) -> DataFrame:
    dirty = F.when(F.col("c_custkey") % 8 == 0, "").when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", blank_to(dirty, "Unknown").alias("segment"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END, 'Unknown') AS status, coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END, 0) AS price FROM orders")
def fill_nulls_per_column(t: Tables) -> DataFrame:
    gaps = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"))
    return gaps.na.fill({"status": "Unknown", "price": 0.0})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 9 <> 0")
def drop_rows_with_nulls(t: Tables) -> DataFrame:
    gaps = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, 1).alias("a"), F.when(F.col("o_orderkey") % 9 != 0, 1).alias("b"))
    return gaps.dropna(subset=["a", "b"]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(0, least(5, CAST(l_discount * 100 AS DECIMAL(6,2)))) AS DOUBLE) AS discount FROM lineitem")
def clip_discount(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", double(clip((F.col("l_discount") * 100).cast("decimal(6,2)"), 0, 5)).alias("discount"))


@query("""SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events""")
def ffill_events(t: Tables) -> DataFrame:
    gaps = t.events.withColumn("gap", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return gaps.select("event_id", forward_fill("gap", ["user_id"], ["ts", "event_id"]).alias("filled"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates()


@query("SELECT DISTINCT * FROM lineitem")
def dedup_full(t: Tables) -> DataFrame:
    """Whole rows, of a table that has every third order's lines twice."""
    return t.lineitem.unionAll(t.lineitem.where("l_orderkey % 3 = 0")).dropDuplicates()


#: Every column that orders the lines of one key.
LINE_ORDER = [f"{c} DESC" for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "CAST(l_discount AS DECIMAL(4,2))", "l_tax", "l_returnflag", "l_linestatus")]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS rn FROM lineitem) x WHERE rn = 1""")
def dedup_latest_wins(t: Tables) -> DataFrame:
    order = [F.expr(x.removesuffix(" DESC")).desc() for x in LINE_ORDER]
    return latest(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_key(t: Tables) -> DataFrame:
    """The first row of each key in the order of event_id, where dropDuplicates would keep any."""
    return latest(t.events, ["user_id", "event_type"], [F.col("event_id").asc()]).select("user_id", "event_type", "event_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def count_all(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F'")
def sum_filtered(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").agg(double(F.sum(money("o_totalprice"))).alias("total"))


@query("SELECT p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price FROM part GROUP BY p_type")
def avg_by_group(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg((double(F.sum(money("p_retailprice"))) / F.count(F.lit(1))).alias("avg_price"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY n DESC, o_orderstatus")
def count_sum_by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), double(F.sum(money("o_totalprice"))).alias("total")).orderBy(F.desc("n"), "o_orderstatus")


@query("SELECT p_type, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_type")
def minmax_by_group(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM orders")
def global_min_max_mean(t: Tables) -> DataFrame:
    return t.orders.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), (double(F.sum(money("o_totalprice"))) / F.count(F.lit(1))).alias("mean"))


@query("SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price FROM part GROUP BY p_brand HAVING CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) > 950")
def having_avg(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg((double(F.sum(money("p_retailprice"))) / F.count(F.lit(1))).alias("avg_price")).where("avg_price > 950")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) > 60")
def having_count_gt(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n > 60")


@query("SELECT l_returnflag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) = 1")
def having_one_order(t: Tables) -> DataFrame:
    early = t.orders.where(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp"))
    return early.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n")).where("n = 1").select("o_custkey")


@query("SELECT CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS open FROM lineitem")
def filter_agg(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"))


@query("""SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o,
    CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders GROUP BY 1""")
def conditional_pivot(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(*(F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).alias(s.lower()) for s in "FOP"))


@query(f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1 ORDER BY 1")
def monthly_trend(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month")).agg(double(F.sum(revenue())).alias("revenue")).orderBy("month")


@query("SELECT l_returnflag, CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS avg_discount FROM lineitem GROUP BY 1")
def avg_discount_by_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg((double(F.sum(F.col("l_discount").cast("decimal(4,2)"))) / F.count(F.lit(1))).alias("avg_discount"))


@query("SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem")
def qty_total(t: Tables) -> DataFrame:
    return t.lineitem.agg(double(F.sum(money("l_quantity"))).alias("quantity"))


@query("SELECT l_shipdate, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def value_frequency(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT r_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY revenue DESC")
def revenue_by_region(t: Tables) -> DataFrame:
    """Summed by supplier before the joins, so that the lines meet no dimension."""
    by_supplier = t.lineitem.groupBy("l_suppkey").agg(F.sum(revenue()).alias("r"))
    joined = by_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(double(F.sum("r")).alias("revenue")).orderBy(F.desc("revenue"))


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10")
def top10_customers(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(double(F.sum(money("o_totalprice"))).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(10)


@query(f"SELECT l_partkey, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 10")
def top10_products(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(double(F.sum(revenue())).alias("revenue")).orderBy(F.desc("revenue"), "l_partkey").limit(10)


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY total, o_custkey LIMIT 5")
def bottom5_customers(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(double(F.sum(money("o_totalprice"))).alias("total")).orderBy("total", "o_custkey").limit(5)


@query("SELECT o_custkey, max(o_totalprice) AS highest FROM orders GROUP BY 1 ORDER BY highest DESC, o_custkey")
def max_order_per_customer(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("highest")).orderBy(F.desc("highest"), "o_custkey")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner2(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT o_orderkey, p_name, l_quantity, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'")
def join_inner3(t: Tables) -> DataFrame:
    joined = t.orders.where("o_orderstatus = 'F'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("o_orderkey", "p_name", "l_quantity", "l_extendedprice")


EARLY = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01') o"


def _early(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp"))


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {EARLY} ON c_custkey = o_custkey")
def join_left(t: Tables) -> DataFrame:
    return t.customer.join(_early(t), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c RIGHT JOIN {EARLY} ON c_custkey = o_custkey")
def join_right(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 2 = 0").join(_early(t), F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN {EARLY} ON c_custkey = o_custkey")
def join_full(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 2 = 0").join(_early(t), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {EARLY} WHERE c_custkey = o_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(_early(t), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {EARLY} WHERE c_custkey = o_custkey)")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(_early(t), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {EARLY} WHERE o_custkey IS NOT NULL)")
def join_not_in(t: Tables) -> DataFrame:
    """The guard against nulls makes NOT IN an anti join."""
    return t.customer.join(_early(t).where("o_custkey IS NOT NULL"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT a.event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE))""")
def join_anti_composite(t: Tables) -> DataFrame:
    dated = t.events.withColumn("day", F.to_date("ts"))
    return dated.join(dated.where("event_type = 'purchase'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_rows(t: Tables) -> DataFrame:
    parents = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")
    return t.lineitem.join(parents, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON c_custkey % 100 = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2")
def join_role_playing(t: Tables) -> DataFrame:
    a, b = t.nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("customer_nation")), t.nation.select(F.col("n_nationkey").alias("bk"), F.col("n_name").alias("supplier_nation"))
    joined = t.customer.join(a, F.col("c_nationkey") == F.col("ak")).join(t.supplier, F.col("c_custkey") % 100 == F.col("s_suppkey")).join(b, F.col("s_nationkey") == F.col("bk"))
    return joined.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, count_a, count_b FROM (SELECT o_custkey AS key, CAST(count(*) AS BIGINT) AS count_a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey AS key, CAST(count(*) AS BIGINT) AS count_b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (key)")
def join_using(t: Tables) -> DataFrame:
    of = lambda s, name: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias(name))
    return of("F", "count_a").join(of("O", "count_b"), on="key")


AVG_PRICE = "(SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM orders)"


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {AVG_PRICE}")
def scalar_subquery_gt_avg(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE o_totalprice > {AVG_PRICE.replace('FROM orders', 'FROM {orders}')}", orders=t.orders)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_max(t: Tables) -> DataFrame:
    """One shuffle: the maximum over the customer's window instead of a join."""
    top = F.max("o_totalprice").over(W.partitionBy("o_custkey"))
    return t.orders.withColumn("top", top).where("o_totalprice = top").select("o_custkey", "o_orderkey", "o_totalprice")


TOTALS = "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"


def _totals(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(double(F.sum(money("o_totalprice"))).alias("total"))


@query(f"WITH totals AS ({TOTALS}) SELECT o_custkey, total FROM totals")
def cte_totals(t: Tables) -> DataFrame:
    return _totals(t)


@query("""WITH totals AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(s AS DOUBLE) AS total FROM totals WHERE s * (SELECT count(*) FROM totals) > (SELECT sum(s) FROM totals)""")
def cte_above_avg(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s"))
    mean = totals.agg(F.sum("s").alias("all"), F.count(F.lit(1)).alias("n"))
    return totals.join(F.broadcast(mean), F.col("s") * F.col("n") > F.col("all")).select("o_custkey", double(F.col("s")).alias("total"))


@query(f"SELECT o_custkey, total, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank FROM ({TOTALS}) x")
def rank_customers(t: Tables) -> DataFrame:
    """Ranks one row per customer, in ranges of the total where customers are many."""
    return ordered(_totals(t), "total").select("o_custkey", "total", F.col("rank").cast("int").alias("rank"))


@query(f"SELECT * FROM (SELECT o_custkey, total, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank FROM ({TOTALS}) x) y WHERE rank <= 3")
def rank_top3(t: Tables) -> DataFrame:
    """Ties stay: the third highest distinct total bounds the rows before they are ranked."""
    totals = _totals(t)
    low = totals.orderBy(F.desc("total")).limit(3).agg(F.min("total").alias("low"))
    best = totals.join(F.broadcast(low), F.col("total") >= F.col("low")).drop("low")
    return best.withColumn("rank", F.rank().over(W.orderBy(F.desc("total")))).where("rank <= 3")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders")
def row_number_per_customer(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"))


@query(f"SELECT c_name, c_mktsegment, total, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank FROM ({TOTALS}) x JOIN customer ON o_custkey = c_custkey")
def rank_join_final(t: Tables) -> DataFrame:
    joined = _totals(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return ordered(joined.select("c_name", "c_mktsegment", "total"), "total").select("c_name", "c_mktsegment", "total", F.col("rank").cast("int").alias("rank"))


@query("SELECT DISTINCT c_custkey AS customer_id, c_mktsegment, c_nationkey FROM customer")
def ctas_distinct(t: Tables) -> DataFrame:
    """The normalised table that CREATE TABLE AS SELECT DISTINCT makes, read by its name."""
    shop = create_database(t.spark, "normal")
    return create_table_as(t.spark, f"{shop}.customers", "SELECT DISTINCT c_custkey AS customer_id, c_mktsegment, c_nationkey FROM {customer}", customer=t.customer)


@query("""SELECT o_orderkey, o_custkey, o_orderpriority AS coupon_code FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_orderstatus = 'O'""")
def union_by_name_drift(t: Tables) -> DataFrame:
    new = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("coupon_code"))
    old = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    return new.unionByName(old, allowMissingColumns=True)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM orders LIMIT 7) x")
def limit_preview(t: Tables) -> DataFrame:
    """Which rows a limit without an order keeps is open; how many is not."""
    return t.orders.limit(7).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey AS store_id, CAST(sum(coalesce(CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END, 0)) AS DOUBLE) AS revenue
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem) x JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY revenue DESC, store_id""")
def store_revenue_pipeline(t: Tables) -> DataFrame:
    """Deduplicate, fill missing prices with 0, sum prices by store, sort."""
    lines = t.lineitem.dropDuplicates(["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).where(F.col("l_suppkey").isNotNull())
    price = F.coalesce(F.when(F.col("l_orderkey") % 13 != 0, money("l_extendedprice")), F.lit(0).cast("decimal(18,2)"))
    stores = t.supplier.select(F.col("s_suppkey").alias("store_id"))
    return lines.join(stores, F.col("l_suppkey") == F.col("store_id")).groupBy("store_id").agg(double(F.sum(price)).alias("revenue")).orderBy(F.desc("revenue"), "store_id")
