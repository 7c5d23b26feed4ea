"""From dirty feeds to marts: cleaning, dimensions with history, facts, quarantine and daily sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions import cleaning as C
from lakemill.operators import scd2
from lakemill.operators.constraints import split
from lakemill.operators.dedup import latest
from lakemill.plans.registry import REVENUE, Tables, double, money, query, revenue


def _dirty_price() -> Column:
    k = F.col("p_partkey") % 6
    text = F.col("p_size").cast("string")
    return F.when(k == 0, F.concat(F.lit("$"), text)).when(k == 1, "unknown").when(k == 2, F.concat(F.lit("Rs."), text, F.lit(".75"))).when(k == 3, "-1").when(k == 4, "").otherwise(text)


DIRTY_PRICE = "CASE p_partkey % 6 WHEN 0 THEN '$' || p_size WHEN 1 THEN 'unknown' WHEN 2 THEN 'Rs.' || p_size || '.75' WHEN 3 THEN '-1' WHEN 4 THEN '' ELSE CAST(p_size AS VARCHAR) END"


@query(rf"SELECT p_partkey, TRY_CAST(regexp_extract({DIRTY_PRICE}, '(-?\d+\.?\d*)', 1) AS DOUBLE) AS price FROM part")
def price_extract(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.first_number(_dirty_price()).alias("price"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size * 1000 AS DOUBLE) END AS price FROM part")
def price_strip_currency(t: Tables) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit('"₹'), F.format_number(F.col("p_size") * 1000, 0), F.lit('" ')))
    return t.part.select("p_partkey", C.strip_currency(text).alias("price"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(trim('  ' || p_name || '   USB-c ' || p_type || ' '), '\\s+', ' ', 'g'), '[A-Za-z]+|[^A-Za-z]+'),
    lambda x: upper(x[1]) || lower(x[2:])), '') AS name FROM part""")
def name_title_norm(t: Tables) -> DataFrame:
    dirty = F.concat(F.lit("  "), "p_name", F.lit("   USB-c "), "p_type", F.lit(" "))
    return t.part.select("p_partkey", C.title_case(dirty).alias("name"))


@query("SELECT c_custkey, c_custkey % 5 IN (0, 3) AS invalid FROM customer")
def email_validate(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    email = F.when(k == 0, "no-at.example").when(k == 3, None).when(k == 1, " a@b.example ").otherwise(F.concat("c_name", F.lit("@mail.example")))
    return t.customer.select("c_custkey", C.invalid_email(email).alias("invalid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate END AS at FROM orders")
def multi_format_ts(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "MM/dd/yyyy")).when(k == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("2026-13-40")
    return t.orders.select("o_orderkey", C.parse_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("SELECT CAST(count(*) AS BIGINT) AS wrong FROM orders WHERE o_orderkey % 12 = 0")
def wrong_date_flag(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 12 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.agg(F.count_if(text.rlike(r"^\d{2}-\d{2}-\d{4}$")).alias("wrong"))


@query("SELECT c_custkey, sha256(c_custkey || '||' || c_name || '||' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END) AS hash FROM customer")
def row_hash(t: Tables) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", C.row_hash(F.col("c_custkey"), F.col("c_name"), segment).alias("hash"))


@query("SELECT CAST(date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') AS INTEGER) AS days, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate - INTERVAL 1 DAY AS DATE) AS day_before, upper(o_orderpriority) AS priority, o_orderkey FROM orders")
def date_functions(t: Tables) -> DataFrame:
    return t.orders.select(F.datediff(F.lit("2001-12-31").cast("date"), F.col("o_orderdate").cast("date")).alias("days"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_sub(F.col("o_orderdate").cast("date"), 1).alias("day_before"), F.upper("o_orderpriority").alias("priority"), "o_orderkey")


@query(rf"""WITH c AS (SELECT p_partkey, p_name, TRY_CAST(regexp_extract({DIRTY_PRICE}, '(-?\d+\.?\d*)', 1) AS DOUBLE) AS price FROM part)
    SELECT CASE WHEN coalesce(price > 0, false) THEN 'clean' ELSE 'quarantine' END AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM c GROUP BY 1""")
def clean_products_split(t: Tables) -> DataFrame:
    """One predicate splits clean rows from quarantined ones; together they are all rows."""
    typed = t.part.select("p_partkey", C.first_number(_dirty_price()).alias("price"))
    good, bad = split(typed, F.col("price").isNotNull() & (F.col("price") > 0))
    both = good.withColumn("part", F.lit("clean")).unionByName(bad.withColumn("part", F.lit("quarantine")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE o_orderkey % 10 <> 0 AND o_totalprice > 5000) x WHERE rn = 1""")
def clean_orders_latest(t: Tables) -> DataFrame:
    """Batch and incremental loads united by name, validated, then the latest row of each key."""
    batch = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("price"), "o_orderdate")
    late = t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("price"), "o_orderdate", F.lit("C").alias("coupon_code"))
    rows = batch.unionByName(late, allowMissingColumns=True)
    rows = rows.withColumn("price", F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.col("price")))
    typed = rows.withColumn("price", F.col("price").try_cast("double"))
    good, _ = split(typed, F.col("price").isNotNull() & (F.col("price") > 5000))
    return latest(good, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(r"""SELECT CAST((SELECT count(*) FROM orders WHERE o_orderkey % 12 = 0) AS BIGINT) AS wrong_dates, CAST((SELECT count(*) FROM orders WHERE o_custkey % 20 = 0) AS BIGINT) AS null_customers,
    CAST((SELECT count(*) FROM customer WHERE c_custkey % 5 IN (0, 3)) AS BIGINT) AS invalid_emails, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS BIGINT) AS orphan_items,
    CAST((SELECT count(*) FROM lineitem WHERE CAST(l_discount AS DECIMAL(4,2)) > 0.05) AS BIGINT) AS bad_discounts, CAST((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS BIGINT) AS returns""")
def quality_report(t: Tables) -> DataFrame:
    """One aggregate per table, put side by side; each has one row."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    text = F.when(F.col("o_orderkey") % 12 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = t.orders.agg(n(text.rlike(r"^\d{2}-\d{2}-\d{4}$"), "wrong_dates"), n(F.nullif(F.col("o_custkey") % 20, F.lit(0)).isNull(), "null_customers"))
    k = F.col("c_custkey") % 5
    email = F.when(k == 0, "no-at.example").when(k != 3, F.concat("c_name", F.lit("@mail.example")))
    customers = t.customer.agg(n(C.invalid_email(email), "invalid_emails"))
    parents = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")
    orphans = t.lineitem.join(parents, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphan_items"))
    lines = t.lineitem.agg(n(F.col("l_discount").cast("decimal(4,2)") > F.lit("0.05").cast("decimal(4,2)"), "bad_discounts"), n(F.col("l_returnflag") == "R", "returns"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(orders).join(one(customers), "__k").join(one(orphans), "__k").join(one(lines), "__k").drop("__k")


# --- dimensions with history: users by the last event type of a day -------------------------------------------------

DAILY = "SELECT user_id, event_type, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events"
SCD2 = f"""SELECT *, sha256(user_id || '||' || strftime(start, '%Y-%m-%d')) AS sk, coalesce(CAST(lead(start) OVER (PARTITION BY user_id ORDER BY start) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS stop, lead(start) OVER (PARTITION BY user_id ORDER BY start) IS NULL AS is_current
    FROM (SELECT user_id, event_type, day AS start, lag(event_type) OVER (PARTITION BY user_id ORDER BY day) AS before FROM ({DAILY}) d WHERE rn = 1 {{filter}}) x WHERE before IS NULL OR before <> event_type"""


def _dimension(t: Tables, since: str | None = None) -> DataFrame:
    changes = t.events.withColumn("day", F.col("ts").cast("date"))
    if since:
        changes = changes.where(F.col("day") >= F.lit(since).cast("date"))
    return scd2.rebuild(changes, "user_id", ["event_type"], "day", ["ts", "event_id"])


@query(f"SELECT sk AS user_id_sk, user_id, event_type, start AS effective_start_date, stop AS effective_end_date, is_current, sha256(event_type) AS hash_value FROM ({SCD2.format(filter='')}) v")
def scd2_build(t: Tables) -> DataFrame:
    return _dimension(t)


@query(f"SELECT user_id, event_type FROM ({SCD2.format(filter='')}) v WHERE is_current")
def scd2_current(t: Tables) -> DataFrame:
    return _dimension(t).where("is_current").select("user_id", "event_type")


@query(f"SELECT user_id, CAST(count(*) AS BIGINT) AS versions FROM ({SCD2.format(filter='')}) v GROUP BY 1 HAVING count(*) > 1")
def scd2_multi_version(t: Tables) -> DataFrame:
    return _dimension(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


LATE = SCD2.format(filter="AND day >= DATE '2024-01-10' AND user_id % 10 <> 0")
PIT = f"""SELECT e.event_id, e.user_id, CAST(e.ts AS DATE) AS day, v.sk, v.event_type AS segment, e.value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN ({LATE}) v ON e.user_id = v.user_id AND CAST(e.ts AS DATE) BETWEEN v.start AND v.stop"""


def _late_dimension(t: Tables) -> DataFrame:
    changes = t.events.where("user_id % 10 <> 0").withColumn("day", F.col("ts").cast("date"))
    return scd2.rebuild(changes.where(F.col("day") >= F.lit("2024-01-10").cast("date")), "user_id", ["event_type"], "day", ["ts", "event_id"])


def _facts(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), "value")
    return scd2.as_of(bought, _late_dimension(t), "user_id", "day", ["event_type"])


@query(f"SELECT event_id, user_id, day, sk, segment FROM ({PIT}) f")
def pit_fact(t: Tables) -> DataFrame:
    return _facts(t).select("event_id", "user_id", "day", F.col("user_id_sk").alias("sk"), F.col("event_type").alias("segment"))


FALLBACK = f"""SELECT f.event_id, f.user_id, coalesce(f.sk, e.sk) AS sk, coalesce(f.segment, e.event_type) AS segment, f.sk IS NULL AND e.sk IS NOT NULL AS estimated
    FROM ({PIT}) f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS rn FROM ({LATE}) v) y WHERE rn = 1) e ON f.user_id = e.user_id"""


def _filled(t: Tables) -> DataFrame:
    filled = scd2.with_fallback(_facts(t), _late_dimension(t), "user_id", ["event_type"])
    return filled.select("event_id", "user_id", F.col("user_id_sk").alias("sk"), F.col("event_type").alias("segment"), F.col("user_id_is_estimated").alias("estimated"))


@query(FALLBACK)
def pit_fallback(t: Tables) -> DataFrame:
    return _filled(t)


@query(f"SELECT CASE WHEN sk IS NULL THEN 'quarantine' ELSE 'fact' END AS part, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE estimated) AS BIGINT) AS estimated FROM ({FALLBACK}) x GROUP BY 1")
def referential_quarantine(t: Tables) -> DataFrame:
    good, bad = split(_filled(t), F.col("sk").isNotNull())
    both = good.withColumn("part", F.lit("fact")).unionByName(bad.withColumn("part", F.lit("quarantine")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("estimated").alias("estimated"))


@query(f"SELECT DISTINCT user_id FROM ({FALLBACK}) x WHERE sk IS NULL")
def orphan_keys(t: Tables) -> DataFrame:
    return _filled(t).where("sk IS NULL").select("user_id").distinct()


SALES = "CAST(count(DISTINCT l_orderkey) AS BIGINT) AS total_orders, CAST(sum({r}) AS DOUBLE) AS total_revenue, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_units".format(r=REVENUE)


def _by_order(lines: DataFrame, by: str) -> DataFrame:
    per_order = lines.groupBy(by, "l_orderkey").agg(F.sum(revenue()).alias("r"), F.sum(money("l_quantity")).alias("u"))
    return per_order.groupBy(by).agg(F.count(F.lit(1)).alias("total_orders"), double(F.sum("r")).alias("total_revenue"), double(F.sum("u")).alias("total_units"))


@query(f"SELECT order_date, total_orders, total_revenue, total_units, total_revenue / total_orders AS avg_order_value FROM (SELECT CAST(o_orderdate AS DATE) AS order_date, {SALES} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) x ORDER BY 1")
def gold_daily(t: Tables) -> DataFrame:
    """Per order first: an order has one date, so its orders need no distinct count."""
    by_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"), F.sum(money("l_quantity")).alias("u"))
    joined = by_order.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    daily = joined.groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count(F.lit(1)).alias("total_orders"), double(F.sum("r")).alias("total_revenue"), double(F.sum("u")).alias("total_units"))
    return daily.withColumn("avg_order_value", F.col("total_revenue") / F.col("total_orders")).orderBy("order_date")


@query(f"SELECT p_type AS category, {SALES} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY total_revenue DESC")
def gold_category(t: Tables) -> DataFrame:
    """Lines of an order and category are one row before orders are counted, so that is no distinct count."""
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("category", F.col("p_type"))
    return _by_order(joined, "category").orderBy(F.desc("total_revenue"))


@query(f"SELECT c_mktsegment AS segment, CAST(count(DISTINCT o_custkey) AS BIGINT) AS unique_customers, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS total_orders, CAST(sum({REVENUE}) AS DOUBLE) AS total_revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def gold_segment(t: Tables) -> DataFrame:
    """Lines to orders, orders to customers, customers to segments: each step counts what the one before made unique."""
    by_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    by_customer = by_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"))
    joined = by_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"))
    return joined.agg(F.count(F.lit(1)).alias("unique_customers"), F.sum("n").alias("total_orders"), double(F.sum("r")).alias("total_revenue"))


@query(f"SELECT n_name AS region, {SALES} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def gold_region(t: Tables) -> DataFrame:
    """Suppliers are mapped to regions once, before lines meet them."""
    regions = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("region"))
    return _by_order(t.lineitem.join(regions, F.col("l_suppkey") == F.col("s_suppkey")), "region")
