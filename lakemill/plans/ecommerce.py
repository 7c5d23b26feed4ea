"""Sales analytics: revenue, returns, running totals, gaps, tiers, quartiles, year on year, cohorts and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions.cleaning import percent_change, rounded
from lakemill.operators.ranking import ordered, tile
from lakemill.operators.report import period_comparison, report_text, top_products
from lakemill.operators.workspace import workspace
from lakemill.plans.registry import REVENUE, Tables, double, money, query, revenue
from lakemill.sources.fs import Files


def _customer_revenue(t: Tables) -> DataFrame:
    """Exact revenue per customer; lines are summed by order before they meet it."""
    by_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    return by_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))


CUSTOMER_REVENUE = f"(SELECT o_custkey, sum({REVENUE}) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"


@query(f"SELECT p_type AS category, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY revenue DESC")
def w8_category_revenue(t: Tables) -> DataFrame:
    by_part = t.lineitem.groupBy("l_partkey").agg(F.sum(revenue()).alias("r"))
    joined = by_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_type").alias("category")).agg(double(F.sum("r")).alias("revenue")).orderBy(F.desc("revenue"))


@query(f"SELECT o_custkey, c_name, CAST(r AS DOUBLE) AS revenue FROM {CUSTOMER_REVENUE} x JOIN customer ON o_custkey = c_custkey ORDER BY r DESC, o_custkey LIMIT 10")
def w8_top_customers(t: Tables) -> DataFrame:
    best = _customer_revenue(t).orderBy(F.desc("r"), "o_custkey").limit(10)
    return best.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_name", double(F.col("r")).alias("revenue"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS orders FROM orders
    WHERE o_orderdate >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 12 MONTH GROUP BY 1 ORDER BY 1""")
def w8_orders_per_month(t: Tables) -> DataFrame:
    """The last day is asked for first, so that the filter is a constant and prunes the scan."""
    last = t.orders.agg(F.max("o_orderdate").cast("date").alias("last")).first()["last"]
    recent = t.orders.where(F.col("o_orderdate") >= F.add_months(F.lit(last), -12).cast(t.orders.schema["o_orderdate"].dataType))
    return recent.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orders")).orderBy("month")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def w8_never_delivered(t: Tables) -> DataFrame:
    of = lambda df: df.where("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("c_custkey"))
    bought = t.customer.join(of(t.orders), "c_custkey", "left_semi")
    return bought.join(of(t.orders.where("o_orderstatus = 'F'")), "c_custkey", "left_anti").select("c_custkey", "c_name")


SIGNED = "CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS DECIMAL(18,2)) ELSE CAST(l_quantity AS DECIMAL(18,2)) END"


@query("""SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS returned,
    CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS purchased FROM lineitem GROUP BY 1 HAVING returned > purchased""")
def w8_returns_exceed(t: Tables) -> DataFrame:
    none = F.lit(0).cast("decimal(18,2)")
    back = F.sum(F.when(F.col("l_returnflag") == "R", money("l_quantity")).otherwise(none))
    out = F.sum(F.when(F.col("l_returnflag") != "R", money("l_quantity")).otherwise(none))
    return t.lineitem.groupBy("l_partkey").agg(double(back).alias("returned"), double(out).alias("purchased")).where("returned > purchased")


@query(f"""SELECT p_type AS category, CAST(sum(CASE WHEN q < 0 THEN abs(q) ELSE 0 END) AS DOUBLE) * 100.0 / nullif(CAST(sum(abs(q)) AS DOUBLE), 0) AS return_rate
    FROM (SELECT l_partkey, {SIGNED} AS q FROM lineitem) x JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def w8_return_rate(t: Tables) -> DataFrame:
    signed = t.lineitem.withColumn("q", F.when(F.col("l_returnflag") == "R", -money("l_quantity")).otherwise(money("l_quantity")))
    by_part = signed.groupBy("l_partkey").agg(F.sum(F.when(F.col("q") < 0, F.abs("q")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("back"), F.sum(F.abs("q")).alias("all"))
    joined = by_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category"))
    return joined.agg((double(F.sum("back")) * 100.0 / F.nullif(double(F.sum("all")), F.lit(0.0))).alias("return_rate"))


@query(f"""SELECT region, day, CAST(daily AS DOUBLE) AS daily, CAST(sum(daily) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running
    FROM (SELECT o_orderpriority AS region, CAST(o_orderdate AS DATE) AS day, sum({REVENUE}) AS daily FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) x""")
def w8_running_total(t: Tables) -> DataFrame:
    by_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    daily = by_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("region"), F.to_date("o_orderdate").alias("day")).agg(F.sum("r").alias("daily"))
    so_far = F.sum("daily").over(W.partitionBy("region").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow))
    return daily.select("region", "day", double(F.col("daily")).alias("daily"), double(so_far).alias("running"))


@query(f"""SELECT category, product_id, CAST(r AS DOUBLE) AS revenue, CAST(dense_rank() OVER (PARTITION BY category ORDER BY r DESC) AS INTEGER) AS rank
    FROM (SELECT p_type AS category, p_partkey AS product_id, sum({REVENUE}) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x""")
def w8_dense_rank(t: Tables) -> DataFrame:
    by_part = t.lineitem.groupBy(F.col("l_partkey").alias("product_id")).agg(F.sum(revenue()).alias("r"))
    joined = by_part.join(t.part, F.col("product_id") == F.col("p_partkey")).withColumnRenamed("p_type", "category")
    return joined.select("category", "product_id", double(F.col("r")).alias("revenue"), F.dense_rank().over(W.partitionBy("category").orderBy(F.desc("r"))).alias("rank"))


@query("""WITH days AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
    gaps AS (SELECT o_custkey, day, date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) AS gap FROM days),
    means AS (SELECT o_custkey, CAST(sum(gap) AS DOUBLE) / count(gap) AS mean FROM gaps WHERE gap IS NOT NULL GROUP BY 1)
    SELECT g.o_custkey, day, CAST(gap AS INTEGER) AS gap, mean, CASE WHEN mean > 30 THEN 'At Risk' ELSE 'Active' END AS status FROM gaps g JOIN means m ON g.o_custkey = m.o_custkey WHERE gap IS NOT NULL""")
def w8_gaps(t: Tables) -> DataFrame:
    """The mean joins nothing: it is a window over the same partitioning; customers with one day have no gap."""
    days = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(W.partitionBy("o_custkey").orderBy("day"))))
    mine = W.partitionBy("o_custkey")
    found = gaps.withColumn("mean", F.sum("gap").over(mine).cast("double") / F.count("gap").over(mine)).where("gap IS NOT NULL")
    return found.withColumn("status", F.when(F.col("mean") > 30, "At Risk").otherwise("Active"))


@query("""WITH monthly AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1, 2),
    tiers AS (SELECT month, CASE WHEN s > 500000 THEN 'High' WHEN s >= 200000 THEN 'Medium' ELSE 'Low' END AS tier, o_custkey FROM monthly)
    SELECT month, tier, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM tiers GROUP BY 1, 2""")
def w8_monthly_tiers(t: Tables) -> DataFrame:
    monthly = t.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(money("o_totalprice")).alias("s"))
    tier = F.when(F.col("s") > 500000, "High").when(F.col("s") >= 200000, "Medium").otherwise("Low")
    return monthly.groupBy("month", tier.alias("tier")).agg(F.count(F.lit(1)).alias("customers"))  # a customer has one row a month


@query(f"""SELECT o_custkey, CAST(r AS DOUBLE) AS revenue, CASE ntile(4) OVER (ORDER BY r DESC, o_custkey) WHEN 1 THEN 'Platinum' WHEN 2 THEN 'Gold' WHEN 3 THEN 'Silver' ELSE 'Bronze' END AS grade FROM {CUSTOMER_REVENUE} x""")
def w8_ntile(t: Tables) -> DataFrame:
    """Quartiles of one row per customer, in ranges of revenue where customers are many."""
    quarter = tile(4)
    grade = F.when(quarter == 1, "Platinum").when(quarter == 2, "Gold").when(quarter == 3, "Silver").otherwise("Bronze")
    return ordered(_customer_revenue(t), "r", ["o_custkey"]).select("o_custkey", double(F.col("r")).alias("revenue"), grade.alias("grade"))


@query(f"""WITH monthly AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    paired AS (SELECT *, lag(revenue) OVER (PARTITION BY month ORDER BY year) AS before FROM monthly)
    SELECT year, month, revenue, before, CASE WHEN before IS NULL OR before = 0 THEN NULL ELSE (revenue - before) * 100.0 / before END AS growth FROM paired""")
def w8_yoy(t: Tables) -> DataFrame:
    by_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    monthly = by_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(double(F.sum("r")).alias("revenue"))
    paired = monthly.withColumn("before", F.lag("revenue").over(W.partitionBy("month").orderBy("year")))
    return paired.withColumn("growth", percent_change(F.col("revenue"), F.col("before")))


@query("""WITH bought AS (SELECT o_custkey, p_type, o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
    ends AS (SELECT DISTINCT o_custkey, first_value(p_type) OVER w AS first_category, last_value(p_type) OVER w AS last_category FROM bought
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT o_custkey, first_category, last_category FROM ends WHERE first_category <> last_category""")
def w8_first_last(t: Tables) -> DataFrame:
    """First and last as minimum and maximum by the whole order, which aggregate before the shuffle."""
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    place = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ends = bought.groupBy("o_custkey").agg(F.min_by("p_type", place).alias("first_category"), F.max_by("p_type", place).alias("last_category"))
    return ends.where("first_category <> last_category")


@query(f"""SELECT o_custkey, CAST(r AS DOUBLE) AS revenue, CAST(sum(r) OVER (ORDER BY r DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
    CAST(sum(r) OVER (ORDER BY r DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) * 100.0 / CAST(sum(r) OVER () AS DOUBLE) AS share FROM {CUSTOMER_REVENUE} x""")
def w8_cumulative_share(t: Tables) -> DataFrame:
    found = ordered(_customer_revenue(t), "r", ["o_custkey"], {"r": "r"})
    running, total = double(F.col("running_r")), double(F.col("total_r"))
    return found.select("o_custkey", double(F.col("r")).alias("revenue"), running.alias("running"), (running * 100.0 / total).alias("share"))


@query("""WITH first AS (SELECT o_custkey, min(o_orderdate) AS start FROM orders GROUP BY 1),
    active AS (SELECT DISTINCT f.o_custkey, strftime(start, '%Y-%m') AS cohort, (year(o_orderdate) - year(start)) * 12 + month(o_orderdate) - month(start) AS n FROM first f JOIN orders o ON f.o_custkey = o.o_custkey)
    SELECT cohort, CAST(count(DISTINCT o_custkey) AS BIGINT) AS size, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS month_0, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS month_1,
    CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS month_2, CAST(sum(CASE WHEN n = 3 THEN 1 ELSE 0 END) AS BIGINT) AS month_3,
    CAST(sum(CASE WHEN n = 3 THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(DISTINCT o_custkey) AS retention_3 FROM active GROUP BY 1""")
def w8_cohorts(t: Tables) -> DataFrame:
    start = t.orders.withColumn("start", F.min("o_orderdate").over(W.partitionBy("o_custkey")))
    n = (F.year("o_orderdate") - F.year("start")) * 12 + F.month("o_orderdate") - F.month("start")
    active = start.select("o_custkey", F.date_format("start", "yyyy-MM").alias("cohort"), n.alias("n")).distinct()
    in_month = [F.count_if(F.col("n") == k).alias(f"month_{k}") for k in range(4)]
    cohorts = active.groupBy("cohort").agg(F.count_if(F.col("n") == 0).alias("size"), *in_month)  # everyone is active in month 0
    return cohorts.withColumn("retention_3", F.col("month_3").cast("double") * 100.0 / F.col("size"))


@query("""WITH items AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    SELECT pa.p_name AS product_a, pb.p_name AS product_b, CAST(count(DISTINCT a.l_orderkey) AS BIGINT) AS orders FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
    JOIN part pa ON a.l_partkey = pa.p_partkey JOIN part pb ON b.l_partkey = pb.p_partkey GROUP BY 1, 2 ORDER BY orders DESC, product_a, product_b LIMIT 20""")
def w8_bought_together(t: Tables) -> DataFrame:
    """Pairs within an order, whose lines are few: the rows grow with the square of an order's lines, not of the orders.

    Products are named first. Names repeat over ids, so a pair of names counts once an order; that is told where the
    order's lines are together, and only counts of pairs are shuffled.
    """
    items = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "p_name")
    of = lambda k: items.select("l_orderkey", F.col("l_partkey").alias(f"key_{k}"), F.col("p_name").alias(f"product_{k}"))
    pairs = of("a").join(of("b"), "l_orderkey").where("key_a < key_b").select("l_orderkey", "product_a", "product_b").distinct()
    return pairs.groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "product_a", "product_b").limit(20)


PERIOD = """SELECT 'current' AS period, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS revenue
    FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-31'"""


@query(f"WITH c AS ({PERIOD}), p AS ({PERIOD.replace('current', 'previous').replace('1998-03-01', '1998-01-29').replace('1998-03-31', '1998-02-28')}) SELECT c.orders, c.customers, c.revenue, p.revenue AS revenue_before, CASE WHEN p.revenue = 0 THEN NULL ELSE (c.revenue - p.revenue) * 100.0 / p.revenue END AS change FROM c, p")
def period_report(t: Tables) -> DataFrame:
    return period_comparison(t.orders, "1998-03-01", "1998-03-31").select("orders", "customers", "revenue", "revenue_before", "change")


#: Orders at all hours, so that some are late on a period's last day.
HOURS = "(SELECT * REPLACE (o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS o_orderdate) FROM orders)"


def _at_hours(t: Tables) -> DataFrame:
    return t.orders.withColumn("o_orderdate", F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), 0, 0)"))


SOLD = f"""SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(coalesce(sum(sold), 0) AS DOUBLE) AS revenue
    FROM {HOURS} o LEFT JOIN (SELECT l_orderkey, sum({REVENUE}) AS sold FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'"""


@query(f"""WITH c AS ({SOLD}), p AS ({SOLD.replace('1998-03-01', '1998-01-29').replace('1998-03-31', '1998-02-28')})
    SELECT c.orders, c.customers, c.revenue, p.orders AS orders_before, p.customers AS customers_before, p.revenue AS revenue_before, CASE WHEN p.revenue = 0 THEN NULL ELSE (c.revenue - p.revenue) * 100.0 / p.revenue END AS change FROM c, p""")
def period_report_whole_days(t: Tables) -> DataFrame:
    """Revenue of lines, and orders until the end of the last day."""
    return period_comparison(_at_hours(t), "1998-03-01", "1998-03-31", t.lineitem)


@query(f"""SELECT l_partkey, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM lineitem JOIN {HOURS} o ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
    GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 3""")
def period_top_products(t: Tables) -> DataFrame:
    return top_products(t.lineitem, _at_hours(t), "1998-03-01", "1998-03-31")


@query(f"""SELECT 'Orders: ' || format('{{:,}}', orders) AS line FROM ({SOLD.replace(HOURS, 'orders')}) x UNION ALL SELECT 'Customers: ' || format('{{:,}}', customers) FROM ({SOLD.replace(HOURS, 'orders')}) x UNION ALL SELECT 'Revenue: ' || format('{{:,.2f}}', revenue) FROM ({SOLD.replace(HOURS, 'orders')}) x""")
def period_report_file(t: Tables) -> DataFrame:
    """The printed report, written to a file and read again; here its first figures."""
    path = f"{workspace(t.spark, 'report')}/march.txt"
    Files(t.spark, path).write(path, report_text(t.spark, t.sf_dir, "monthly", "1998-03-01", "1998-03-31"))
    return t.spark.read.text(path).where("value RLIKE '^(Orders|Customers|Revenue):'").select(F.col("value").alias("line"))


@query(f"""SELECT p_type AS category, CAST(round(CAST(sum({REVENUE}) AS DECIMAL(28,4)), 2) AS DOUBLE) AS revenue, CAST(round(CAST(avg(CAST(l_quantity AS DOUBLE)) AS DECIMAL(28,10)), 2) AS DOUBLE) AS mean_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def rounded_revenue(t: Tables) -> DataFrame:
    """Rounded to cents as decimals, whose ties are no matter of binary fractions."""
    by_part = t.lineitem.groupBy("l_partkey").agg(F.sum(revenue()).alias("r"), F.sum("l_quantity").alias("q"), F.count("l_quantity").alias("n"))
    joined = by_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category"))
    return joined.agg(double(F.round(F.sum("r"), 2)).alias("revenue"), rounded(F.sum("q") / F.sum("n")).alias("mean_quantity"))
