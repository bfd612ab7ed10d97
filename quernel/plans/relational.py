"""Generic relational queries on the star schema: rollups, semi and anti joins, as-of joins, sessions. They extend what retrieval needs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.session import table


def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    cents = lambda c: F.sum(F.round(c * 100).cast("bigint"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), cents(F.col("l_extendedprice")).alias("base_cents"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


def nation_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents"))


def idle_customers(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def priority_orders(spark, sf_dir):
    """Orders with a line of more than 45 pieces, by priority."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def last_view_before_purchase(spark, sf_dir):
    """As of each purchase the last view of the user, by one window over both."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", seen.alias("view_id")).where("event_type = 'purchase'").select("event_id", "view_id")


def sessions(spark, sf_dir):
    """Sessions of a user, parted by six hours without events."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.coalesce(F.col("us") - F.lag("us").over(w) > 6 * 3600 * 1_000_000, F.lit(True)).cast("int")
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("us"))


def top_parts(spark, sf_dir):
    """The three parts of each brand that sold most."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sold = li.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty")).join(p, F.col("l_partkey") == p.p_partkey)
    w = Window.partitionBy("p_brand").orderBy(F.desc("qty"), "p_partkey")
    return sold.select("p_brand", "p_partkey", "qty", F.row_number().over(w).alias("rank")).where("rank <= 3")


QUERIES = {f.__name__: f for f in (pricing_summary, nation_rollup, idle_customers, priority_orders, last_view_before_purchase, sessions, top_parts)}

SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS base_cents, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "nation_rollup": "SELECT r_name, n_name, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "idle_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
    "priority_orders": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1",
    "last_view_before_purchase": "SELECT event_id, view_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'purchase'",
    "sessions": "WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, TRUE)::INT AS new FROM events), s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, max(us) - min(us) AS us FROM s GROUP BY 1, 2",
    "top_parts": "SELECT * FROM (SELECT p_brand, p_partkey, qty, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS rank FROM (SELECT l_partkey, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY 1) JOIN part ON p_partkey = l_partkey) WHERE rank <= 3",
}
