"""Joins beyond the catalogue's: strategies, outer, range, lateral and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators.ranges import count_smaller
from tidewheel.plans.registry import query, table


#: Days in a bin of the range join.
BIN_DAYS = 16


def _counted(joined):
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


_STRATEGY_SQL = "SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


@query(_STRATEGY_SQL)
def join_sort_merge(spark, sf_dir):
    return _counted(table(spark, sf_dir, "lineitem").hint("merge").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")))


@query(_STRATEGY_SQL)
def join_shuffled_hash(spark, sf_dir):
    return _counted(table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")))


@query("""
SELECT s_suppkey, count(*)::BIGINT AS poorer FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal < s_acctbal GROUP BY s_suppkey
""")
def join_theta(spark, sf_dir):
    """An inequality beside an equality: counted by ranges of nation and value, as a join by nation meets pairs that grow with the square of the tables."""
    supplier, customer = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), table(spark, sf_dir, "customer")
    told = count_smaller(supplier, "s_acctbal", customer, "c_acctbal", "n", by=("s_nationkey", "c_nationkey"))
    return told.filter("n > 0").groupBy("s_suppkey").agg(F.sum("n").alias("poorer"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    """Two tables of fixed size; the one cross join here."""
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("""
SELECT o_orderkey, l.k AS line_key, l.n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o
RIGHT JOIN (SELECT l_orderkey AS k, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l.k
""")
def join_right(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line_key")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("line_key"), "right")


@query("""
SELECT a.n_nationkey, a.customers, b.suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*)::BIGINT AS customers FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*)::BIGINT AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.n_nationkey = b.n_nationkey
""")
def join_full(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, F.col("n_nationkey") == F.col("k"), "full").drop("k")


@query("""
SELECT a.event_id, b.event_id AS later FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 20 MINUTE WHERE a.event_type = 'view' OR a.event_type = 'click'
""")
def join_interval(spark, sf_dir):
    """Equality and a range of time: both sides have bins of the range's length in their key, and a row meets two of them, so rows of a user that are far apart never meet."""
    events = table(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (20 * 60 * 1_000_000))
    a = events.filter(F.col("event_type").isin("view", "click")).select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("t"), F.explode(F.array(at, at + 1)).alias("bin"))
    b = events.select(F.col("event_id").alias("later"), "user_id", "ts", at.alias("b"))
    near = (F.col("u") == F.col("user_id")) & (F.col("bin") == F.col("b")) & (F.col("ts") > F.col("t")) & (F.col("ts") <= F.col("t") + F.expr("INTERVAL 20 MINUTES"))
    return a.join(b, near).select("event_id", "later")


@query("""
SELECT a.o_orderkey, count(*)::BIGINT AS near FROM orders a
JOIN orders b ON b.o_orderdate BETWEEN a.o_orderdate - INTERVAL 10 DAY AND a.o_orderdate + INTERVAL 10 DAY GROUP BY a.o_orderkey
""")
def join_range_binned(spark, sf_dir):
    """A range without an equality: days are cut in bins, each query row goes to the bins it reaches, and bins are joined by equality."""
    orders = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date"))
    # rows of a day are counted first, so a bin has as many rows as it has days, whatever the orders of a day
    days = orders.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    asked = days.select(F.col("day").alias("d"), F.explode(F.sequence(F.floor((F.col("day") - 10) / BIN_DAYS), F.floor((F.col("day") + 10) / BIN_DAYS))).alias("bin"))
    days = days.withColumn("b", F.floor(F.col("day") / BIN_DAYS))
    near = asked.join(days, (F.col("bin") == F.col("b")) & F.col("day").between(F.col("d") - 10, F.col("d") + 10)).groupBy("d").agg(F.sum("n").alias("near"))
    return orders.select("o_orderkey", day.alias("_day")).join(near, F.col("_day") == F.col("d")).select("o_orderkey", "near")


@query("""
SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t
""")
def join_lateral(spark, sf_dir):
    """The dearest order of each customer; of several as dear, the one with the smallest key. Nulls come last in both orders, as in the SQL."""
    # keys of one type, made before they meet: with a cast in the condition, Spark takes one row of all orders instead of one for each customer
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("long").alias("c"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("long").alias("o"))
    return spark.sql(
        "SELECT c_custkey, t.o_orderkey FROM {customer}, LATERAL "
        "(SELECT o_orderkey FROM {orders} WHERE o = c ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1) t",
        customer=customer, orders=orders,
    )


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def subquery_exists_in(spark, sf_dir):
    return spark.sql(
        "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F') "
        "AND c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
        **{t: table(spark, sf_dir, t) for t in ("customer", "orders", "nation")},
    )
