"""Window functions beyond the catalogue's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table



@query("""
SELECT o_orderkey, (rank() OVER w)::INTEGER AS r, (dense_rank() OVER w)::INTEGER AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def window_ranks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("""
SELECT o_orderkey, (ntile(4) OVER w)::INTEGER AS quarter, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""")
def window_shares(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("upto"))


@query("""
SELECT event_id, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER w AS last_id, nth_value(event_id, 2) OVER w AS second_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def window_values(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("event_id", F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(w).alias("last_id"), F.nth_value("event_id", 2).over(w).alias("second_id"))


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW), 2) AS quarter FROM orders
""")
def window_range_interval(spark, sf_dir):
    return spark.sql(
        "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW), 2) AS quarter FROM {orders}",
        orders=table(spark, sf_dir, "orders"),
    )
