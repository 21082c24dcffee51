"""Aggregations beyond the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.selection import exact_quantiles
from tidewheel.plans.registry import query, table



@query("SELECT count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS price, max(l_tax) AS most, min(l_shipdate) AS first_date FROM lineitem")
def group_all(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.max("l_tax").alias("most"), F.min("l_shipdate").alias("first_date")
    )


@query("""
SELECT l_linestatus, round(var_pop(l_quantity), 6) AS var_pop, round(var_samp(l_quantity), 6) AS var_samp, round(corr(l_quantity, l_extendedprice), 6) AS corr,
  round(covar_samp(l_quantity, l_tax), 6) AS covar, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_linestatus
""")
def group_variance(spark, sf_dir):
    q, p = "l_quantity", "l_extendedprice"
    told = {"var_pop": F.var_pop(q), "var_samp": F.var_samp(q), "corr": F.corr(q, p), "covar": F.covar_samp(q, "l_tax")}
    cols = [F.round(c, 6).alias(k) for k, c in told.items()] + [F.round(F.regr_slope(p, q), 4).alias("slope")]
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*cols)


@query("""
SELECT l_returnflag, round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) AS skew, round(kurtosis_pop(l_extendedprice), 6) AS kurt
FROM lineitem GROUP BY l_returnflag
""")
def group_moments(spark, sf_dir):
    """Population skewness and kurtosis."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.skewness("l_extendedprice"), 6).alias("skew"), F.round(F.kurtosis("l_extendedprice"), 6).alias("kurt")
    )


@query("""
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
  min(o_orderstatus) FILTER (true) AS least FROM orders GROUP BY o_orderpriority
""")
def group_percentiles(spark, sf_dir):
    """Exact percentiles without any group in one buffer, beside an ordinary aggregate."""
    orders = table(spark, sf_dir, "orders")
    told = exact_quantiles(orders, "o_orderpriority", "o_totalprice", [0.9, 0.25]).groupBy("o_orderpriority")
    told = told.agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 4).alias(name) for p, name in ((0.9, "p90"), (0.25, "p25"))])
    least = orders.groupBy(F.col("o_orderpriority").alias("o")).agg(F.min("o_orderstatus").alias("least"))
    return told.join(least, F.col("o_orderpriority").eqNullSafe(F.col("o"))).select("o_orderpriority", "p90", "p25", "least")


@query("""
SELECT l_returnflag, mode FROM (SELECT l_returnflag, l_quantity AS mode, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS r
FROM lineitem GROUP BY l_returnflag, l_quantity) WHERE r = 1
""")
def group_mode(spark, sf_dir):
    """The commonest value, the smallest of ties: counts first, so that no group is held whole."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").count()
    best = F.min_by("l_quantity", F.struct(-F.col("count"), "l_quantity"))
    return counts.groupBy("l_returnflag").agg(best.alias("mode"))


@query("SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def group_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def group_grouping_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.groupingSets([[p], [s], []], p, s).agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, (count(*) FILTER (l_quantity > 40))::BIGINT AS large, bool_and(l_quantity > 0) AS every, bool_or(l_discount > 0.09) AS any_high
FROM lineitem GROUP BY l_returnflag
""")
def group_filtered(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 40).alias("large"), F.bool_and(F.col("l_quantity") > 0).alias("every"), F.bool_or(F.col("l_discount") > 0.09).alias("any_high")
    )


@query("""
SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS dearest, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS path
FROM orders GROUP BY o_custkey
""")
def group_arg_max(spark, sf_dir):
    """Ordered collecting holds one customer's orders at a time."""
    ordered = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.array_join(F.transform(ordered, lambda x: x["o_orderstatus"]), "").alias("path")
    )


@query("""
SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount FROM lineitem)
UNPIVOT (value FOR name IN (quantity, discount))
""")
def group_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount"], "name", "value")


def transposed(rows: DataFrame, index: str, columns: list) -> DataFrame:
    """A row for each column of ``rows`` but ``index``, and a column for each of ``columns``, values of ``index``; null where it has none.

    The values are named by the caller, so that the plan needs no look at the data and nothing goes through the driver.
    Columns are of one type; an index that repeats gives the largest value.
    """
    rest = [c for c in rows.columns if c != index]
    long = rows.withColumnRenamed(index, "_index").unpivot(["_index"], rest, "_measure", "_value")
    return long.groupBy("_measure").pivot("_index", columns).agg(F.max("_value")).withColumnRenamed("_measure", "measure")


@query("""
WITH t AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, sum(l_quantity) AS quantity, max(l_extendedprice) AS dearest FROM lineitem GROUP BY 1)
SELECT m AS measure, max(CASE WHEN f = 'A' THEN x END) AS A, max(CASE WHEN f = 'N' THEN x END) AS N, max(CASE WHEN f = 'R' THEN x END) AS R
FROM (SELECT f, 'n' AS m, n AS x FROM t UNION ALL SELECT f, 'quantity', quantity FROM t UNION ALL SELECT f, 'dearest', dearest FROM t) GROUP BY m
""")
def group_transpose(spark, sf_dir):
    """Measures by return flag, with the flags as columns."""
    totals = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("dearest"))
    return transposed(totals, "l_returnflag", ["A", "N", "R"])
