import os

import duckdb
import pytest

from tidewheel.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def same(spark_rows, duck_rows):
    def told(rows):
        return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)

    return told(spark_rows) == told(duck_rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    got = catalog.QUERIES[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert same([tuple(r) for r in got.collect()], want)


def test_every_query_without_sql_gives_rows(spark):
    for name in catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys():
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0, name


def test_queries_leave_no_view_and_no_function_in_the_session(spark):
    for name in ("join_lateral", "subquery_exists_in", "window_range_interval", "udf_table", "udf_sql"):
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0, name
    left = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    assert not left & {"_orders", "_customer", "_nation", "_supplier"}
    assert not spark.catalog.functionExists("raised_by") and not spark.catalog.functionExists("letters_of")


def test_late_rows_are_left_out(spark, tmp_path):
    """A row further behind the watermark than the delay doesn't count, one within it does."""
    import json
    import time

    from pyspark.sql import functions as F

    for i, times in enumerate((["10:00", "14:00"], ["14:10"], ["09:20", "13:30", "18:00"])):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{t}:00"}) for t in times))
        os.utime(tmp_path / f"{i}.json", (time.time() + i - 10,) * 2)
    rows = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    told = rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).count().select(F.hour("window.start").alias("h"), "count")
    run = told.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("late").collect()) == [(10, 1), (13, 1), (14, 2)]


def test_ranking_on_a_stream_is_refused(spark):
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.readStream.format("rate").load()
    with pytest.raises(AnalysisException):
        rows.withColumn("r", F.rank().over(Window.orderBy("value"))).writeStream.format("noop").start()


@pytest.mark.parametrize("kind", ["INTEGER", "BIGINT", "SMALLINT"])
def test_lateral_rows_with_null_keys_and_equal_prices_equal_those_of_sql(spark, tmp_path, kind):
    """Keys of orders are integers, those of customers of the same type or another."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT unnest([1, 2, 3, 4])::{kind} AS c_custkey")
    con.execute("CREATE TABLE orders AS SELECT * FROM (VALUES (NULL, 1, 5.0), (7, 1, 5.0), (8, 1, 5.0), (NULL, 2, NULL), (9, 2, NULL), (NULL, 3, 2.0), (3, 3, 1.0)) t(o_orderkey, o_custkey, o_totalprice)")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["join_lateral"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL['join_lateral']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)) == ["(1, 7)", "(2, 9)", "(3, None)"]
