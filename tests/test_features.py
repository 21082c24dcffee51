"""What rows alone don't tell: plans without exchanges, even tasks, aborted writes, repeated batches, state that is forgotten, samples and quantiles on odd input."""

import datetime
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import ordered, sampling, selection, sketches
from tidewheel.plans import catalog
from tidewheel.plans.registry import table
from tidewheel.sources import formats, segments
from tidewheel.streaming import arrivals, late, state

FOLDER = "/root/testdata/sf0.001"
PUSHED = {"spark.sql.python.filterPushdown.enabled": "true"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


# --- sources


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    """One of the tasks fails after others have written segments: the folder has no commit and no segment, and an earlier commit stays."""
    folder = str(tmp_path / "t")
    rows = table(spark, FOLDER, "events").repartition(4)
    formats._segments(spark, rows, folder)
    before = {d for d, _, names in os.walk(folder) if names}
    fails = F.udf(lambda i: 1 // (i - 77), "long")
    with pytest.raises(Exception, match="(?s)ZeroDivision|Writing job aborted|failed"):
        formats._segments(spark, rows.withColumn("value", fails("event_id").cast("double")), folder)
    assert {d for d, _, names in os.walk(folder) if names} == before and len(segments.manifests(folder)) == 1
    with arrivals.settings(spark, PUSHED):
        assert spark.read.format("segments").load(folder).count() == rows.count()
        rows.limit(5).write.format("segments").mode("overwrite").save(folder)
        assert spark.read.format("segments").load(folder).count() == 5


def test_segments_are_skipped_by_pushed_filters(spark, tmp_path):
    nan, folder = float("nan"), str(tmp_path / "t")
    values = [(i, float(i) if i % 7 else None, f"n{i:03d}") for i in range(200)] + [(500, nan, None), (501, -1.0, "z")]
    rows = spark.createDataFrame(values, "i long, x double, name string")
    spark.dataSource.register(segments.Segments)
    rows.repartitionByRange(8, "i").write.format("segments").mode("append").save(folder)
    with arrivals.settings(spark, PUSHED):
        for told in ("i > 150 AND i <= 160", "x >= 190", "x < 3 AND name = 'n001'", "x = 5 OR i = 3", "name > 'n19'", "x IS NULL", "i = 1000"):
            got = spark.read.format("segments").load(folder).filter(told)
            assert sorted(map(str, got.collect())) == sorted(map(str, rows.filter(told).collect())), told
    reader = segments.SegmentReader(folder, ["i"])
    assert list(reader.pushFilters([segments.GreaterThan(("i",), 195), segments.EqualTo(("b",), True)])) == [segments.EqualTo(("b",), True)]
    assert 0 < len(reader.partitions()) < 4


def test_bucketed_join_has_no_exchange_of_its_own(spark):
    got = catalog.QUERIES["join_bucketed"](spark, FOLDER)
    assert "Exchange" not in plan(got).split("Initial Plan")[0] and "SortMergeJoin" in plan(got)


def test_xml_is_cut_in_files_of_so_many_rows(spark, monkeypatch):
    """No task reads more than a file when tasks are small: a file of XML isn't split."""
    monkeypatch.setattr(formats, "XML_ROWS", 40)
    rows = catalog.QUERIES["source_xml"](spark, FOLDER)
    assert len(rows.inputFiles()) == 4 and rows.count() == rows.distinct().count() == 150
    assert max(r.n for r in rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) == 40


def test_folders_are_pruned_at_run_time(spark):
    assert "dynamicpruning" in plan(catalog.QUERIES["join_pruned"](spark, FOLDER))


# --- one hot key


def test_ranges_of_a_hot_key_are_even(spark):
    """Nine tenths of the rows are one user's: no range has over twice the median, and the results don't depend on the number of ranges."""
    hot = ordered._hot(spark, "/root/testdata/sf0.01")
    dealt = hot.repartitionByRange(8, "user_id", "ts").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    asks = "event_type = 'purchase'"
    one, many = (sorted(map(tuple, ordered.as_of(hot, "user_id", "ts", "event_id", asks, n).collect())) for n in (1, 31))
    assert one == many
    one, many = (sorted(map(tuple, ordered.sessions(hot, "user_id", "ts", "event_id", ranges=n).collect())) for n in (1, 31))
    assert one == many


def test_as_of_and_sessions_of_ties_nulls_and_few_rows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(3), at(rnd.randrange(400)), rnd.random() < 0.4) for i in range(300)]
    odd = [(900, None, at(1), True), (901, 1, None, False), (902, 1, at(3), None)]
    frame = spark.createDataFrame(rows + odd, "id long, k long, t timestamp_ntz, asks boolean")
    usable = [*rows, (902, 1, at(3), False)]
    want = {i: max(((s, j) for j, m, s, a in usable if not a and m == k and s <= t), default=(None, None))[1] for i, k, t, asks in usable if asks}
    for n in (1, 5, 40):
        assert {r.id: r.prior for r in ordered.as_of(frame, "k", "t", "id", "asks", n).collect()} == want
    spells = []
    for k in range(3):
        times = sorted(t for _, m, t, _ in usable if m == k)
        for t in times:
            if spells and spells[-1][0] == k and t - spells[-1][3] <= datetime.timedelta(minutes=3):
                spells[-1][2:] = [spells[-1][2] + 1, t]
            else:
                spells.append([k, spells[-1][1] + 1 if spells and spells[-1][0] == k else 1, 1, t])
    for n in (1, 7, 60):
        got = ordered.sessions(frame, "k", "t", "id", 3 * 60 * 1_000_000, n).collect()
        assert sorted((r.k, r.session, r.n) for r in got) == [tuple(s[:3]) for s in spells]
    assert ordered.as_of(frame.limit(0), "k", "t", "id", "asks").collect() == ordered.sessions(frame.limit(0), "k", "t", "id").collect() == []


# --- quantiles, samples, sketches


@pytest.mark.parametrize("last", [3, 50, 10_000])
def test_exact_quantiles_by_rounds(spark, last):
    import duckdb

    rnd = random.Random(last)
    rows = [("even", rnd.random()) for _ in range(3000)] + [("same", 7.0)] * 800 + [("two", float(i % 2)) for i in range(900)] + [("steep", 10.0 ** rnd.randrange(-200, 200)) for _ in range(1500)]
    rows += [("one", 3.0), ("odd", None), ("odd", float("nan")), (None, 1.0), (None, 2.0)]
    probabilities = [0.0, 0.01, 0.5, 0.777, 1.0]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.q for r in selection.exact_quantiles(frame, "g", "v", probabilities, last).collect()}
    con = duckdb.connect()
    for g in ("even", "same", "two", "steep", "one", None):
        own = [v for h, v in rows if h == g]
        want = con.execute("SELECT quantile_cont(v, [0.0, 0.01, 0.5, 0.777, 1.0]) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [own]).fetchall()[0][0]
        assert [got[(g, p)] for p in probabilities] == pytest.approx(want, rel=1e-9)
    assert len(got) == 30


def test_samples_dont_depend_on_partitions(spark):
    rows = table(spark, FOLDER, "documents").select("doc_id", "source").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(sampling.bernoulli(rows, "doc_id", 0.3, 5)) == ids(sampling.bernoulli(rows.repartition(7), "doc_id", 0.3, 5))
    assert ids(sampling.bernoulli(rows, "doc_id", 1.0)) == ids(rows) and ids(sampling.bernoulli(rows, "doc_id", 0.0)) == []
    for k in (1, 4, 500):
        got = sampling.exact_per_stratum(rows, "source", "doc_id", k, 3)
        assert ids(got) == ids(sampling.exact_per_stratum(rows.repartition(5), "source", "doc_id", k, 3))
        sizes = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
        assert {r.source: r["count"] for r in got.groupBy("source").count().collect()} == {s: min(k, n) for s, n in sizes.items()}
    many = spark.range(60_000).select(F.col("id").alias("k"), F.lit("s").alias("s"))
    best = sorted((r.h, r.k) for r in many.select("k", sampling.key_hash("k", 3).alias("h")).collect())[:10]
    assert sorted(r.k for r in sampling.exact_per_stratum(many, "s", "k", 10, 3).collect()) == sorted(k for _, k in best)


def test_sketches_stay_within_their_bounds(spark):
    told = catalog.QUERIES["sketch_count_min"](spark, "/root/testdata/sf0.01").collect()
    n = sum(r.exact for r in told)
    assert all(r.estimate >= r.exact for r in told) and sum(r.estimate > r.exact + 2.72 * n / sketches.WIDTH for r in told) <= 0.01 * len(told)
    for r in catalog.QUERIES["sketch_estimates"](spark, "/root/testdata/sf0.01").collect():
        assert abs(r.distinct_estimate - r.distinct_exact) <= 0.04 * r.distinct_exact and r.median_estimate > 0


def test_no_task_holds_the_lines_of_a_flag(spark):
    """Lines meet their flag's figures where they are, and distinct keys are told in tasks whose number follows the rows."""
    assert "SortMergeJoin [l_returnflag" not in plan(catalog.QUERIES["group_sketches"](spark, FOLDER))
    rows = spark.createDataFrame([("a", k) for k in (1, 1, 2, None)] + [("b", None), (None, 5), (None, 6)], "flag string, k long")
    found = sketches.exact_distinct(rows, "flag", "k", task_rows=1)
    assert {r.flag: r.distinct_exact for r in found.collect()} == {"a": 2, "b": 0, None: 2}
    assert ", 7), REPARTITION_BY_NUM" in plan(found)


# --- streams


def waiting(stream, spark, folder, put):
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    split = late.LateSplit(str(tmp_path / "out"), "ts", "1 HOUR")
    batches = [[(1, at(0)), (2, at(300))], [(3, at(310)), (4, at(100)), (5, at(245)), (6, None)], [(7, at(20)), (8, at(260))]]
    frames = [spark.createDataFrame(b, "event_id long, ts timestamp") for b in batches]
    for i, b in enumerate(frames):
        split(b, i)
    want = {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: False}
    assert {r.event_id: r.late for r in split.rows(spark).collect()} == want
    split(frames[1], 1)
    split(frames[2], 2)
    assert sorted((r.event_id, r.late) for r in split.rows(spark).collect()) == sorted(want.items())


@pytest.mark.parametrize(("ttl_ms", "want"), [(600_000, [[(1, 11), (2, 12)]]), (1000, [[(1, 11), (2, 12)], [(1, 21), (2, 22)]])])
def test_state_is_carried_and_forgotten_over_batches(spark, tmp_path, ttl_ms, want):
    """A key is given once while its state lives, over a restart of the stream, and again after its time to live."""
    kind = "event_id long, user_id long, event_type string, value double, ts timestamp"
    seen = []

    def put(batch, batch_id):
        seen.append(sorted((r.user_id, r.event_id) for r in batch.collect()))

    for i in (1, 2):
        rows = [{"event_id": 10 * i + u, "user_id": u, "event_type": "x", "value": 1.0, "ts": f"2024-01-01T0{i}:00:00"} for u in (1, 2)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        with arrivals.settings(spark, arrivals.ROCKSDB | arrivals.DATA_ONLY):
            waiting(state.first_seen(spark.readStream.schema(kind).json(str(tmp_path / "in")), ttl_ms), spark, str(tmp_path / "state"), put)
        time.sleep(2)
    assert [s for s in seen if s] == want


def test_spells_go_on_over_batches_and_take_late_rows(spark, tmp_path):
    """A spell that two batches share, one that a row between two others joins, and one that the watermark hasn't closed."""
    kind = "event_id long, user_id long, value double, ts timestamp"
    out = []

    def put(batch, batch_id):
        out.extend((r.user_id, r.n, r.total, (r.last - r["first"]) // 60_000_000) for r in batch.collect())

    batches = [[(1, 0), (1, 20), (2, 10)], [(1, 40), (2, 60), (2, 35)], [(3, 300)]]
    for i, b in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        rows = [{"event_id": m, "user_id": u, "value": 1.0, "ts": str(at(m)).replace(" ", "T")} for u, m in b]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        with arrivals.settings(spark, arrivals.ROCKSDB):
            waiting(state.spells(spark.readStream.schema(kind).json(str(tmp_path / "in"))), spark, str(tmp_path / "state"), put)
    assert sorted(out) == [(1, 3, 3.0, 40), (2, 3, 3.0, 50)]


@pytest.mark.parametrize("buckets", [1, 4])
def test_state_follows_buckets_and_not_users(spark, tmp_path, buckets):
    """Users of a bucket keep apart, over batches; ids are whole beside a null one, and rows without a time are in no spell."""
    kind = "event_id long, user_id long, event_type string, value double, ts timestamp"
    big = (1 << 60) + 1
    batches = [[(1, big, 0), (2, big + 1, 10), (3, None, 5), (4, 8, None)], [(5, big, 20), (6, None, 30), (7, 8, 40)], [(8, 3, 600)]]
    spelled, seen = [], []
    for i, b in enumerate(batches):
        rows = [{"event_id": e, "user_id": u, "event_type": "x", "value": 1.0, "ts": m is not None and str(at(m)).replace(" ", "T") or None} for e, u, m in b]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        with arrivals.settings(spark, arrivals.ROCKSDB):
            spells = state.spells(stream, buckets=buckets)
            waiting(spells, spark, str(tmp_path / "spells"), lambda d, _: spelled.extend((r.user_id, r.n, (r.last - r["first"]) // 60_000_000) for r in d.collect()))
        if i == 1:
            continue
        with arrivals.settings(spark, arrivals.ROCKSDB | arrivals.DATA_ONLY):
            firsts = state.first_seen(stream.filter("ts IS NOT NULL"), buckets=buckets)
            waiting(firsts, spark, str(tmp_path / "seen"), lambda d, _: seen.extend((r.user_id, r.event_id) for r in d.collect()))
    assert sorted(spelled, key=str) == sorted([(big, 2, 20), (big + 1, 1, 0), (None, 2, 25), (8, 1, 0)], key=str)
    assert sorted(seen, key=str) == sorted([(big, 1), (big + 1, 2), (None, 3), (8, 7), (3, 8)], key=str)
