"""Score metrics against all pairs, inequality counts against all pairs, transposed rows."""

import math
import random

from pyspark.sql import functions as F

from tidewheel.operators import aggregates, metrics, ranges
from tidewheel.plans.catalog import QUERIES


def brute(rows):
    pos, neg = [s for s, l in rows if l == 1], [s for s, l in rows if l == 0]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    best, precise = None, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        precise += pos.count(t) * tp / (tp + fp)
        f1 = 2 * tp / (tp + fp + len(pos)) if pos else None
        if f1 is not None and (best is None or f1 > best[0]):
            best = (f1, t, (tp + len(neg) - fp) / len(rows))
    return {"n": len(rows), "positives": len(pos), "auc": auc, "average_precision": precise / len(pos) if pos else None, **dict(zip(("best_f1", "best_score", "accuracy"), best or (None,) * 3))}


def test_metrics_equal_those_over_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.randrange(6 if g == "ties" else 10_001), int(rnd.random() < p)) for g, p in (("ties", 0.5), ("wide", 0.2), ("ones", 1), ("none", 0), (None, 0.5)) for _ in range(120)]
    odd = [("wide", None, 1), ("wide", 10_001, 1), ("wide", -1, 0), ("wide", 5, None), ("wide", 5, 2), ("unlabelled", 5, None)]
    got = metrics.metrics(metrics.counted(spark.createDataFrame(rows + odd, "src string, mark int, l int"), "src", "mark", "l")).collect()
    assert {r["g"] for r in got} == {"ties", "wide", "ones", "none", None}
    for r in got:
        for name, want in brute([(s, l) for g, s, l in rows if g == r["g"]]).items():
            assert r[name] == want or math.isclose(r[name], want, rel_tol=1e-12), (r["g"], name)
    empty = spark.createDataFrame([], "src string, mark int, l int")
    assert metrics.metrics(metrics.counted(empty, "src", "mark", "l")).count() == 0


def test_counts_of_smaller_values(spark):
    rnd = random.Random(5)
    xs = [rnd.choice([rnd.randrange(20) / 2, 3.0, -0.0, None, float("inf"), float("-inf"), float("nan")]) for _ in range(300)]
    ys = [rnd.choice([rnd.randrange(20) / 2, 3.0, 0.0, None, float("nan")]) for _ in range(500)] + [3.0] * 400

    def less(a, b):  # NaN is the largest
        return not math.isnan(a) and (math.isnan(b) or a < b)

    asked = spark.createDataFrame(list(enumerate(xs)), "v int, x double")
    rows = spark.createDataFrame([(y,) for y in ys], "n double")
    for parts in (1, 7):
        got = {r["v"]: r["below"] for r in ranges.count_smaller(asked, "x", rows, "n", "below", parts).collect()}
        assert got == {i: None if x is None else sum(y is not None and less(y, x) for y in ys) for i, x in enumerate(xs)}
    none = ranges.count_smaller(asked, "x", rows.limit(0), "n", "below")
    assert {r["below"] for r in none.collect()} == {0, None} and ranges.count_smaller(asked.limit(0), "x", rows, "n", "below").count() == 0


def test_counts_of_smaller_values_in_groups(spark):
    """Groups of one row, of most rows, of one side only and null ones; a join by group alone would meet every pair of a group."""
    rnd = random.Random(6)
    groups = [1] * 20 + [2, 3, 4, None]
    asked = [(i, rnd.choice(groups), rnd.choice([rnd.randrange(9) / 2, None])) for i in range(200)] + [(200, 77, 1.0)]
    rows = [(rnd.choice([*groups, 9]), rnd.choice([rnd.randrange(9) / 2, None])) for _ in range(400)]
    for parts in (1, 7):
        found = ranges.count_smaller(spark.createDataFrame(asked, "i int, k int, x double"), "x", spark.createDataFrame(rows, "g int, y double"), "y", "below", parts, by=("k", "g"))
        want = {i: None if g is None or x is None else sum(h == g and y is not None and y < x for h, y in rows) for i, g, x in asked}
        assert {r["i"]: r["below"] for r in found.collect()} == want


def test_theta_meets_no_pairs(spark):
    """The plan joins by value, not by nation alone."""
    plan = QUERIES["join_theta"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "_v#" in plan


def test_no_task_takes_more_than_its_ranges(spark):
    """A value that a third of all rows have is one row when ranges are dealt, and no plan joins without an equality."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.col("id").cast("double")).alias("x"))
    found = ranges.count_smaller(rows, "x", rows, "x", "below", 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 30_000 and found.filter("x = 7.5").distinct().count() == 1


def test_transposed_rows(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 4.0), ("other", 9.0, 9.0)], "k string, x double, y double")
    got = {r["measure"]: (r["a"], r["b"], r["c"]) for r in aggregates.transposed(rows, "k", ["a", "b", "c"]).collect()}
    assert got == {"x": (1.0, None, None), "y": (2.0, 4.0, None)}
    back = aggregates.transposed(aggregates.transposed(rows, "k", ["a", "b"]), "measure", ["x", "y"])
    assert sorted(tuple(r) for r in back.withColumnRenamed("measure", "k").fillna(-1.0).collect()) == [("a", 1.0, 2.0), ("b", -1.0, 4.0)]


def test_a_score_is_worked_out_once_a_row(spark):
    """Filters and projections of a plan don't repeat its expression; letters outside a to z, marks and pairs of code units count as one character each."""
    for name in ("score_metrics", "score_curve"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1, name
    texts = ["", None, "abc", "a b\nc", "é\U0001f600ab", "...", " ", "Straße 9 x", "a.b.c"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(metrics.plain_share(F.col("t")).alias("s")).collect()]
    assert got == [len([c for c in t if c == " " or c.isascii() and c.isalpha()]) * 10_000 // len(t) if t else 0 for t in texts]
