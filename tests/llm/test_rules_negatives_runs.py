"""Line rules, hard negatives and periodic runs against brute force: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import hashlib
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import hardnegatives, linerules, lyndonruns

FOLDER = "/root/testdata/sf0.001"


def views(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}" + ("/*.parquet" if os.path.isdir(f"{folder}/{t}") else "")
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def told(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize(("query", "sql"), [(linerules.op11_line_rules, linerules.OP11_SQL), (hardnegatives.op12_hard_negatives, hardnegatives.OP12_SQL)])
def test_rows_equal_those_of_sql(spark, query, sql):
    got = query(spark, FOLDER)
    want = views(FOLDER).execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert told(got.collect()) == told(want)


# --- line rules


def odd_texts():
    rnd = random.Random(3)
    prose = lambda n: " ".join(rnd.choice(["river", "stone", "a", "the", "of", "light,"]) + str(rnd.randrange(99)) for _ in range(n)) + "."
    menu = "Home | News | About | Contact | Help"
    texts = [
        None, "", " \t\n\n", "one two", prose(30), "\n".join([prose(30), prose(30), menu]), "\n".join([menu] * 9), "\n".join([prose(25), "click here to read more about us.", prose(25)]),
        "LOUD!! WORDS!! ONLY!! HERE!! NOW!!\n" + prose(40), " ".join(["same"] * 50) + ".", "x### y$$$ z%%% " * 12 + ".", prose(10) + "\n" + prose(10) + "\n" + "no mark at all " * 3,
        "Ünïcode « mots » ça va… " * 9, "一 二 三。\n" * 12, "a\x0bb\x0cc\r\nd\x1fe " * 9, prose(8) + " " + prose(8), "same line here.\nsame line here.\n \n \nsame line here. ",
    ]
    eight = prose(8)
    return texts + [f"{eight} {prose(60)} {eight} {prose(40)}", f"{eight} {eight} {eight} {prose(5)}", eight[:-1] + " " + eight]


def test_line_rules_of_odd_texts_equal_sql(spark, tmp_path):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[5], (5, "another text of the same id, with few words.")]
    frame = spark.createDataFrame([(i, t, True, "x", "y") for i, t in rows], "doc_id long, text string, kept boolean, cleaned string, _told string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = linerules.op11_line_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({linerules.OP11_SQL})").fetchall()
    assert told(got.collect()) == told(want)


def test_line_rules_keep_good_lines_and_name_what_failed(spark):
    good = "The river runs past the old mill, and nobody has counted the stones in it since spring came."
    text = f"{good}\nHome | News | About | Contact\n{good}\nAll rights reserved.\nSee the map\n{good} {good} once more."
    rows = spark.createDataFrame([(1, text), (2, "Home | News | About | Contact\n" * 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in linerules.clean_documents(rows).collect()}
    assert got[1].cleaned == f"{good}\n{good}\n{good} {good} once more." and got[1].kept is False and got[1].base_failed is True  # it repeats itself
    assert (got[1].navigation, got[1].boilerplate, got[1].unpunctuated, got[1].symbols) == (1, 1, 1, 0)
    assert got[2].kept is False and got[2].navigation == 20 and got[2].cleaned == ""
    loose = linerules.clean_documents(rows, linerules.Limits(most_repeated=100)).collect()
    assert {r.doc_id: r.kept for r in loose} == {1: True, 2: False}


def test_line_rules_agree_with_labels(spark):
    """On sf0.01: every document of quality 1 with enough words stays, and every one of quality 0 goes."""
    rows = linerules.op11_line_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    found = {(r.quality, r.base_failed, r.kept): r["count"] for r in rows.groupBy("quality", "base_failed", "kept").count().collect()}
    assert found[(1, False, True)] > 300 and (1, False, False) not in found and (0, False, True) not in found


def test_repeated_words_of_long_texts():
    rnd = random.Random(9)
    for n in (0, 7, 8, 9, 40, 3000):
        words = [b"%d" % rnd.randrange(30 if n < 100 else 3000) for _ in range(n)]
        if n >= 40:
            words[n // 2 : n // 2 + 11] = words[3:14]
        seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
        want = {j for i in range(n - 7) for j in range(i, i + 8) if seen[tuple(words[i : i + 8])] > 1}
        assert linerules.repeated_words(words, 8) == len(want)
    long = b"word and more words that go on and on without an end, " * 200_000
    n_words, chars, *_ = linerules.judged(long, linerules.Limits())
    assert n_words == 2_400_000 and chars == len(long) - 2_400_000


def test_line_rules_of_an_empty_table(spark):
    assert linerules.clean_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- hard negatives


def brute_negatives(rows, is_anchor, k=5):
    """rows: (vec_id, label, vector) that take part."""
    ints = {i: (label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows}
    out = []
    for a in filter(is_anchor, ints):
        score = {b: sum(x * y for x, y in zip(ints[a][1], ints[b][1], strict=True)) for b in ints if b != a}
        near = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in near if ints[b][0] == ints[a][0]][:k]:
            fit = [b for b in near if ints[b][0] != ints[a][0] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            out += [(a, p, rank + 1, b, score[p], score[b]) for rank, b in enumerate(fit[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.1, 0.9])
def test_hard_negatives_with_ties_and_unusable_rows(spark, spread, monkeypatch):
    monkeypatch.setattr(hardnegatives, "ANCHORS", 3)
    monkeypatch.setattr(hardnegatives, "ROWS", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.float32(base + spread * rng.normal(size=8))]) for i in range(300)]
    rows += [(300 + i, (rows[i][1] + 1) % 3, rows[i][2]) for i in range(60)]  # ties
    nan, inf = float("nan"), float("inf")
    bad = [(400, None, [1.0] * 8), (None, 1, [1.0] * 8), (420, 1, None), (440, 1, [nan] + [1.0] * 7), (460, 1, [inf] + [1.0] * 7), (480, 1, [None] + [1.0] * 7), (500, 1, [1.0] * 7), (520, 1, []), (540, 1, [1e30] * 8)]
    table = spark.createDataFrame([(i, label, v, "x", 7) for i, label, v in [*rows, *rows[:40], *bad]], "vec_id long, label int, embedding array<double>, slot string, n int")
    small = hardnegatives.Settings(first_rows=100)
    got = hardnegatives.hard_negatives(table, table.filter("vec_id % 20 = 0"), small)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_hard_negatives_of_small_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    cases = [[], [(0, 1, [1.0, 0.5])], [(0, 1, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 2, [0.0, 0.0])], [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [0.9])], [(0, 1, None)]]
    for rows in cases:
        frame = spark.createDataFrame(rows, kind)
        got = hardnegatives.hard_negatives(frame, frame.filter("vec_id % 100 = 0"))
        assert sorted(tuple(r) for r in got.collect()) == brute_negatives([r for r in rows if r[2]], lambda i: i == 0)


def test_sliced_products_are_exact_for_large_components():
    rng = np.random.default_rng(8)
    for top in (1, 300, 1 << 20, 1 << 27):
        x, q = rng.integers(-top, top + 1, (90, 16)), rng.integers(-top, top + 1, (7, 16))
        score = x.astype(object) @ q.T.astype(object)
        low = np.array([int(np.sort(score[:, j])[60]) for j in range(7)])
        high = np.array([int(np.sort(score[:, j])[80]) for j in range(7)])
        i, j, s = hardnegatives.sliced_products(x, q, low, high, np.ones((90, 7), dtype=bool))
        got = set(zip(i.tolist(), j.tolist(), s.tolist(), strict=True))
        want = {(a, b, int(score[a, b])) for a in range(90) for b in range(7) if low[b] <= score[a, b] <= high[b]}
        assert got == want


# --- periodic runs


def brute_runs(w, least_exponent=4, least=6):
    n, out = len(w), []
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            size = i - a + p
            part = w[a : a + size]
            if size >= max(least, least_exponent * p) and not any(part[q:] == part[: size - q] for q in range(1, p)):
                out.append((a, size, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force_on_short_and_periodic_sequences():
    for bits in range(1 << 11):
        s = [bits >> i & 1 for i in range(11)]
        assert lyndonruns.runs_of(s, 2, 2) == brute_runs(s, 2, 2)
    rnd = random.Random(2)
    for _ in range(1500):
        n, kinds = rnd.randrange(1, 90), rnd.choice((1, 2, 3, 9))
        s = [rnd.randrange(kinds) for _ in range(n)]
        a, p = rnd.randrange(n), rnd.randrange(1, 12)
        for i in range(a + p, n):
            s[i] = s[i - p]
        for least_exponent, least in ((2, 2), (3, 6), (4, 6)):
            assert lyndonruns.runs_of(s, least_exponent, least) == brute_runs(s, least_exponent, least)


def test_runs_reuse_what_was_matched():
    """Symbols compared grow in proportion to the text, on texts that are all repetition."""

    class Told(int):
        count = 0

        def __eq__(self, other):
            Told.count += 1
            return int(self) == int(other)

        def __gt__(self, other):
            Told.count += 1
            return int(self) > int(other)

        __hash__ = int.__hash__

    fib, last = [0], [1]
    while len(fib) < 20000:
        fib, last = fib + last, fib
    for s in ([0] * 20000, [0, 1] * 10000, fib, [i.bit_count() & 1 for i in range(20000)], ([0] * 140 + [1]) * 140, list(range(500)) * 40):
        Told.count = 0
        lyndonruns.lyndon_pairs([Told(x + 1) for x in s] + [Told(0)], 4)
        assert Told.count < 14 * len(s)


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for a, size, p in runs for i in range(a + p, a + size)}
    digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode(), b" ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)


def test_periodic_runs_of_documents(spark, tmp_path):
    rnd = random.Random(6)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "a a a a a", "x " * 40 + "y " * 40, "a b " * 9 + "a", "ä b c ä b c " * 5, "p q r " * 4 + "p q r s " * 4, "A a " * 7]
    for _ in range(150):
        n = rnd.randrange(1, 160)
        texts.append(" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(n)))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "z " * 9), (None, None), (21, texts[7]), (21, texts[7])]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t and i is not None) > 8
    frame = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, _text int")
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = lyndonruns.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert told(got) == told(brute_row(i, t) for i, t in rows)


def test_periodic_runs_give_spans_and_texts(spark):
    rows = spark.createDataFrame([(1, "so on and on and on and on and on then stop", "x")], "doc_id long, text string, collapsed string")
    got = lyndonruns.periodic_runs(rows, keep=("doc_id",)).first()
    assert [tuple(r) for r in got.runs] == [(1, 9, 2)] and got.collapsed == "so on and then stop"
    assert lyndonruns.periodic_runs(rows.limit(0)).collect() == []


def test_periodic_runs_of_a_very_long_text(spark):
    """A text of 1.8 MB that is one loop, and one with a word repeated 300,000 times."""
    loop = " ".join(f"w{i}" for i in range(1000))
    rows = spark.createDataFrame([(1, f"{loop} " * 300), (2, "no " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in lyndonruns.periodic_runs(rows).withColumn("size", F.length("collapsed")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 1000)] and got[1].collapsed == loop
    assert [tuple(r) for r in got[2].runs] == [(0, 300_000, 1)] and got[2].size == 2
