"""Small tables with nulls, empty and repeated rows, ties and extra columns, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import crosspolytope, jaccard, licences, mixing, quality, repeats, scratch, sentencepieces, textblocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


def sample_texts(seed=5, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    rows = [(0, None, "a"), (1, "", "b"), (2, "one two", None), (3, " \t\n", "a")]
    for i in range(4, n):
        kind = rnd.random()
        if kind < 0.25 and i > 8:
            words = (rows[rnd.randrange(4, i)][1] or "").split()
            words[rnd.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif kind < 0.45:
            text = " ".join(rnd.choice(vocab) for _ in range(20)) + " " + passage + " " + " ".join(rnd.choice(vocab) for _ in range(15))
        else:
            text = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(30, 300)))
        rows.append((i, text, rnd.choice(["a", "b", "c", None])))
    return rows + [rows[6], rows[7]]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_jaccard_components(spark):
    rows = sample_texts()
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() for x in words_of(t)]
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = jaccard.jaccard_components(make_docs(spark, rows), n=3, num=90, den=100).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), root[i]) for i in sets}


def test_jaccard_links_null_and_repeated_ids_by_their_sets(spark):
    """A null id links two texts; the second text of an id keeps its own component, and stays in the pipeline."""
    import corpus_pipeline

    w = [f"w{i}" for i in range(100)]
    far = " ".join(f"x{i}" for i in range(100))
    texts = [" ".join(w), " ".join([*w[:94], *"abcdef"]), " ".join([*w[:88], *"ghijkl", *"abcdef"])]
    rows = [(5, texts[0], "a"), (None, texts[1], "a"), (9, texts[2], "a"), (9, far, "a"), (None, far + " y", "a"), (None, None, "a"), (None, "alone here", "a")]
    got = jaccard.jaccard_components(make_docs(spark, rows), n=5, num=80, den=100).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(5, 96, 5), (None, 96, 5), (9, 96, 5), (9, 96, 9), (None, 97, 9), (None, 0, None), (None, 1, None)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = corpus_pipeline.keep_one_of_alike(spark, make_docs(spark, rows), "").filter("doc_id IS NOT NULL").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, texts[0]), (9, far)]


@pytest.mark.parametrize("texts", [[None, ""], ["a b c", "a b c", "d"], [None], ["one two", None, "a b", "A B"]])
def test_jaccard_of_short_and_missing_texts(spark, texts):
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make_docs(spark, rows), n=3, num=90, den=100).collect()}
    seen = {}
    for i, t, _ in rows:
        key = (t or "").lower()
        assert got[i] == (int(bool(key)), seen.setdefault(key, i) if key else i)


def test_jaccard_of_files_without_any_set(spark, tmp_path):
    """A file of short texts beside one of ordinary texts: batches without signatures or shared n-grams."""
    rows = [r for r in sample_texts(8, 30) if r[0] > 3]
    make_docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/t")
    make_docs(spark, [(900, "one two", "a"), (901, None, "a")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert jaccard.jaccard_components(spark.read.parquet(f"{tmp_path}/t")).count() == len(rows) + 2


def brute_links(sets, num, den):
    return {(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def partition(n, links):
    root = list(range(n))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("num", [60, 80, 90])
def test_search_spans_all_components(num):
    """Near copies, chains of them and sets that share much without linking."""
    rnd = random.Random(num)
    sets = []
    for _ in range(12):
        base = rnd.sample(range(600), rnd.randrange(1, 80))
        for _ in range(rnd.randrange(1, 9)):
            base = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 10)):
                base[rnd.randrange(len(base))] = rnd.randrange(600)
            sets.append(set(base))
    arrays = [np.array(sorted(s), dtype=np.int64) for s in sets]
    links = jaccard.search(arrays, np.array([len(s) for s in sets]), num, 100)
    assert set((max(x), min(x)) for x in links) <= brute_links(sets, num, 100)
    assert partition(len(sets), links) == partition(len(sets), brute_links(sets, num, 100))


@pytest.mark.parametrize("cell", [40, 400])
def test_jaccard_of_classes_larger_than_a_cell(spark, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_NGRAMS", cell)
    test_jaccard_components(spark)


def test_unequal_words_have_unequal_hashes():
    """Words that collide under any polynomial modulo 2**64, in two seeds, and words in blocks of any size."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}".encode(), np.uint8)
    words = textblocks.Words(data, np.array([0, len(data)]))
    for seed in (0, 1):
        a, b, c = words.hashes(seed).tolist()
        assert a == c != b
    assert words.hashes(0)[0] != words.hashes(1)[0]


def test_heap_merge_finds_all_that_reach_the_overlap():
    rnd = random.Random(3)
    for _ in range(100):
        lists = [sorted(rnd.sample(range(30), rnd.randrange(0, 20))) for _ in range(8)]
        for need in (1, 3, 6):
            counts = {d: sum(d in x for x in lists) for d in range(30)}
            assert sorted(jaccard.heap_merge(lists, need)) == sorted((d, c) for d, c in counts.items() if c >= need)


def brute_dedup(rows, k=13):
    first = {}
    for i, t, _ in rows:
        w = words_of(t)
        for j in range(len(w) - k + 1):
            key, own = tuple(w[j : j + k]), 2**63 if i is None else i
            first[key] = min(first.get(key, own), own)
    out = []
    for i, t, _ in rows:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (2**63 if i is None else i):
                gone |= set(range(j, j + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("unit", [2000, 8 << 20])
def test_substring_dedup(spark, unit):
    rows = sample_texts(9)
    rows += [(None, rows[20][1], "a"), (30, rows[21][1], "a"), (99, ("r s t " * 3000).strip(), "a"), (100, ("r s t " * 50).strip(), "a")]
    long = " ".join(f"x{i % 70000}" for i in range(200_000))  # over a block, and it repeats itself
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows += [(200, long, "a"), (201, f"{long[:300_000]} {prose(20, 1)} {long[500_000:900_000]}", "a")]
    # words that collide under a polynomial hash
    rows += [(202 + i, " ".join(f"y{j}" for j in range(6)) + f" {w} " + " ".join(f"z{j}" for j in range(6)), "a") for i, w in enumerate((word, word.translate(str.maketrans("ab", "ba"))))]
    got = repeats.substring_dedup(make_docs(spark, rows).repartition(3), unit=unit)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_dedup(rows), key=key)


@pytest.mark.parametrize("heavy", [0, 40])
def test_substring_dedup_with_heavy_minimizers(spark, heavy):
    """Whether all minimizers are heavy or a few: rows as by brute force. Units are small, so that texts meet in buckets."""
    rows = sample_texts(19)
    rnd = random.Random(8)
    phrase = "an eight word phrase that all texts hold"
    rows += [(300 + i, f"{prose(12, i)} {phrase} {prose(12, 1000 + i % 50 + rnd.randrange(2))}", "a") for i in range(200)]
    rows += [(400 + i, rows[-i - 1][1], "a") for i in range(5)]
    got = repeats.substring_dedup(make_docs(spark, rows).repartition(3), unit=3000, heavy=heavy)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_dedup(rows), key=key)


def test_edges_of_a_heavy_phrase_spread_over_buckets(spark):
    """A phrase in 2,000 texts with other words around it: the minimizers inside it are heavy, and each edge goes by its own hash."""
    least = lambda x: textblocks.ngrams(textblocks.Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])).hashes(), 8, salt=1)[0]
    phrase = min((f"an eight word phrase that all texts hold{j}" for j in range(40)), key=least)  # one that minimizers fall on
    rows = [(i, f"{prose(12, i)} {phrase} {prose(12, 5000 + i)}", "a") for i in range(2000)]
    docs = make_docs(spark, rows).select(F.col("doc_id").alias("told"), "text")
    sigs = repeats._sigs(repeats._shared(docs, 13, 8, 16, 20_000, 1000)).cache()
    heavy = {x for r in sigs.collect() for x in r.heavy}
    assert heavy == {int(least(phrase).view(np.int64))}
    under = 0
    for _, text, _ in rows:
        e = repeats.Edges(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 13, 8)
        under += least(phrase) in e.least[e.valid]
    assert under > 1900 and sigs.filter(F.size("heavy") > 0).count() == under
    assert repeats._sigs(repeats._shared(docs, 13, 8, 16, 20_000, 20_000)).filter(F.size("heavy") > 0).count() == 0


def test_nearest_recall_and_bad_vectors(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(1500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[10:14] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 64), (2100, [float("nan")] * 64), (2200, [None] * 64), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = crosspolytope.nearest(df, df.filter("vec_id % 100 == 0")).collect()
    x = x.astype(np.float64)
    found = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in mine) and mine == sorted(mine, key=lambda r: (r[2], r[1]))
        found += sum(s <= np.sort(d)[9] for _, _, s in mine)
    assert found >= 0.9 * 150 and len(got) == 150


def test_nearest_takes_its_length_from_usable_vectors(spark):
    """Three vectors of NaN, longer than the two good ones, don't decide which length takes part; other columns may have any name."""
    nan = float("nan")
    rows = [(i, [nan] * 3, 1.0) for i in (1, 2, 3)] + [(4, None, 1.0), (5, [0.0] * 3, 1.0), (100, [1.0, 0.0], 1.0), (7, [0.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").withColumn("query_id", F.lit(5)).withColumn("v", F.lit("x"))
    got = crosspolytope.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 7, 2**0.5)]


@pytest.mark.parametrize("n", [5, 12, 20])
def test_nearest_of_small_tables_are_whole(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = crosspolytope.nearest(df, df).collect()
    for q in range(n):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == min(10, n - 1)
        if n <= 12:
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            assert [d[v] for v in mine] == sorted(d[v] for v in mine)


def test_licences_are_named_and_ordinary_text_is_left_alone(spark):
    plain = [(i, f"The river number {i} runs to the sea.\nA licensed driver stopped here {i} times.", "a") for i in range(40)]
    rows = [*plain, (50, None, "a"), (51, "", "a"), (52, "x\nLicensed under the Apache License, Version 2.0.\ny", "a"), (53, "Released under the MIT License.", "a")]
    got = licences.scan(make_docs(spark, rows)).filter("family <> 'unknown'").collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == {(52, 1, "apache-2.0"), (53, 0, "mit")}


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("the river runs to sea and old stone bridge was seen by many people in winter when water is high".split()) for _ in range(n))


def test_licences_inside_long_and_wrapped_lines_are_found(spark):
    """A statement in a line of any length, over a line break, and two of them far apart in one line."""
    apache, gpl = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    long = [(100 + n, f"{prose(n // 2, n)} {apache} {prose(n - n // 2, n + 1)}", "a") for n in (20, 40, 80, 160, 400)]
    wrapped = (200, f"{prose(60, 2)} This work is licensed under the GNU\nGeneral Public License, version 3. {prose(60, 3)}", "a")
    two = (300, f"{prose(50, 4)} {apache} {prose(70, 5)} {gpl} {prose(50, 6)}", "a")
    plain = [(i, prose(20 + 5 * i, 1000 + i), "a") for i in range(40)]
    got = licences.scan(make_docs(spark, [*plain, *long, wrapped, two, two])).filter("family <> 'unknown'").collect()
    want = [(r[0], 0, "apache-2.0") for r in long] + [(200, 0, "gpl")] + [(300, 0, "apache-2.0"), (300, 0, "gpl")] * 2
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == sorted(want)


def test_other_licences_and_denials_are_not_confirmed(spark):
    """Names and versions must match, wrapped headers are found, licences that no family has aren't named."""
    other = [
        "This work is licensed under the Eclipse Public License 2.0.",
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under CC BY-ND 4.0.",
        "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "This is not licensed under the MIT License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ]
    known = [
        ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"),
        ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"),
        ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
        ("cc-by", "Licensed under CC BY 4.0."),
    ]
    rows = [(i, prose(20 + 5 * i, 50 + i), "a") for i in range(40)]
    rows += [(100 + i, t, "a") for i, t in enumerate(other)] + [(200 + i, t, "a") for i, (_, t) in enumerate(known)]
    got = {(r.doc_id, r.family) for r in licences.scan(make_docs(spark, rows)).collect() if r.family != "unknown"}
    assert got == {(200 + i, f) for i, (f, _) in enumerate(known)}


def test_unknown_licences_dont_depend_on_the_size_of_the_table(spark):
    """The same statements give the same rows among few and many ordinary lines, and a model keeps its threshold; ordinary lines aren't called unknown."""
    stated = [(5000 + i, f"License: MIT, package number {i}.", "a") for i in range(60)]
    found = {}
    for n in (0, 700, 6000):
        rows = [(i, prose(12, i), "a") for i in range(n)] + stated + [(9000, "Released under the MIT License.", "a")]
        got = licences.scan(make_docs(spark, rows)).collect()
        assert [r.doc_id for r in got if r.family != "unknown"] == [9000]
        found[n] = {r.doc_id for r in got if r.family == "unknown"}
    assert found[0] == found[700] == found[6000] == {r[0] for r in stated}
    assert licences.edge({9: 3, 5: 2, 1: 4}, 10, 5) == 0.2 and licences.edge({9: 3, 5: 2}, 10, 2) == 1.0 and licences.edge({}, 10, 2) == 0.0


def test_licences_are_learned_from_all_ordinary_lines(spark, monkeypatch):
    """Each window of each ordinary line is learned from, long and repeated lines too, none of a line about licences; the threshold is counted over all of those lines."""
    rnd, asked, told = random.Random(9), {}, {}
    lines = [[prose(rnd.choice([3, 12, 31, 32, 33, 200]), rnd.randrange(900)) for _ in range(rnd.randrange(1, 9))] for _ in range(900)]
    rows = [(i, "\n".join(x), "a") for i, x in enumerate(lines)]
    rows += [(2000 + i, f"{prose(40, i)}\nAll permissions are kept.\n{prose(5, i)}", "a") for i in range(30)]
    fit, calibrate = licences.LogisticRegression.fit, licences.Classifier.calibrate

    def fitted(self, seen):
        asked.update({r.label == 0: r.w for r in seen.groupBy(F.col("label") == 0).agg(F.first("label").alias("label"), F.sum("weight").alias("w")).collect()})
        return fit(self, seen)

    def calibrated(self, found, lines):
        told["lines"] = lines
        return calibrate(self, found, lines)

    def learned(self, kinds, s=licences.Settings()):
        told["windows"] = kinds.filter("common").agg(F.sum("n")).first()[0]
        init(self, kinds, s)

    init = licences.Classifier.__init__
    monkeypatch.setattr(licences.LogisticRegression, "fit", fitted)
    monkeypatch.setattr(licences.Classifier, "calibrate", calibrated)
    monkeypatch.setattr(licences.Classifier, "__init__", learned)
    assert licences.scan(make_docs(spark, rows)).filter("family <> 'unknown'").collect() == []
    of = lambda n: 1 + max(0, -(-(n - 32) // 16))
    inner = sum(of(len(x.split())) for own in lines for x in own) + 30 * (of(40) + of(5))
    assert told == {"lines": sum(map(len, lines)) + 60, "windows": inner + sum(len(own) - 1 for own in lines)}
    known = sum(len(ts) for ts in licences.TEMPLATES.values()) * len(licences.FRAMES)
    decoys = 4 * len(licences.DECOYS)
    assert asked[True] == pytest.approx(licences.WEIGHT * (1 + decoys / (known + decoys))) and asked[False] == pytest.approx(licences.WEIGHT * (1 + known / (known + decoys)))


def test_licences_of_empty_tables_and_clashing_names(spark):
    assert licences.scan(make_docs(spark, [])).collect() == []
    assert licences.scan(make_docs(spark, [(1, None, "a"), (None, "", "a")])).collect() == []
    rows = make_docs(spark, [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (None, "Released under the MIT License.", "a")])
    clashing = rows.selectExpr("doc_id", "text", "1 AS row", "'x' AS family", "2 AS paragraph", "3.0 AS score", "4 AS at", "5 AS lines")
    assert sorted(str((r.doc_id, r.paragraph, r.family)) for r in licences.scan(clashing).collect()) == ["(1, 0, 'mit')"] * 2 + ["(None, 0, 'mit')"]


def brute_mix(rows):
    """Words taken of each row: targets by weight, whole epochs, then documents in the order of their keys."""
    import hashlib
    import math

    size = [len(words_of(t)) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    left, open_, target = 1.5 * sum(own.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * own[s]}
        for s in over or open_:
            target[s] = 2.0 * own[s] if over else level * weight[s]
            left -= target[s] if over else 0
        open_ = open_ - over if over else set()

    def key(i, t):
        u = (int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / (max(0.05, sum(c not in mixing.SYMBOLS for c in t) / len(t)) if t else 0.05)

    taken = [0] * len(rows)
    for s in names:
        epochs, rest = divmod(math.floor(target[s] + 0.5), own[s]) if own[s] else (0, 0)
        order = [k for k, r in enumerate(rows) if r[2] == s]
        for k in sorted(order, key=lambda k: (key(*rows[k][:2]), rows[k][0] is not None, rows[k][0] or 0, size[k])):
            part = min(size[k], rest)
            rest -= part
            taken[k] = epochs * size[k] + part
    return taken


def test_mix_takes_smallest_keys_first(spark):
    """Rows against a brute-force version: whole epochs, then keys in order, with weights far apart and one source of most rows."""
    rnd = random.Random(2)
    rows = [(i, " ".join("x#$|"[rnd.random() < 0.5 :][:1] * 4 for _ in range(rnd.randrange(0, 30))) or None, rnd.choice([*"aaaaaab", None])) for i in range(400)]
    got = mixing.mix(make_docs(spark, rows), bucket_rows=9)
    assert {r.doc_id: r.taken for r in got.collect()} == dict(enumerate(brute_mix(rows)))


def test_mix_meets_targets(spark):
    docs = make_docs(spark, sample_texts(11))
    got = mixing.mix(docs)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect():
        assert abs(r.t - r.w) <= 1
    assert got.filter("taken > 2 * size").count() == 0


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    texts = ["", "Hello  world", "naïve 漢字 🙂\n\ttabs ", " lead", "a" * 500]
    docs = make_docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(9, None, "a")])
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepieces.encode_documents(docs, with_ids=True, with_text=True).collect()}
    m = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    for i, t in [*enumerate(texts), (9, "")]:
        assert got[i] == (m.encode(t), m.decode(m.encode(t)))


class Wrong:
    """The library, but for one method."""

    def __init__(self, library, name, answer):
        self.library, self.name, self.answer = library, name, answer

    def __getattr__(self, name):
        return self.answer if name == self.name else getattr(self.library, name)


def test_pieces_are_compared_with_the_library_both_ways():
    """A library that answers otherwise is an error: segment by segment, and by whole texts where the normaliser isn't known as plain."""
    texts = ["The ﬁne river  runs, and Ａ bridge é stands. ", "", "stones and rivers"]
    for plain in (True, False):
        v = sentencepieces.Vocabulary(sentencepieces.default_model())
        assert v.plain_text
        v.plain_text, m = plain, v.library
        for t, (n, ids, text) in zip(texts, v.encode_batch(texts), strict=True):
            assert [int(x) for x in ids.split(b",") if x] == m.encode(t) and text.decode() == m.decode(m.encode(t)) and n == len(m.encode(t))
        for name, answer in (("encode", lambda x, **_: [0] if isinstance(x, str) else [[0]] * len(x)), ("decode", lambda x: "?" if x and isinstance(x[0], int) else ["?"] * len(x))):
            v = sentencepieces.Vocabulary(sentencepieces.default_model())
            v.plain_text, v.library = plain, Wrong(m, name, answer)
            with pytest.raises(ValueError, match="differ"):
                v.encode_batch(texts)


def test_pieces_of_marks_and_spaces_and_what_the_cache_holds():
    """Marks in a text, runs of spaces and a zero character are as the library has them; a segment that decodes to itself is kept as its ids only."""
    v = sentencepieces.Vocabulary(sentencepieces.default_model())
    texts = [" ", "   ", "a▁b ▁ c", "▁▁x", "stone  bridge ", "a\0b c", "🙂▁🙂", "\ue000 x", "über die Brücke", "\n \n"]
    for _ in range(2):
        for t, (n, ids, text) in zip(texts, v.encode_batch(texts), strict=True):
            want = v.library.encode(t)
            assert ([int(x) for x in ids.split(b",") if x], text.decode(), n) == (want, v.library.decode(want), len(want)), t
    assert isinstance(v.seen[" Brücke"], bytes) and isinstance(v.seen["  bridge"], bytes)


def test_a_worker_lets_go_of_the_cache_at_a_task_of_another_operator(spark):
    """Segments stay from task to task of the encoding; any other operator's task in that worker finds the cache empty, and ends with it so."""
    path = sentencepieces.default_model()
    v = sentencepieces.vocabulary(path)
    v.encode_batch(["some words"])
    assert list(scratch.trimmed(lambda batches: batches, keeps="sentencepieces")([1])) == [1] and sentencepieces.vocabulary(path) is v
    assert list(scratch.trimmed(lambda batches: batches)([2])) == [2] and sentencepieces.vocabulary.cache_info().currsize == 0

    def probe(batches):
        import pyarrow as pa

        from tidewheel.llm import sentencepieces

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sentencepieces.vocabulary.cache_info().currsize] * b.num_rows, pa.int64())], ["kept"])

    docs = make_docs(spark, [(i, prose(8, i), "a") for i in range(64)]).repartition(16)
    assert sentencepieces.encode_documents(docs).count() == 64
    kept = docs.select("doc_id").mapInArrow(scratch.trimmed(probe), "kept long").collect()
    assert len(kept) == 64 and {r.kept for r in kept} == {0}


def test_a_smaller_cache_holds_less_and_tells_the_same_pieces(spark, monkeypatch):
    """The pipeline's encoding keeps no more in a worker than its own bounds, whatever another encoding left there, and its rows are those of the large cache."""
    import corpus_pipeline

    v = sentencepieces.Vocabulary(sentencepieces.default_model())
    v.encode_batch([" ".join(f"w{i}" for i in range(100))])
    v.hold(50)
    assert v.seen and v.most == 50
    v.hold(40)
    assert not v.seen and not v.older

    def probe(batches):
        import pyarrow as pa

        from tidewheel.llm import sentencepieces

        for b in batches:
            v = sentencepieces.vocabulary(sentencepieces.default_model())
            yield pa.RecordBatch.from_arrays([pa.array([len(v.seen) + len(v.older)] * b.num_rows, pa.int64())], ["kept"])

    assert corpus_pipeline.CACHE < sentencepieces.CACHE
    monkeypatch.setattr(corpus_pipeline, "CACHE", 50)
    monkeypatch.setattr(corpus_pipeline, "BLOCK_CHARS", 200)
    docs = make_docs(spark, [(i, " ".join(f"w{i}x{k}" for k in range(40)), "a") for i in range(64)]).repartition(16)
    want = sorted(sentencepieces.encode_documents(docs, with_ids=True).collect())
    assert sorted(corpus_pipeline.encode(spark, docs, "").collect()) == want and len(want) == 64
    kept = docs.select("doc_id").mapInArrow(scratch.trimmed(probe, keeps="sentencepieces"), "kept long").collect()
    # a generation ends after the block that fills it, of one text of 40 segments here
    assert len(kept) == 64 and max(r.kept for r in kept) <= 2 * (50 + 40)


def test_quality_learns_and_scores_empty_texts(spark):
    rows = [(i, ("good words flow along here " if i % 2 else "@@## $$ 11 %% ") * 5, "a") for i in range(200)] + [(900, None, "a"), (901, "", "a")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = make_docs(spark, rows)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(200)) and got[900] == got[901] and len(got) == 202


def test_quality_doesnt_depend_on_order_or_repeats(spark):
    """Repeated rows, several texts of an id and labels without a document leave the weights as they are."""
    rows = [(i % 50, f"{'good' if i % 2 else '## $$'} {prose(8, i)}", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    some = quality.Settings(max_rows=30, bits=12)
    one = quality.train(make_docs(spark, rows), labels, some)
    two = quality.train(make_docs(spark, [*rows[::-1], *rows]).repartition(5), labels.repartition(3), some)
    assert np.array_equal(one, two) and np.abs(one).sum() > 0


def test_quality_of_held_out_labels(spark):
    """The labels that no learning saw are told right."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op10_quality(spark, folder).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(got) > 50 and sum((r.score >= 0.5) == r.quality for r in got) >= 0.97 * len(got) and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert docs.count() == quality.op10_quality(spark, folder).count()


def test_empty_tables(spark):
    docs = make_docs(spark, [])
    assert jaccard.jaccard_components(docs).count() == 0
    assert repeats.substring_dedup(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert crosspolytope.nearest(none, none).count() == 0


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def brute_quality(rows, weights):
    """Scores as sums over the features that learning sees, a text at a time."""
    s = quality.Settings()
    out = []
    for r in rows:
        ((at, x),) = quality.examples(quality.pa.array([r[1]], quality.pa.string()), s)
        dot = sum(float(weights[k]) * float(v) for k, v in zip(at, x, strict=True)) + float(weights[-1])
        out += [r] * int(1 / (1 + np.exp(-dot)) >= 0.5)
    return out


def brute_alike(rows):
    """One row of each group that Jaccard 0.8 on five-word shingles links: that of the smallest id."""
    sets = []
    for r in rows:
        w = [x.lower() for x in words_of(r[1])]
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = partition(len(rows), {(i, j) for i, j in brute_links(sets, 80, 100) if sets[i] and sets[j]})
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[root[k]] = min(low.get(root[k], r[0]), r[0])
    kept = [r for k, r in enumerate(rows) if r[0] is None or not sets[k] or low[root[k]] == r[0]]
    return list({(r[0], r[1]): r for r in reversed(kept)}.values())


def brute_cut(rows):
    told = brute_dedup([(r[0], r[1], None) for r in rows])
    return [(r[0], kept, *r[2:4], len(kept), *r[5:]) if gone else r for r, (_, _, gone, kept) in zip(rows, told, strict=True)]


def brute_copies(rows):
    groups, out = {}, []
    key = lambda r: (r[0], r[3], len(words_of(r[1])))
    for r, n in zip(rows, brute_mix([(r[0], r[1], r[3]) for r in rows]), strict=True):
        groups.setdefault(key(r), []).append(n)
    for r in rows:
        w, left = words_of(r[1]), sum(groups[key(r)]) // len(groups[key(r)])
        while left > 0:
            part = " ".join(w[:left])
            out.append(r if left >= len(w) else (r[0], part, *r[2:4], len(part), *r[5:]))
            left -= len(w)
    return out


def brute_ids(rows):
    import hashlib

    import sentencepiece

    m, out = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model()), []
    for r in rows:
        ids = m.encode(r[1] or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), m.decode(ids) if ids else "")]
        out.append((r[0], len(ids), *digests, ids))
    return out


def pipeline_rows():
    """Good and bad texts, near and exact copies, shared passages; nulls, empty texts, ids and rows that repeat."""
    rows = sample_texts(21) + [(i, "@@## $$ 11 %% " * (i - 290), "b") for i in range(300, 320)]
    rows += [(None, rows[9][1], "a"), (12, "another text of the id twelve", "c"), (330, rows[10][1] + " é🙂", None), (331, rows[10][1], "b")]
    # a source of which less than an epoch is taken, with rows equal in id and size
    rows += [(400 + i // 2, prose(20, 70 + i // 2), "b") for i in range(40)]
    return rows


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "repeated_passages", "source_mix", "token_ids"])
def test_pipeline_stages_equal_brute_force(spark, tmp_path, name):
    """The rows of each stage, with columns of clashing names, and those of empty tables and of nulls only."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]
    stage = dict(corpus_pipeline.STAGES)[name]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(420)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def brute(docs, rows):
        if name == "quality":
            return brute_quality(rows, quality.train(docs, labels))
        return {"near_duplicates": brute_alike, "repeated_passages": brute_cut, "source_mix": brute_copies, "token_ids": brute_ids}[name](rows)

    for rows in (pipeline_rows(), [], [(None, None, None), (1, None, None), (2, "", "a")]):
        docs = make_docs(spark, rows)
        for clash in ("taken", "score", "component_id", "h1", "kept", "ids"):
            docs = docs.withColumn(clash, F.lit(clash))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        got = stage(spark, docs, str(tmp_path))
        if name != "token_ids":
            assert got.columns == docs.columns
        want = brute(docs, [tuple(r) for r in docs.collect()])
        assert ordered(got.collect()) == ordered(want)
        if name == "quality" and len(rows) > 3:
            assert len(want) < len(rows)


def test_equal_rows_share_what_they_take(spark):
    """Ten rows equal in id and size take 83 words, the last of them none: each gets 8."""
    import corpus_pipeline

    words = " ".join("abcdefghij")
    rows = [(i, words, "a" if i < 10 else "c") for i in range(20)] + [(50, words, "b")] * 10
    got = corpus_pipeline.mix_sources(spark, make_docs(spark, rows), "").filter("source = 'b'").collect()
    assert [r.text for r in got] == [" ".join("abcdefgh")] * 10


def test_pipeline_runs_all_stages(spark, tmp_path):
    """run() on whole files gives the ids of the texts that the stages, each by brute force, leave."""
    import corpus_pipeline

    make_docs(spark, pipeline_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 330), 0) for i in range(420)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = brute_quality([tuple(r) for r in docs.collect()], quality.train(docs, labels))
    for brute in (brute_alike, brute_cut, brute_copies, brute_ids):
        want = brute(want)
    assert ordered(corpus_pipeline.run(spark, str(tmp_path)).collect()) == ordered(want) and want
