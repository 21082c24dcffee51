"""Licence scans: lines that state a licence, found with DataFrame and Spark ML functions only.

Each line is cut in overlapping windows of about a template's length, and each line break has a
window of the words on both its sides, so that a statement inside a long line or wrapped over lines
is seen nearly undiluted. A sparse multinomial logistic regression on word unigrams and bigrams, those of
the statements below and one for all others, is learned from the statements and all ordinary windows of the
table. It names a licence family or none for each window, and a comparison with the family's templates
must confirm it; otherwise the family is ``unknown``, for which the score must pass a threshold that is
counted once over all ordinary lines. Windows with the same words and pairs of the vocabulary are grouped,
so that each kind of them is learned from and scored once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .scratch import Scratch, literal_rows, read_table, small_side

NONE, UNKNOWN = "none", "unknown"
#: Bins of scores in the calibration.
BINS = 100_000
#: Stands for a line break among words; a private character, blanked out in texts.
BREAK = "\ue000"
#: Stands for a word or pair that isn't in the vocabulary.
OTHER = 0
#: Weight of each part that is learned from, all its rows together.
WEIGHT = 3000.0
#: Parts of words that lines about licences hold, lower-cased.
STATED = ("licens", "licenc", "copyright", "permission", "warrant", "spdx")
#: Families and their usual statements.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
}
#: A window is confirmed only if it holds all word pairs and words of one of its family's lines: names and versions, which a share of a template doesn't see.
NAMES: dict[str, tuple[tuple[str, ...], ...]] = {
    "apache-2.0": (("apache", "2 0"),),
    "mit": (("mit license",), ("identifier mit",), ("hereby granted", "free of", "of charge")),
    "gpl": (("gnu general", "general public"), ("identifier gpl",)),
    "lgpl": (("gnu lesser",), ("identifier lgpl",)),
    "bsd": (("redistribution and", "source and", "binary forms"), ("bsd 3",), ("bsd 2",)),
    "mpl-2.0": (("mozilla public", "2 0"), ("identifier mpl", "2 0")),
    "cc-by": (("cc by", "by 4"), ("attribution 4",)),
    "cc-by-sa": (("by sa", "sa 4"), ("attribution sharealike", "sharealike 4")),
    "cc-by-nc": (("by nc", "nc 4"), ("attribution noncommercial", "noncommercial 4")),
}
#: Word pairs that deny a statement.
DENIALS = ("not licensed", "not released", "not under", "never licensed", "never released", "no longer")
#: Wordings round a statement that learning sees.
FRAMES = ("{}.", "{}", "This file is {}.", "The text of this work: {}.", "(c) the authors. {}. All other rights reserved.", "Note: {}", "{} See the file for details.")
#: Ordinary sentences with a licence's words, so that these alone don't decide.
DECOYS = (
    "The driver lost his license after the accident.",
    "Permission to enter the building is granted at the gate.",
    "The general public was free to use the new park.",
    "She has a license to fish in the river.",
    "The common version of the story has no attribution.",
    "Copies of the file are sold in the source of the river.",
)


@dataclass(frozen=True)
class Settings:
    """``missed`` is the share of a table's ordinary lines that may reach the threshold of ``unknown``, which is ``least_score`` at least.

    A window that shares ``apart`` of a template's words and pairs, or more, isn't learned from as ordinary. ``window`` and ``step`` are in words.
    """

    apart: float = 0.4
    missed: float = 0.001
    least_score: float = 0.5
    likeness: float = 0.6
    iterations: int = 30
    window: int = 32
    step: int = 16


def words(body: Column) -> Column:
    return F.array_remove(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), "")


def _pair(a: Column, b: Column) -> Column:
    return F.hash(a, b)


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the words and of the pairs of words of all statements and decoys; hashes of templates, names and denials."""

    words: tuple[int, ...]
    pairs: tuple[int, ...]
    templates: dict[str, list[list[int]]]
    names: dict[str, list[list[int]]]
    denials: list[int]

    def told(self, h: Column) -> Column:
        """A word's hash, 0 if it isn't in the vocabulary."""
        return F.when(h.isin(*self.words), h).otherwise(OTHER)

    def told_pairs(self, one: Column) -> Column:
        """Hashes of the pairs of words that follow one another, 0 for one that isn't in the vocabulary; as many as ``one`` has words, the last is of no pair."""
        known = lambda h: F.when(h.isin(*self.pairs), h).otherwise(OTHER)
        return F.zip_with(one, F.slice(one, F.lit(2), F.size(one)), lambda a, b: F.when((a != OTHER) & (b != OTHER), known(_pair(a, b))).otherwise(OTHER))

    def share(self, hits: str) -> Column:
        """The greatest share of the words and pairs of any template that are among a window's."""
        held = lambda has: F.size(F.filter(hits, lambda x: x.isin(*has))) / len(has)
        return F.greatest(*[held(has) for sets in self.templates.values() for has in sets])

    def line(self, body: Column) -> tuple[Column, Column]:
        """(hits, rest) of a line that is taken as one window."""
        one = F.transform(words(body), lambda x: self.told(F.hash(x)))
        return _hits(F.concat(one, self.told_pairs(one))), _rest(F.concat(one, self.told_pairs(one)))


def _hits(told: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(told, OTHER)))


def _rest(told: Column) -> Column:
    """The root of the number of words and pairs that aren't in the vocabulary, rounded up; the pair behind the last word counts as one."""
    return F.ceil(F.sqrt(F.size(F.filter(told, lambda x: x == OTHER)))).cast("int")


@functools.lru_cache(maxsize=4)
def _vocabulary(spark: SparkSession) -> Vocabulary:
    kinds = [("template", f, t) for f, ts in TEMPLATES.items() for t in ts]
    kinds += [("name", f, " ".join(line)) for f, lines in NAMES.items() for line in lines]
    kinds += [("other", "", frame.format(t)) for ts in TEMPLATES.values() for t in ts for frame in FRAMES]
    kinds += [("other", "", t) for t in (*DECOYS, *DENIALS)]
    rows = literal_rows(spark, "i int, body string", [(i, t) for i, (_, _, t) in enumerate(kinds)])
    rows = rows.select("i", F.transform(words(F.col("body")), lambda x: F.hash(x)).alias("one"))
    pairs = F.zip_with("one", F.slice("one", F.lit(2), F.size("one")), _pair)
    told = {r.i: (r.one, r.two[:-1]) for r in rows.select("i", "one", pairs.alias("two")).collect()}
    terms = [*{x for ts in NAMES.values() for line in ts for x in line}, *DENIALS]
    hashes = literal_rows(spark, "i int, w array<string>", [(i, x.split()) for i, x in enumerate(terms)])
    first, second = F.hash(F.col("w")[0]), F.hash(F.get("w", F.lit(1)))
    hashed = hashes.select("i", F.when(F.size("w") == 1, first).otherwise(_pair(first, second)).alias("h")).collect()
    of = {terms[r.i]: r.h for r in hashed}
    templates: dict[str, list[list[int]]] = {}
    for i, (kind, f, _) in enumerate(kinds):
        if kind == "template":
            templates.setdefault(f, []).append(list(dict.fromkeys([*told[i][0], *told[i][1]])))
    kept = [told[i] for i, (kind, _, _) in enumerate(kinds) if kind != "name"]
    return Vocabulary(
        tuple(sorted({x for one, _ in kept for x in one})), tuple(sorted({x for _, two in kept for x in two})),
        templates, {f: [[of[x] for x in line] for line in lines] for f, lines in NAMES.items()}, [of[x] for x in DENIALS],
    )


def _once(df: DataFrame, *keep: str, **new: Column) -> DataFrame:
    """df with new columns, each worked out once a row: a projection could move them into the lambdas that use them."""
    told = F.struct(*[c.alias(name) for name, c in new.items()])
    return df.select(*keep, F.inline_outer(F.array(told)))


def windows(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, row, paragraph, inner, at, plain, first, hits, rest): the windows of each row of docs.

    A window inside a line (``inner``) counts to that line, one round a break to the line before it. ``at`` is
    its first word's place in the text. ``plain`` tells that its line holds no word of licences (round a break, the
    whole text holds none), ``first`` that it is the first of its line. ``hits`` are the words and pairs of the
    vocabulary that it holds, each once, ``rest`` is the root of the number of the others.
    """
    v = _vocabulary(docs.sparkSession)
    body = F.lower(F.regexp_replace(F.translate(docs["text"].cast("string"), BREAK, " "), r"[\r\n]+", f" {BREAK} "))
    out = _once(docs.filter(docs["text"].isNotNull()), docs["doc_id"].alias("doc_id"), body=body)
    tokens = F.array_remove(F.split(F.concat("body", F.lit(f" {BREAK}")), rf"[^\p{{L}}\p{{N}}{BREAK}]+"), "")
    about = lambda x: functools.reduce(lambda a, b: a | b, [x.contains(w) for w in STATED])
    said = F.when(about(F.col("body")), F.transform(F.split("body", BREAK), about))
    out = _once(out.select("doc_id", F.monotonically_increasing_id().alias("row"), "body"), "doc_id", "row", t=tokens, said=said)
    places = F.filter(F.transform("t", lambda x, i: F.when(x == BREAK, i)), lambda i: i.isNotNull())
    out = _once(out, "doc_id", "row", "said", w=F.array_remove("t", BREAK), ends=F.transform(places, lambda e, j: e - j))
    # lines as (paragraph, first word, words, whether the next line has words)
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("ends", j - 1))
    lines = F.transform(
        "ends",
        lambda e, j: F.struct(
            j.alias("k"), begin(j).alias("b"), (e - begin(j)).alias("n"), (F.coalesce(F.get("ends", j + 1), e) > e).alias("on"), (~F.coalesce(F.get("said", j), F.lit(False))).alias("plain")
        ),
    )
    out = _once(out, "doc_id", "row", one=F.transform("w", lambda x: v.told(F.hash(x))), bare=F.col("said").isNull(), lines=F.filter(lines, lambda x: x["n"] > 0))
    out = _once(out.filter(F.size("lines") > 0), "doc_id", "row", "one", "bare", "lines", two=v.told_pairs(F.col("one")))

    def inside(x: Column) -> Column:
        last = F.greatest(x["n"] - s.window, F.lit(0))
        steps = F.sequence(F.lit(0), F.ceil(last / s.step).cast("int"))
        return F.transform(
            steps,
            lambda i: F.struct(
                x["k"].alias("k"), F.lit(True).alias("inner"), (x["b"] + F.least(i * s.step, last)).alias("at"), F.least(x["n"], F.lit(s.window)).alias("n"), x["plain"].alias("plain"), (i == 0).alias("first")
            ),
        )

    def round_break(x: Column) -> Column:
        end = x["b"] + x["n"]
        at = F.greatest(end - s.window // 2, F.lit(0))
        return F.struct(x["k"].alias("k"), F.lit(False).alias("inner"), at.alias("at"), (end - at + s.window // 2).alias("n"), F.col("bare").alias("plain"), F.lit(False).alias("first"))

    spans = F.concat(F.flatten(F.transform("lines", inside)), F.transform(F.filter("lines", lambda x: x["on"]), round_break))
    out = _once(out, "doc_id", "row", "one", "two", spans=spans)
    out = out.select("doc_id", "row", "one", "two", F.inline("spans"))
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("n"))
    # the pair of a window's last word leaves the window
    ours = F.concat(cut("one"), F.slice(cut("two"), F.lit(1), F.greatest(F.least("n", F.size("one") - F.col("at")) - 1, F.lit(0))), F.array(F.lit(OTHER)))
    out = _once(out, "doc_id", "row", "k", "inner", "at", "plain", "first", own=ours)
    return out.select("doc_id", "row", F.col("k").alias("paragraph"), "inner", "at", "plain", "first", _hits(F.col("own")).alias("hits"), _rest(F.col("own")).alias("rest"))


def window_kinds(cut: DataFrame, s: Settings) -> DataFrame:
    """hits, rest, n, lines, common of windows with the same hits and rest: how many are plain, how many plain lines begin with one, and whether they share less than ``apart`` of any template."""
    kinds = cut.groupBy("hits", "rest").agg(F.count_if("plain").alias("n"), F.count_if(F.col("plain") & F.col("first")).alias("lines"))
    return kinds.withColumn("common", _vocabulary(cut.sparkSession).share("hits") < s.apart)


def _features(df: DataFrame) -> DataFrame:
    """df with features from its columns ``hits`` and ``rest``: one for each word and pair of the vocabulary, one for all others; a line without words has an empty vector."""
    v = _vocabulary(df.sparkSession)
    terms = [str(h) for h in sorted({OTHER, *v.words, *v.pairs})]
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_tf")
    grams = df.withColumn("_grams", F.concat("hits", F.array_repeat(F.lit(OTHER), F.col("rest"))).cast("array<string>"))
    return Normalizer(inputCol="_tf", outputCol="features").transform(counter.transform(grams)).drop("_tf", "_grams")


class Classifier:
    """The model learned from all windows of a table, and its families.

    Windows with the same ``hits`` and ``rest`` are alike to the model: each kind of them (``window_kinds``) is learned from
    once, weighted by how many there are.
    """

    def __init__(self, kinds: DataFrame, s: Settings = Settings()):
        spark = kinds.sparkSession
        self.s, self.families, self.vocabulary = s, [NONE, *TEMPLATES], _vocabulary(spark)
        #: The least score of a row of ``unknown``; ``calibrate`` sets it.
        self.threshold = s.least_score
        known = [(self.families.index(f), frame.format(t)) for f, ts in TEMPLATES.items() for t in ts for frame in FRAMES]
        known += [(0, d) for d in DECOYS for _ in range(4)]
        plain = kinds.filter((F.col("n") > 0) & F.col("common"))
        total = plain.agg(F.sum("n")).first()[0] or 1
        hits, rest = self.vocabulary.line(F.col("body"))
        # all statements together weigh as much as the ordinary windows, and so do statements among ordinary words
        seen = literal_rows(spark, "label int, body string", known).select("label", F.lit(WEIGHT / len(known)).alias("weight"), hits.alias("hits"), rest.alias("rest"))
        weight = F.col("n") * F.lit(WEIGHT / total)
        seen = seen.unionAll(plain.select(F.lit(0), weight, "hits", "rest")).unionAll(self._among(plain, weight))
        seen = _features(seen).select("label", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
        learner = LogisticRegression(family="multinomial", regParam=1e-5, maxIter=s.iterations, standardization=False, weightCol="weight")
        self.model = learner.fit(seen)
        seen.unpersist()

    def calibrate(self, found: DataFrame, lines: int) -> None:
        """Sets the score that at most ``missed`` of all ``lines`` ordinary lines reach by their best window, ``least_score`` at least; ``found`` holds the windows that reach that."""
        best = found.filter("plain").groupBy("row", "paragraph").agg(F.floor(F.max("score") * BINS).cast("int").alias("b"))
        counts = {r.b: r["count"] for r in best.groupBy("b").count().collect()}
        self.threshold = max(self.s.least_score, edge(counts, BINS, self.s.missed * lines))

    def _among(self, plain: DataFrame, weight: Column) -> DataFrame:
        """label, weight, hits, rest of a statement among the words of each kind of ordinary windows: it takes the place of some of them."""
        texts = [(k, self.families.index(f), t) for k, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
        own, rest = self.vocabulary.line(F.col("text"))
        size = F.size(words(F.col("text")))
        side = literal_rows(plain.sparkSession, "k int, label int, text string", texts).select("k", "label", own.alias("own"), rest.alias("left"), (F.lit(1.0) - F.least(size / self.s.window, F.lit(1.0))).alias("room"))
        k = F.pmod(F.xxhash64("hits", "rest"), F.lit(len(texts))).cast("int")
        both = plain.select("hits", "rest", weight.alias("weight"), k.alias("k")).join(F.broadcast(side), "k")
        kept = F.filter("hits", lambda x: F.pmod(F.hash(x, F.lit(7)), F.lit(1000)) < F.col("room") * 1000)
        others = F.ceil(F.sqrt(F.col("left") * F.col("left") + F.col("rest") * F.col("rest") * F.col("room"))).cast("int")
        return both.select("label", "weight", F.array_sort(F.array_union("own", kept)), others)

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows(hits, rest) with family (the likeliest but none) and score (its probability)."""
        told = self.model.transform(_features(rows)).withColumn("p", vector_to_array("probability"))
        told = told.drop("features", "rawPrediction", "probability", "prediction")
        told = told.withColumn("p", F.slice("p", 2, len(self.families) - 1)).withColumn("score", F.array_max("p"))
        family = F.element_at(F.array(*[F.lit(f) for f in self.families[1:]]), F.array_position("p", F.col("score")).cast("int"))
        return told.withColumn("family", family).drop("p")

    def likeness(self, own: Column, family: Column) -> Column:
        """The greatest share of the words and word pairs of one of the family's templates that are among a window's.

        0 if the window lacks the family's name or version, or denies the statement."""
        v, out = self.vocabulary, F.lit(None).cast("double")
        for f, sets in v.templates.items():
            shares = [F.size(F.array_intersect(own, F.array(*map(F.lit, has)))) / len(has) for has in sets]
            holds = lambda line: F.size(F.array_intersect(own, F.array(*map(F.lit, line)))) == len(set(line))
            named = functools.reduce(lambda a, b: a | b, [holds(line) for line in v.names[f]])
            share = F.greatest(*shares) if len(shares) > 1 else shares[0]
            out = F.when(family == f, F.when(named, share).otherwise(0.0)).otherwise(out)
        return F.when(F.arrays_overlap(own, F.array(*map(F.lit, v.denials))), 0.0).otherwise(out)


def edge(counts: dict[int, int], bins: int, allowed: float) -> float:
    """The least score, at a histogram's bin, that at most ``allowed`` lines reach; counts are by bin."""
    above = 0
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if above > allowed:
            return (b + 1) / bins
    return 0.0


def scan(docs: DataFrame, model: Classifier | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id, paragraph, family, predicted, score, similarity of each line of docs(doc_id, text) that looks like a licence.

    ``paragraph`` is the line's place from 0, and a row tells the best window of the line for one
    family; a family is left out where an overlapping window of the line is more like another.
    ``family`` is ``unknown`` where no template of the predicted family confirms it; such a row is
    given only for a line with no confirmed one whose score reaches the model's threshold. A null
    or blank text has no lines; a null id is given back as it is; repeated rows give repeated rows;
    an empty table gives none; other columns are ignored. Only windows that reach ``least_score``
    are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "licences")
    s = model.s if model else s
    cut = scratch.save(windows(docs, s), "windows")
    kinds = scratch.save(window_kinds(cut, s), "kinds")
    learned = model or Classifier(kinds, s)
    told = learned.scored(kinds).filter(F.col("score") >= s.least_score).withColumn("similarity", learned.likeness(F.col("hits"), F.col("family")))
    told = scratch.save(told.drop("n", "lines"), "told")
    found = cut.join(small_side(told, 64, F.size("hits") * 4), ["hits", "rest"]).withColumn("plain", F.col("plain") & F.col("common"))
    found = scratch.save(found.drop("hits", "rest", "first", "common"), "found")
    if model is None:
        learned.calibrate(found, kinds.agg(F.sum("lines")).first()[0] or 0)
    for name in ("windows", "kinds", "told"):
        scratch.drop(name)
    found = found.withColumn("sure", F.col("similarity") >= s.likeness)
    told = F.when(F.col("sure"), F.col("similarity")).otherwise(F.lit(0.0))
    # what is told round a break counts only if no window that overlaps it tells the family as well
    near = lambda w: w.orderBy("at").rangeBetween(-(s.window - 1), s.window - 1)
    top = F.max(F.struct("sure", told, "inner", "score", F.negate("at").alias("at"))).over(near(Window.partitionBy("row", "family")))
    found = found.withColumn("top", top).filter(F.col("inner") | ((F.col("top.at") == -F.col("at")) & ~F.col("top.inner")))
    line = Window.partitionBy("row", "paragraph")
    best = F.max(F.struct("sure", told, "score", "family")).over(near(line))
    found = found.withColumn("best", best["family"]).withColumn("some", F.max("sure").over(line))
    found = found.filter((F.col("best") == F.col("family")) & (F.col("sure") | ~F.col("some"))).drop("top")
    # one row for each confirmed family of a line; one for a line without any
    rank = Window.partitionBy("row", "paragraph", F.when(F.col("sure"), F.col("family"))).orderBy(F.desc_nulls_last(F.when(F.col("sure"), F.col("similarity"))), F.desc("score"), "at", "family")
    found = scratch.save(found.withColumn("k", F.row_number().over(rank)).filter("k = 1"), "lines")
    scratch.drop("found")
    found = found.filter(F.col("sure") | (F.col("score") >= learned.threshold))
    confirmed = F.when(F.col("sure"), F.col("family")).otherwise(UNKNOWN)
    return found.select("doc_id", "paragraph", confirmed.alias("family"), F.col("family").alias("predicted"), "score", "similarity")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
