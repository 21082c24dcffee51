"""WARC archives, chat formatting and fingerprints against brute force; and the SQL of the corpus queries."""

import hashlib
import os
import random

import duckdb
import pytest

from tidewheel.llm import chat, registry, syncmers, warc

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    got = registry.QUERIES[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.collect()) == plain(want)


def test_archives_give_every_page_back(spark):
    """URLs that aren't any, with tabs, line breaks and escapes; repeated payloads, rows and ids; nulls."""
    urls = ["http://[a\tb", "http://a.b/c d", "x\r\ny", "http://h/%09", None, "", "http://é.example:80/ü?q#f", "http://[::1", "a b\x85c", "http://a:bad/"]
    body = "<html>" + "y" * 200
    rows = [(i, u, f"{body}{i}" if i % 3 else body) for i, u in enumerate(urls)]
    rows += [(50, "u", None), (51, "u", ""), (52, "v\t", "short"), (53, "w", "short"), (None, "n", body), (20, "http://b/", body + "1" * 300_000), (21, "z\n", body + "1" * 300_000)]
    rows += [rows[1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive(df).collect()
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        other = first.get(h, i)
        digest = hashlib.sha256(h.encode()).hexdigest()
        want.append((i, len(h.encode()), digest, "response" if other == i else "revisit", None if other == i else other))
    assert plain(map(tuple, got)) == plain(want)


def test_archives_of_an_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chats_are_read_back(spark):
    """Control strings in texts and roles, nulls, ties, repeated rows, and conversations that the machine refuses."""
    odd = ["<|end|>", "<\\|turn|>", "<\\\\|text|>x<|", "", None, "a<|text|>b\n", "é🙂" * 50_000]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "late"), (2, 0, "assistant", "late"), (2, 0, "user", "tie"), (3, None, None, None), (None, 0, "<|turn|>", "x")]
    got = chat.format_chats(spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, state string"))
    told = {r.conv_id: r for r in got.withColumn("back", chat.read_turns(got["formatted"])).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(b.role, b.text) for b in told[conv].back] == [(r, x) for _, _, r, x in own]
        assert "".join(s.text for s in told[conv].segments) == told[conv].formatted
        loss = [s.text for s in told[conv].segments if s.loss]
        assert len(loss) == sum(r == "assistant" for _, _, r, _ in own)
    assert not told[1].valid and not told[2].valid and not told[3].valid
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_syncmers_are_those_of_brute_force():
    """Places by the definition: the least inner hash is at an edge; and they depend on the k-mer alone."""
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcde é🙂") for _ in range(3000))
    codes = syncmers._codes(text)
    at, _ = syncmers.anchors(codes)
    k, s = syncmers.K, syncmers.S
    inner = syncmers._windows(syncmers.mix(codes.astype("uint64") + syncmers.np.uint64(1)), s).tolist()
    want = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert at.tolist() == want
    moved, _ = syncmers.anchors(syncmers._codes("some words before" + text))
    assert set(i + 17 for i in want) <= set(moved.tolist())


def brute_likeness(one, two):
    """By the definition, in sets and loops: smallest anchors of both, places after the shift with most votes."""
    marks = []
    for text in (one, two):
        at, h = syncmers.anchors(syncmers._codes(text))
        first = {}
        for p, x in zip(at.tolist(), h.tolist(), strict=True):
            first.setdefault(x >> 32, p)
        marks.append({x: first[x] for x in sorted(first)[: syncmers.KEPT]})
    a, b = marks
    if not a or not b:
        return float(not a and not b)
    union = sorted({*a, *b})[: syncmers.KEPT]
    slack = syncmers.NEAR + max(len(one), len(two)) // 64
    moved = [a[x] - b[x] for x in a if x in b]
    votes = {d: sum(abs(d - y) <= slack for y in moved) for d in moved}
    way = min(votes, key=lambda d: (-votes[d], abs(d), d), default=0)
    return sum(x in a and x in b and abs(a[x] - b[x] - way) <= slack for x in union) / len(union)


def test_likeness_is_that_of_brute_force():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdeé🙂") for _ in range(rnd.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 3, 30, 300, 900)]
    base = texts[-1]
    texts += [texts[4] + base, base + texts[4], base[2000:] + base[:2000], base[:1500] + texts[3] + base[1500:], base[::-1], "ab " * 900, "x" + "ab " * 700]
    marks = [syncmers.fingerprint(syncmers._codes(t)) for t in texts]
    for one, a in zip(texts, marks, strict=True):
        for two, b in zip(texts, marks, strict=True):
            assert syncmers.likeness(a, b) == brute_likeness(one, two)
        assert syncmers.likeness(a, a) == 1


def test_words_before_a_text_leave_its_fingerprint_alike():
    """400 code points in front move every anchor alike; a text in two halves that change places is alike by one half only."""
    rnd = random.Random(13)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(668))[:4673]
    before = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    mark = lambda t: syncmers.fingerprint(syncmers._codes(t))
    assert syncmers.likeness(mark(text), mark(before + text)) > 0.8
    assert syncmers.likeness(mark(text), mark(text[2336:] + text[:2336])) < 0.8
    assert syncmers.likeness(mark(text), mark(before * 11)) < 0.1


def test_fingerprints_of_documents(spark):
    """Neighbours, edited texts and digests by brute force; equal texts alike; nulls, empty texts, repeated ids and a long text."""
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abc defé ") for _ in range(rnd.randrange(0, 400)))) for i in range(60)]
    rows += [(61, None), (62, ""), (63, rows[5][1]), (None, "nobody"), (64, "x" * 700_000 + rows[6][1]), (7, "a second text of id 7")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, run int").repartition(5)
    got = syncmers.fingerprints(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert plain((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == plain(want)
    told = {(r.doc_id, r.n_chars): r for r in got}
    assert told[63, len(rows[5][1])].fingerprint == told[5, len(rows[5][1])].fingerprint
    texts = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        texts.setdefault((i, len(t)), []).append((brute_likeness(t, new), brute_likeness(t, after)))
    for r in got:
        assert (r.near_edited, r.near_next) in texts[r.doc_id, r.n_chars]
    assert syncmers.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op2_chat_format", "op6_licence_scan"])
def test_native_queries_make_no_rows_in_python(spark, name):
    """Neither Python nor an RDD of its own has a part in the plan (that of op6 begins at its last written table)."""
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ExistingRDD", "LogicalRDD", "Python", "InArrow", "InPandas"))


def test_literal_rows(spark):
    from tidewheel.llm.scratch import literal_rows

    rows = [(1, "a", ["x", "y"]), (None, None, []), (1, "a", ["x", "y"])]
    got = literal_rows(spark, "a long, b string, c array<string>", rows)
    assert [tuple(r) for r in got.collect()] == rows and dict(got.dtypes) == {"a": "bigint", "b": "string", "c": "array<string>"}
