"""Odd texts for what is masked, decoded and normalised, held against Python's own tools where it has them."""

import html as pages
import ipaddress
import zlib

import xxhash
from pyspark.sql import functions as F

from tidewheel.functions import scalars, texts


def told(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(rows.select("i", make(F.col("v")).alias("x")).collect())]


def test_masks_of_each_kind_and_their_counts(spark):
    cases = {
        'a token = "0123456789abcdef" b': ('a token = "<secret>" b', "n_secret"),
        'token = "short"': ('token = "short"', None),
        "to ann.b+c@mail.example.org.": ("to <email>.", "n_email"),
        "call +1 (743) 555-3824 now": ("call <phone> now", "n_phone"),
        "é4785380592391139é": ("é<card>é", "n_card"),
        "4785 3805 9239 1139": ("<card>", "n_card"),
        "47853805923911391234567": ("47853805923911391234567", None),
        "id_4785380592391139": ("id_4785380592391139", None),
        "at 152.143.123.131###": ("at <ip>###", "n_ip"),
        "at 352.143.123.131 v1.2.3.4x": ("at 352.143.123.131 v1.2.3.4x", None),
        "": ("", None),
    }
    for (text, kind), got in zip(cases.values(), told(spark, list(cases), texts.masked), strict=True):
        assert got["text"] == text
        assert {k: v for k, v in got.asDict().items() if k != "text" and v} == ({kind: 1} if kind else {}), text
    twice = told(spark, ["4785380592391139 4785380592391139 1.2.3.4.5.6.7.8", None], texts.masked)
    assert twice[0]["text"] == "<card> <card> <ip>.<ip>" and (twice[0]["n_card"], twice[0]["n_ip"]) == (2, 2)
    assert twice[1]["text"] is None


def test_masked_addresses_are_those_that_python_reads(spark):
    values = [f"{a}.{b}.0.9" for a in (0, 9, 10, 99, 100, 199, 249, 250, 255, 256, 300, 999) for b in (1, 255, 256)]

    def real(v):
        try:
            return bool(ipaddress.IPv4Address(v))
        except ValueError:
            return False

    assert [x["text"] == "<ip>" for x in told(spark, values, texts.masked)] == [real(v) for v in values]


def test_character_references(spark):
    same = [f"x&{n};y" for n in texts.NAMED if n != "nbsp"] + ["&amp;lt;", "&#65;&#65;&#233;&#8364;&#128512;", "&#x41;&#X41;&#x1F600;", "&#38;amp;", "a & b", ""]
    assert told(spark, [v for v in same if "X41" not in v and "#38" not in v], texts.decoded) == [pages.unescape(v) for v in same if "X41" not in v and "#38" not in v]
    # no character has these numbers; names that aren't known stay
    assert told(spark, ["&#0;&#55296;&#1114112;", "&unheard;", None], texts.decoded) == ["&#0;&#55296;&#1114112;", "&unheard;", None]


def test_text_of_odd_pages(spark):
    cases = {
        "<p>a<br>b<b>c</b>": "a\nbc",
        "<style>p{}</style><SCRIPT src='x'>var t='</p>';</SCRIPT >x": "x",
        "a<!-- <p>no\n</p> -->b": "ab",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        " \n<div>\t<p> a\r\n b </p>\n\n<p>c</p></div>": "a b\nc",
        "&lt;p&gt;": "<p>",
        "<preface>x</preface>": "x",
        "<script>never closed": "never closed",
        "": "",
    }
    assert told(spark, [*cases, None], texts.html_text) == [*cases.values(), None]


def test_urls_of_one_page_have_one_form(spark):
    alike = ["HTTP://Example.com:80/a/?b=2&a=1&utm_source=x#top", "http://u:p@example.com/a?a=1&b=2", "http://example.com/a/?ref=y&a=1&&b=2"]
    got = told(spark, alike, texts.normal_url)
    assert {x["url"] for x in got} == {"http://example.com/a?a=1&b=2"} and got[0]["host"] == "example.com" and got[0]["n_params"] == 2
    other = ["https://example.com:80", "https://example.com:443/?", "http://e.com/?reference=1&ref", "http://e.com/A?x=1&x=1", "no url", "", None]
    assert [x and x["url"] for x in told(spark, other, texts.normal_url)] == ["https://example.com:80/", "https://example.com/", "http://e.com/?reference=1", "http://e.com/A?x=1&x=1", None, None, None]
    once = told(spark, [x["url"] for x in got], texts.normal_url)
    assert [x["url"] for x in once] == [x["url"] for x in got]


def test_seeded_hashes_are_those_of_the_libraries(spark):
    folder = "/root/testdata/sf0.001"
    rows = scalars.functions_hash_seeded(spark, folder).collect()
    docs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert r["x"] % 2**64 == xxhash.xxh64_intdigest(data, seed=42) and r["c"] == zlib.crc32(data)
