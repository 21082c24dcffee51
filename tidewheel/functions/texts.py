"""Personal data masked, HTML told as text, URLs in one form: built-in functions only, each row on its own.

Each of them is a function of a column, and a query over a given table. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table

# What a mask looks for, in the order of masking. Neighbours are tested for ASCII only.
_FREE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MASKS = {
    "secret": r"""((?:token|secret|password|api_key)[ \t]*[=:][ \t]*")[^"\r\n]{8,}(")""",
    "email": r"()[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}()",
    "phone": r"()(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _END + "()",
    "card": rf"(){_FREE}[0-9]{{4}}(?:[0-9]{{9,15}}|(?:[ -][0-9]{{4}}){{3}}){_END}()",
    "ip": rf"(){_FREE}{_BYTE}(?:\.{_BYTE}){{3}}{_END}()",
}


def masked(text: Column) -> Column:
    """A struct of the masked ``text`` and, for each kind of MASKS, how often it was masked.

    Secrets lose what is between the quotes. Cards are 13 to 19 digits in a row or four groups of four,
    whether or not their check digit is right; each number of an address is 0 to 255. A mask of an
    earlier kind holds nothing that a later one looks for.
    """
    counts = []
    for kind, pattern in MASKS.items():
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(f"n_{kind}"))
        text = F.regexp_replace(text, pattern, f"$1<{kind}>$2")
    return F.struct(text.alias("text"), *counts)


_MASK_SQL = r"""
WITH a AS (SELECT doc_id, text AS t, regexp_replace(text, '((?:token|secret|password|api_key)[ \t]*[=:][ \t]*")[^"\r\n]{8,}(")', '\1<secret>\2', 'g') AS a FROM documents),
b AS (SELECT *, regexp_replace(a, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g') AS b FROM a),
-- RE2 has no look-around: the neighbour is consumed, and a second pass takes those that shared one
c AS (SELECT *, regexp_replace(regexp_replace(b, PHONE, '<phone>\1', 'g'), PHONE, '<phone>\1', 'g') AS c FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(c, CARD, '\1<card>\2', 'g'), CARD, '\1<card>\2', 'g') AS d FROM c),
e AS (SELECT *, regexp_replace(regexp_replace(d, IP, '\1<ip>\2', 'g'), IP, '\1<ip>\2', 'g') AS e FROM d)
SELECT doc_id, e AS text, COUNTS FROM e
""".replace("PHONE", r"'(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}([^A-Za-z0-9_]|$)'").replace(
    "CARD", r"'(^|[^A-Za-z0-9_])[0-9]{4}(?:[0-9]{9,15}|(?:[ -][0-9]{4}){3})([^A-Za-z0-9_]|$)'"
).replace("IP", rf"'(^|[^A-Za-z0-9_]){_BYTE}(?:\.{_BYTE}){{3}}([^A-Za-z0-9_]|$)'").replace(
    "COUNTS", ", ".join(f"((length({x}) - length(replace({x}, '<{k}>', '')) - length(t) + length(replace(t, '<{k}>', ''))) // {len(k) + 2})::INTEGER AS n_{k}" for x, k in zip("abcde", MASKS, strict=True))
)


@query(_MASK_SQL)
def mask_personal(spark, sf_dir):
    """Secrets, mail addresses, phones, cards and dotted addresses of all texts."""
    return table(spark, sf_dir, "documents").select("doc_id", masked(F.col("text")).alias("m")).select("doc_id", "m.*")


# Elements whose content isn't text, elements that begin a line, and named characters.
SILENT = ("script", "style", "noscript", "template")
BLOCKS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split()
NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€"}
_SILENT = "|".join(f"<{x}(?:[ \\t\\r\\n][^>]*)?>.*?</{x}[ \\t\\r\\n]*>" for x in SILENT)
_BLOCK = f"(?i)</?(?:{'|'.join(BLOCKS)})(?:[ \\t\\r\\n/][^>]*)?>"
_GAP = r"[ \t\r\f]+"


def decoded(text: Column) -> Column:
    """Character references of ``text`` as characters: those of NAMED, and numbers of a code point, decimal or hexadecimal. Others stay."""

    def numbered(t: Column, pattern: str, base: int, before: str) -> Column:
        def put(now: Column, digits: Column) -> Column:
            n = F.conv(digits, base, 10).cast("long")
            fit = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when(fit, F.replace(now, F.concat(F.lit(before), digits, F.lit(";")), char)).otherwise(now)

        return F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern))), t, put)

    text = numbered(text, "&#([0-9]{1,7});", 10, "&#")
    text = numbered(text, "&#x([0-9A-Fa-f]{1,6});", 16, "&#x")
    for name, char in NAMED.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))  # last: what it makes is text


def html_text(html: Column) -> Column:
    """What a reader sees of ``html``: a line for each block, its spaces made one, empty lines left out; comments, scripts and styles are none of it."""
    plain = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), f"(?is){_SILENT}", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\n\f]+", " "), _BLOCK, "\n")
    plain = F.regexp_replace(decoded(F.regexp_replace(plain, "<[A-Za-z/!?][^>]*>", "")), _GAP, " ")
    return F.regexp_replace(F.regexp_replace(plain, " ?\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


def _numbered_sql(t: str, pattern: str, before: str, value: str) -> str:
    swap = f"CASE WHEN {value} BETWEEN 1 AND 1114111 AND NOT {value} BETWEEN 55296 AND 57343 THEN replace(acc, '{before}' || x || ';', chr({value}::INTEGER)) ELSE acc END"
    return f"list_reduce(list_prepend({t}, list_distinct(regexp_extract_all({t}, '{pattern}', 1))), lambda acc, x: {swap})"


def _named_sql(t: str) -> str:
    for name, char in NAMED.items():
        t = f"replace({t}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({t}, '&amp;', '&')"


_HTML_SQL = rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is){_SILENT}', '', 'g') AS t, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title FROM pages),
b AS (SELECT page_id, title, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\n\f]+', ' ', 'g'), '{_BLOCK}', chr(10), 'g'), '<[A-Za-z/!?][^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, {_numbered_sql("title", "&#([0-9]{1,7});", "&#", "x::BIGINT")} AS title, {_numbered_sql("t", "&#([0-9]{1,7});", "&#", "x::BIGINT")} AS t FROM b),
d AS (SELECT page_id, {_numbered_sql("title", "&#x([0-9A-Fa-f]{1,6});", "&#x", "('0x' || x)::BIGINT")} AS title, {_numbered_sql("t", "&#x([0-9A-Fa-f]{1,6});", "&#x", "('0x' || x)::BIGINT")} AS t FROM c),
e AS (SELECT page_id, {_named_sql("title")} AS title, regexp_replace({_named_sql("t")}, '{_GAP}', ' ', 'g') AS t FROM d)
SELECT page_id, title, regexp_replace(regexp_replace(t, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM e
"""


@query(_HTML_SQL)
def html_as_text(spark, sf_dir):
    """Title and text of every page."""
    title = decoded(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), html_text(F.col("html")).alias("text"))


# Parameters that tell where a visitor came from and not what is shown.
TRACKING = r"^(?:utm_[a-z_]*|ref|fbclid|gclid)(?:=|$)"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normal_url(url: Column) -> Column:
    """One form of the URLs that show the same page: (url, host, path, n_params), all null where ``url`` isn't one.

    Scheme and host in lower case; no user, fragment, default port, tracking parameter or slash at the
    end of a path, but for ``/`` itself; parameters in order, repeated ones kept.
    """
    part = [F.regexp_extract(url, _URL, i) for i in range(1, 6)]
    scheme, host = F.lower(part[0]), F.lower(part[1])
    port = F.when((part[2] == "") | ((scheme == "http") & (part[2] == "80")) | ((scheme == "https") & (part[2] == "443")), "").otherwise(F.concat(F.lit(":"), part[2]))
    path = F.concat(F.lit("/"), F.regexp_replace(part[3], "^/+|/+$", ""))
    asked = F.array_sort(F.filter(F.split(part[4], "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query_part = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    told = F.struct(F.concat(scheme, F.lit("://"), host, port, path, query_part).alias("url"), host.alias("host"), path.alias("path"), F.size(asked).alias("n_params"))
    return F.when(url.rlike(_URL), told)


_NORMAL_SQL = rf"""
p AS (SELECT page_id, lower(regexp_extract(url, '{_URL}', 1)) AS scheme, lower(regexp_extract(url, '{_URL}', 2)) AS host, regexp_extract(url, '{_URL}', 3) AS port,
  '/' || trim(regexp_extract(url, '{_URL}', 4), '/') AS path, list_sort(list_filter(string_split(regexp_extract(url, '{_URL}', 5), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS asked
  FROM pages WHERE regexp_matches(url, '{_URL}')),
n AS (SELECT page_id, scheme || '://' || host || CASE WHEN port = '' OR scheme || port IN ('http80', 'https443') THEN '' ELSE ':' || port END || path
  || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS url, host, path, len(asked)::INTEGER AS n_params FROM p)
"""


@query(f"WITH {_NORMAL_SQL} SELECT q.page_id, n.url, host, path, n_params FROM pages q LEFT JOIN n ON q.page_id = n.page_id")
def normal_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normal_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query(f"WITH {_NORMAL_SQL} SELECT host, count(*)::BIGINT AS n_pages, count(DISTINCT url)::BIGINT AS n_urls FROM n GROUP BY host")
def pages_by_host(spark, sf_dir):
    """Pages and different normal URLs of each host; URLs are counted before hosts, so that no host's URLs meet in one task."""
    urls = table(spark, sf_dir, "pages").select(normal_url(F.col("url")).alias("u")).filter("u IS NOT NULL").select("u.host", "u.url")
    return urls.groupBy("host", "url").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum("n").alias("n_pages"), F.count("*").alias("n_urls"))
