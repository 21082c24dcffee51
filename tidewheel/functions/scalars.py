"""Families of scalar functions, each as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table


WORD = r"[A-Za-z]+"


@query(r"""
SELECT doc_id, length(text)::INTEGER AS n, substring(text, 2, 5) AS part, lower(trim(substring(text, 1, 40))) AS low, len(string_split(text, ' '))::INTEGER AS pieces,
  source || '/' || lang AS path, lpad(lang, 5, '*') AS padded, replace(source, 'e', 'E') AS swapped, starts_with(text, 'T') AS t, instr(text, 'the')::INTEGER AS found_at, reverse(lang) AS back
FROM documents
""")
def functions_string(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).alias("n"), F.substring(t, 2, 5).alias("part"), F.lower(F.trim(F.substring(t, 1, 40))).alias("low"), F.size(F.split(t, " ")).alias("pieces"),
        F.concat_ws("/", "source", "lang").alias("path"), F.lpad("lang", 5, "*").alias("padded"), F.replace(F.col("source"), F.lit("e"), F.lit("E")).alias("swapped"),
        F.startswith(t, F.lit("T")).alias("t"), F.instr(t, "the").alias("found_at"), F.reverse(F.col("lang")).alias("back"),
    )


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs,
  regexp_matches(url, '\?') AS asked FROM pages
""")
def functions_regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#:]+)", 1).alias("host"), F.regexp_replace("url", "[0-9]+", "#").alias("shape"),
        F.regexp_count("html", F.lit("<p>")).alias("paragraphs"), F.col("url").rlike(r"\?").alias("asked"),
    )


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s, sha1(text) AS o FROM documents")
def functions_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"), F.sha1("text").alias("o"))


@query()
def functions_hash_seeded(spark, sf_dir):
    """Hashes that DuckDB hasn't: xxhash64 (seed 42) and crc32 of the UTF-8 bytes. Tests hold them against libraries."""
    return table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("x"), F.crc32("text").alias("c"))


@query("SELECT a.n_name AS a, b.r_name AS b, levenshtein(a.n_name, b.r_name)::INTEGER AS d FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def functions_distance(spark, sf_dir):
    a, b = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return a.join(b, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), F.levenshtein("n_name", "r_name").alias("d"))


@query("""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, dayofweek(o_orderdate)::INTEGER + 1 AS w, quarter(o_orderdate)::INTEGER AS q,
  date_trunc('month', o_orderdate)::TIMESTAMP AS first_day, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::INTEGER AS days, last_day(o_orderdate) AS last_date,
  strftime(o_orderdate, '%Y/%m/%d') AS told, (o_orderdate + INTERVAL 3 MONTH)::TIMESTAMP AS later FROM orders
""")
def functions_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofweek(d).alias("w"), F.quarter(d).alias("q"), F.date_trunc("month", d).cast("timestamp_ntz").alias("first_day"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.last_day(d).alias("last_date"), F.date_format(d, "yyyy/MM/dd").alias("told"), (d + F.expr("INTERVAL 3 MONTHS")).alias("later"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS ln, round(log10(l_extendedprice), 6) AS lg, round(power(l_quantity, 1.5), 4) AS pw, round(cbrt(l_quantity), 6) AS cb,
  (l_partkey // 7)::BIGINT AS quotient, l_partkey % 7 AS rest, floor(l_tax * 10)::BIGINT AS low, ceil(l_tax * 10)::BIGINT AS high, sign(l_discount - 0.05)::DOUBLE AS sg, greatest(l_tax, l_discount) AS most, abs(l_tax - 0.03) AS off
FROM lineitem
""")
def functions_math(spark, sf_dir):
    p, q, k = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.ln(p), 6).alias("ln"), F.round(F.log10(p), 6).alias("lg"), F.round(F.pow(q, F.lit(1.5)), 4).alias("pw"), F.round(F.cbrt(q), 6).alias("cb"),
        F.expr("l_partkey div 7").alias("quotient"), (k % 7).alias("rest"), F.floor(F.col("l_tax") * 10).alias("low"), F.ceil(F.col("l_tax") * 10).alias("high"),
        F.signum(F.col("l_discount") - 0.05).alias("sg"), F.greatest("l_tax", "l_discount").alias("most"), F.abs(F.col("l_tax") - 0.03).alias("off"),
    )


@query("""
SELECT vec_id, len(embedding)::INTEGER AS n, list_max(embedding)::DOUBLE AS top, embedding[1]::DOUBLE AS first_value,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS square, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive FROM embeddings
""")
def functions_array(spark, sf_dir):
    e = F.col("embedding")
    square = F.aggregate(F.transform(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.array_max(e).cast("double").alias("top"), F.element_at(e, 1).cast("double").alias("first_value"),
        F.round(square, 5).alias("square"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
    )


@query("SELECT vec_id, p::INTEGER AS p, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)")
def functions_explode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).withColumn("x", F.col("x").cast("double"))


@query("""
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 5) AS folded,
  len(list_filter(list_zip(embedding, list_reverse(embedding)), lambda x: x[1] > x[2]))::INTEGER AS larger FROM embeddings
""")
def functions_zip(spark, sf_dir):
    """Two arrays taken together, element by element."""
    e, back = F.col("embedding"), F.reverse("embedding")
    products = F.zip_with(e, back, lambda x, y: x.cast("double") * y.cast("double"))
    larger = F.filter(F.zip_with(e, back, lambda x, y: x > y), lambda x: x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 5).alias("folded"), F.size(larger).alias("larger"))


@query("""
SELECT o_orderkey, o_orderpriority AS a, o_totalprice AS b, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS c, 2 AS keys FROM orders
""")
def functions_map_struct(spark, sf_dir):
    made = F.struct(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price"))
    by_status = F.create_map(F.col("o_orderstatus"), F.col("o_orderkey"), F.lit("-"), F.lit(0).cast("long"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", made.alias("s"), by_status.alias("m"))
    return rows.select("o_orderkey", F.col("s.name").alias("a"), F.col("s")["price"].alias("b"), F.try_element_at("m", F.lit("F")).alias("c"), F.size(F.map_keys("m")).alias("keys"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT AS v, '{"id":' || event_id || '}' AS told FROM events""")
def functions_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("v"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("told")
    )


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '<ip>', 'g') AS text FROM documents
""")
def mask_addresses(spark, sf_dir):
    """Mail addresses and dotted addresses in texts are masked."""
    mail = F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(mail, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<ip>").alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM pages")
def html_to_text(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(plain).alias("text"))


@query("SELECT source, count(*)::BIGINT AS n, sum(quality)::BIGINT AS good, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_metrics(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.round(F.avg("toxic"), 6).alias("toxic"))
