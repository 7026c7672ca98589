"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking
from ..sources import library as L
from .registry import query


@query("SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)")
def slugify_ascii(spark, d):
    return L.table(spark, d, "documents").select("doc_id", X.slugify(F.substring_index("text", "\n", 1)).alias("slug"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, n_chars FROM documents")
def digest_md5_sha(spark, d):
    return L.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), "n_chars")


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, replace(replace(url, '|', '\|'), chr(10), ' ') AS cell FROM pages""")
def html_escape(spark, d):
    return L.table(spark, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("html"), X.cell_escape(F.col("url")).alias("cell"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def xml_escape(spark, d):
    return L.table(spark, d, "pages").select("page_id", X.xml_escape(F.col("html")).alias("xml"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def natural_sort(spark, d):
    """Names with numbers in numeric order, though their digits are not padded."""
    p = L.table(spark, d, "part")
    name = F.concat(F.lit("Page "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_partkey").cast("string"))
    return ranking.numbered(p.select("p_partkey", X.natural_key(name).alias("_key")), ["_key"]).drop("_key")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def natural_sort_all(spark, d):
    """natural_sort over every part."""
    name = F.concat(F.lit("Page "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_partkey").cast("string"))
    return ranking.numbered(L.table(spark, d, "part").select("p_partkey", X.natural_key(name).alias("_key")), ["_key"]).drop("_key")


@query(
    """WITH RECURSIVE step(n, left_, out) AS (SELECT i::INT, i::INT, '' FROM range(1, 51) t(i) UNION ALL
  SELECT n, left_ - v, out || r FROM (SELECT n, left_, out, CASE WHEN left_ >= 50 THEN 50 WHEN left_ >= 40 THEN 40 WHEN left_ >= 10 THEN 10 WHEN left_ >= 9 THEN 9 WHEN left_ >= 5 THEN 5 WHEN left_ >= 4 THEN 4 ELSE 1 END AS v,
    CASE WHEN left_ >= 50 THEN 'l' WHEN left_ >= 40 THEN 'xl' WHEN left_ >= 10 THEN 'x' WHEN left_ >= 9 THEN 'ix' WHEN left_ >= 5 THEN 'v' WHEN left_ >= 4 THEN 'iv' ELSE 'i' END AS r FROM step WHERE left_ > 0))
SELECT p_partkey, out AS numeral, n AS value FROM part JOIN step ON step.n = p_size AND left_ = 0"""
)
def roman_numerals(spark, d):
    """Sizes written as roman numerals and read back."""
    tens = F.element_at(F.array(*[F.lit(x) for x in ("", "x", "xx", "xxx", "xl", "l")]), (F.col("p_size") / 10).cast("int") + 1)
    ones = F.element_at(F.array(*[F.lit(x) for x in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")]), F.col("p_size") % 10 + 1)
    numeral = F.concat(tens, ones)
    return L.table(spark, d, "part").select("p_partkey", numeral.alias("numeral"), X.roman_to_int(numeral).alias("value"))


@query(r"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 2 THEN '' ELSE l_linenumber || '.' || l_quantity::INT END AS number FROM lineitem")
def heading_split(spark, d):
    n = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"))
    k = F.col("l_linenumber") % 3
    title = F.when(k == 0, F.concat(n, F.lit(". Title"))).when(k == 1, F.concat(n, F.lit("Title"))).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("th edition")))
    return L.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.heading_number(title).alias("number"))


@query("SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS initials FROM part")
def initials(spark, d):
    return L.table(spark, d, "part").select("p_partkey", X.initials(F.col("p_name")).alias("initials"))


@query(
    """SELECT p_partkey, (abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 9)::INT AS colour FROM part"""
)
def cover_palette(spark, d):
    return L.table(spark, d, "part").select("p_partkey", X.palette(F.col("p_name")).alias("colour"))


@query("SELECT p_partkey, repeat('`', greatest(3, p_size % 7 + 1)::INT) AS fence FROM part")
def fence_length(spark, d):
    code = F.concat(F.lit("a `` b "), F.repeat(F.lit("`"), (F.col("p_size") % 7).cast("int")), F.lit(" c"))
    return L.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 >= 2, X.fence(code)).otherwise(X.fence(F.lit("x"))).alias("fence"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size::VARCHAR END AS page FROM part")
def trailing_page(spark, d):
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" and so on"))).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" ..... "), size)).otherwise(F.concat("p_name", F.lit("  "), size))
    return L.table(spark, d, "part").select("p_partkey", X.trailing_page(line).alias("page"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '')) AS base, regexp_replace(url, '/?[^/]*$', '') AS dir FROM pages")
def path_parts(spark, d):
    return L.table(spark, d, "pages").select("page_id", X.base_name(F.col("url")).alias("base"), X.dir_name(F.col("url")).alias("dir"))


@query("SELECT doc_id, n = 'a/b' AS safe FROM (SELECT doc_id, ['a/b', '../x', '/abs', 'a\\b', '', 'a//b', './a', 'a/.'][doc_id % 8 + 1] AS n FROM documents)")
def safe_names(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("a/b", "../x", "/abs", "a\\b", "", "a//b", "./a", "a/.")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return L.table(spark, d, "documents").select("doc_id", X.safe_name(name).alias("safe"))


@query("SELECT doc_id, ['png', 'jpg', 'webp', NULL][doc_id % 4 + 1] AS kind FROM documents")
def image_types(spark, d):
    heads = ("89504E470D0A1A0A0000", "FFD8FFE000104A464946", "52494646AAAAAAAA57454250", "25504446")
    head = F.element_at(F.array(*[F.lit(x) for x in heads]), (F.col("doc_id") % 4 + 1).cast("int"))
    return L.table(spark, d, "documents").select("doc_id", X.image_type(F.unhex(head)).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'front_matter' WHEN 1 THEN 'toc' WHEN 2 THEN 'appendix' ELSE 'body' END AS role FROM part")
def role_map(spark, d):
    """Role aliases by a join with a small fixed table; unknown names are body text."""
    given = F.element_at(F.array(*[F.lit(x) for x in ("Front-Matter", "contents", "appendices", "whatever")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = L.table(spark, d, "part").select("p_partkey", F.replace(F.lower(given), F.lit("-"), F.lit("_")).alias("given"))
    roles = spark.createDataFrame([("front_matter", "front_matter"), ("contents", "toc"), ("appendices", "appendix")], "given string, role string")
    return parts.join(F.broadcast(roles), "given", "left").select("p_partkey", F.coalesce("role", F.lit("body")).alias("role"))
