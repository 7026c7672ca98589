"""Queries on outline recovery and reloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as T
from ..sources import library as L
from .registry import query


def _lines(spark, d):
    return L.table(spark, d, "events").withColumn("n", F.floor("value").cast("int"))


@query("SELECT user_id, event_id, n FROM (SELECT *, coalesce(max(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM (SELECT user_id, event_id, floor(value)::INT AS n FROM events)) WHERE n > top")
def monotone_chapters(spark, d):
    return T.increasing(_lines(spark, d), ["user_id"], ["event_id"], "n").select("user_id", "event_id", "n")


@query("SELECT o_custkey, o_orderkey, previous FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderkey > previous + 1")
def chapter_gaps(spark, d):
    return T.gaps(L.table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "previous")


_KNOWN = "SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN floor(value)::INT END AS known FROM events"


def _known(spark, d):
    return _lines(spark, d).select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("n")).alias("known"))


@query(f"SELECT user_id, event_id, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS page_offset FROM ({_KNOWN})")
def asof_offset(spark, d):
    return T.nearest(_known(spark, d), ["user_id"], ["event_id"], "known", "page_offset").select("user_id", "event_id", "page_offset")


@query(f"SELECT user_id, event_id, last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS element FROM ({_KNOWN})")
def boundary_fill(spark, d):
    return T.fill(_known(spark, d), ["user_id"], ["event_id"], "known", "element").select("user_id", "event_id", "element")


@query(f"SELECT user_id, event_id, first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS upper_page FROM ({_KNOWN})")
def next_anchor(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    return _known(spark, d).select("user_id", "event_id", F.first("known", ignorenulls=True).over(w).alias("upper_page"))


@query(
    """SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g"""
)
def runs_merge(spark, d):
    return T.islands(L.table(spark, d, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_type", "first", "last", "n")


@query(
    f"""SELECT user_id, event_id, (coalesce(first(known) OVER (PARTITION BY user_id, b ORDER BY event_id), 0) + row_number() OVER (PARTITION BY user_id, b ORDER BY event_id)
  - CASE WHEN b = 0 THEN 0 ELSE 1 END)::BIGINT AS number FROM (SELECT *, count(known) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM ({_KNOWN}))"""
)
def counter_reset(spark, d):
    out = T.counted(_known(spark, d), ["user_id"], ["event_id"], "known")
    return out.select("user_id", "event_id", F.col("number").cast("long").alias("number"))


@query("SELECT conv_id, turn, CASE WHEN lag(role) OVER w = 'user' THEN lag(text) OVER w END AS lead_in, CASE WHEN lead(role) OVER w = 'user' THEN lead(text) OVER w END AS follow_up FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def leadin_followup(spark, d):
    c = L.table(spark, d, "conversations")
    return T.neighbours_of(c, ["conv_id"], ["turn"], F.col("role") == "user", "text").select("conv_id", "turn", "lead_in", "follow_up")


@query("SELECT id, first_id FROM (SELECT id, first(id) OVER w AS first_id, row_number() OVER w AS n FROM sections WINDOW w AS (PARTITION BY book, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) ORDER BY sort_order)) WHERE n > 1", "sections")
def dup_titles(spark, d):
    return T.duplicate_titles(L.sections(spark, d), ["book"], "title", ["sort_order"]).select("id", "first_id")


_MATCH = """
WITH placed AS (SELECT id, book, chapter, chapter AS chapter_order, title, id % 7 <> 3 AS kept FROM sections),
o AS (SELECT *, row_number() OVER (PARTITION BY book, chapter, title ORDER BY id) AS nth, row_number() OVER (PARTITION BY book, chapter ORDER BY id) AS place, count(*) OVER (PARTITION BY book, chapter) AS size FROM placed),
n AS (SELECT *, row_number() OVER (PARTITION BY book, chapter, title ORDER BY id) AS nth, row_number() OVER (PARTITION BY book, chapter ORDER BY id) AS place, count(*) OVER (PARTITION BY book, chapter) AS size FROM placed WHERE kept),
m AS (SELECT o.id AS old_id, t.id AS t, p.id AS p, c.id AS c, b.b FROM o
  LEFT JOIN n t ON t.book IS NOT DISTINCT FROM o.book AND t.chapter IS NOT DISTINCT FROM o.chapter AND t.title IS NOT DISTINCT FROM o.title AND t.nth = o.nth
  LEFT JOIN n p ON p.book IS NOT DISTINCT FROM o.book AND p.chapter IS NOT DISTINCT FROM o.chapter AND p.place = o.place AND p.size = o.size
  LEFT JOIN n c ON c.book IS NOT DISTINCT FROM o.book AND c.chapter IS NOT DISTINCT FROM o.chapter AND c.place = 1
  LEFT JOIN (SELECT DISTINCT ON (book) book, id AS b FROM n ORDER BY book, chapter_order NULLS FIRST, id) b ON b.book IS NOT DISTINCT FROM o.book),
r AS (SELECT old_id, coalesce(t, p, c, b) AS new_id, CASE WHEN t IS NOT NULL THEN 'title' WHEN p IS NOT NULL THEN 'place' WHEN c IS NOT NULL THEN 'chapter' WHEN b IS NOT NULL THEN 'book' ELSE 'lost' END AS how FROM m)
"""


def _matched(spark, d):
    s = L.sections(spark, d).select("book", "chapter", F.col("chapter").alias("chapter_order"), "id", "title", "sort_order")
    return T.match_sections(s, s.where("id % 7 <> 3"))


@query(_MATCH + "SELECT * FROM r", "sections")
def match_sections(spark, d):
    return _matched(spark, d)


@query(_MATCH + "SELECT old_id % 4 AS kind, count(*) FILTER (how = 'title') AS title, count(*) FILTER (how = 'place') AS place, count(*) FILTER (how = 'chapter') AS chapter, count(*) FILTER (how IN ('book', 'lost')) AS rest FROM r GROUP BY 1", "sections")
def reload_tally(spark, d):
    named = _matched(spark, d).withColumn("how", F.when(F.col("how").isin("book", "lost"), "rest").otherwise(F.col("how")))
    counts = named.groupBy((F.col("old_id") % 4).alias("kind")).pivot("how", ["title", "place", "chapter", "rest"]).count()
    return counts.na.fill(0)


@query(
    """WITH f AS (SELECT doc_id AS id, source || '/p' || (doc_id % 11) || '/page_' || lpad(doc_id::VARCHAR, 4, '0') || '.md' AS file FROM documents WHERE doc_id % 5 > 0),
i AS (SELECT event_id AS issue_id, 'src' || (event_id % 22) || '/p' || (event_id % 13) || '/page_' || lpad((event_id % 1200)::VARCHAR, 4, '0') || '.md' AS file FROM events)
SELECT issue_id, file, coalesce((SELECT min(id) FROM f WHERE f.file = i.file), (SELECT min(id) FROM f WHERE regexp_replace(f.file, '/[^/]*$', '') = regexp_replace(i.file, '/[^/]*$', ''))) AS section_id FROM i"""
)
def issue_to_section(spark, d):
    page = lambda c: F.concat(F.lit("/page_"), F.lpad(c.cast("string"), 4, "0"), F.lit(".md"))
    doc = L.table(spark, d, "documents").where("doc_id % 5 > 0")
    s = doc.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/p"), (F.col("doc_id") % 11).cast("string"), page(F.col("doc_id"))).alias("file"), F.col("doc_id").alias("sort_order"))
    e = F.col("event_id")
    i = L.table(spark, d, "events").select(e.alias("issue_id"), F.concat(F.lit("src"), (e % 22).cast("string"), F.lit("/p"), (e % 13).cast("string"), page(e % 1200)).alias("file"))
    return T.locate_issues(i, s)


@query("SELECT s.book, count(DISTINCT s.id) AS sections, count(b.line_no) AS blocks, count(DISTINCT s.id) || ' sections, ' || count(b.line_no) || ' blocks' AS summary FROM sections s LEFT JOIN blocks b ON b.section_id = s.id GROUP BY s.book", "sections", "blocks")
def element_counts(spark, d):
    s = L.sections(spark, d)
    n = s.join(L.blocks(s), F.col("id") == F.col("section_id"), "left").groupBy("book").agg(F.count_distinct("id").alias("sections"), F.count("line_no").alias("blocks"))
    return n.withColumn("summary", F.format_string("%d sections, %d blocks", "sections", "blocks"))


@query("SELECT substr(source, 1, 4) AS top, lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY GROUPING SETS ((substr(source, 1, 4)), (substr(source, 1, 4), lang))")
def folder_totals(spark, d):
    doc = L.table(spark, d, "documents").withColumn("top", F.substring("source", 1, 4))
    return doc.groupingSets([["top"], ["top", "lang"]], "top", "lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).select("top", "lang", "files", "bytes")
