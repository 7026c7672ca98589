"""Queries that place contents entries and folders, over stand-ins made from the driver's tables.

A customer is a book: its lineitems are headings, three to a page, its orders
contents entries whose titles are parts' names.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import organize, placing
from ..operators.ranking import shared_dir, written
from ..session import workers_import
from ..sources import library as L
from ..sources import versions
from .registry import query


def _books(spark, d):
    part = L.table(workers_import(spark), d, "part").select("p_partkey", "p_name").hint("merge")  # names are far larger in memory than in their file
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey")
    w = Window.partitionBy("book").orderBy("o_orderkey", "l_linenumber", "l_partkey")
    lines = L.table(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey").withColumn("n", F.row_number().over(w) - 1)
    lines = written(lines, "lines")
    name = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    title = F.when(F.col("n") % 4 == 0, F.concat(F.lit("Chapter "), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit(": "), "p_name")).when(F.col("n") % 4 == 1, F.concat("p_name", F.lit(" again"))).otherwise(F.col("p_name"))
    headings = name.select("book", F.floor(F.col("n") / 3).cast("int").alias("page"), (F.col("n") % 3).cast("int").alias("item"), title.alias("title"))
    first = lines.groupBy("o_orderkey").agg(F.min("n").alias("n"))
    parts = F.col("o_orderkey") % F.lit(part.count())
    entry = F.row_number().over(Window.partitionBy("book").orderBy("o_orderkey"))
    e = o.withColumn("entry", entry).join(first, "o_orderkey", "left").withColumn("p_partkey", parts).join(part, "p_partkey")
    k = F.col("entry")
    kind = F.when(k % 3 == 0, "chapter").when(k % 5 == 0, "part").otherwise("matter")
    entries = e.select("book", "entry", kind.alias("kind"), F.when(kind != "matter", k.cast("string")).alias("number"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.floor(F.col("n") / 3) + 1 + k % 3).cast("int").alias("printed"))
    page = written(lines.select("book", F.floor(F.col("n") / 3).cast("int").alias("page")).distinct(), "pages")
    pages = page.select("book", "page", (F.col("page") + 5 + F.floor(F.col("page") / 4)).cast("int").alias("number"), (F.col("page") > 0).alias("body"))
    return entries, headings.where("page > 0"), pages


_BOOKS = """n AS (SELECT o_custkey AS book, o_orderkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey) - 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT book, n // 3 AS page, (n // 3) * 16777216 + n % 3 AS pos, lower(CASE WHEN n % 4 = 1 THEN p_name || ' again' ELSE p_name END) AS words, CASE WHEN n % 4 = 0 THEN (l_partkey % 9 + 1)::VARCHAR END AS mark FROM n JOIN part ON l_partkey = p_partkey WHERE n >= 3),
w AS (SELECT DISTINCT book, n // 3 AS page, n // 3 + 5 + n // 3 // 4 AS number FROM n),
b AS (SELECT book, max(page) + 1 AS pages, max(number) AS last, coalesce(min(page) FILTER (page > 0), max(page) + 1) AS first FROM w GROUP BY book),
r AS (SELECT o_custkey AS book, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entry FROM orders),
e AS (SELECT r.book, entry, CASE WHEN entry % 3 = 0 OR entry % 5 = 0 THEN entry::VARCHAR END AS number, p_name AS title, lower(p_name) AS words,
  CASE WHEN entry % 3 = 0 THEN 'chapter' WHEN entry % 5 = 0 THEN 'part' ELSE 'matter' END AS kind, CASE WHEN entry % 2 = 0 THEN first // 3 + 1 + entry % 3 END AS printed
  FROM r LEFT JOIN (SELECT o_orderkey, min(n) AS first FROM n GROUP BY 1) USING (o_orderkey) JOIN part ON p_partkey = r.o_orderkey % (SELECT count(*) FROM part)),
f AS (SELECT book, entry, pos, page, CASE WHEN number = mark OR e.words = h.words THEN 2 WHEN length(e.words) >= 6 AND length(h.words) >= 6 AND (starts_with(e.words, h.words) OR starts_with(h.words, e.words)) THEN 1 ELSE 0 END AS fit FROM e JOIN h USING (book)),
x AS (SELECT DISTINCT book AS g, entry AS e, pos AS h FROM f WHERE fit = 2),
step(g, e, h, n) AS (SELECT g, e, h, 1 FROM x UNION ALL SELECT DISTINCT b.g, b.e, b.h, a.n + 1 FROM step a JOIN x b ON a.g = b.g AND a.e < b.e AND a.h < b.h),
l AS (SELECT g, e, h, max(n) AS n FROM step GROUP BY ALL),
chain(g, n, x) AS (SELECT g, n, min({'e': e, 'h': h}) FROM l WHERE n = (SELECT max(n) FROM l m WHERE m.g = l.g) GROUP BY g, n
  UNION ALL SELECT c.g, c.n - 1, min({'e': l.e, 'h': l.h}) FROM chain c JOIN l ON l.g = c.g AND l.n = c.n - 1 AND l.e < c.x.e AND l.h < c.x.h GROUP BY c.g, c.n),
k AS (SELECT e.book, e.entry, e.printed, c.x.h AS anchor, c.x.h // 16777216 AS anchor_page, w.number - e.printed AS off, b.pages, b.last, b.first FROM e LEFT JOIN chain c ON c.g = e.book AND c.x.e = e.entry LEFT JOIN w ON w.book = e.book AND w.page = c.x.h // 16777216 LEFT JOIN b ON b.book = e.book),
o AS (SELECT *, printed + coalesce(last_value(off IGNORE NULLS) OVER (PARTITION BY book ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(off IGNORE NULLS) OVER a) AS expected, coalesce(first_value(anchor_page IGNORE NULLS) OVER a, pages) AS lim FROM k
  WINDOW a AS (PARTITION BY book ORDER BY entry ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
q AS (SELECT o.*, w.page AS predicted FROM o LEFT JOIN w ON w.book = o.book AND w.number = o.expected),
walk(book, entry, cursor, pos, how) AS (SELECT book, 0::BIGINT, any_value(first) * 16777216, NULL::BIGINT, NULL::VARCHAR FROM q GROUP BY book
  UNION ALL SELECT book, entry, coalesce(coalesce(hit, top) + 1, cursor), coalesce(hit, top), CASE WHEN hit IS NOT NULL THEN 'title' WHEN top IS NOT NULL THEN 'page' END FROM (
    SELECT q.book, q.entry, s.cursor, CASE WHEN q.anchor >= s.cursor THEN q.anchor ELSE min(f.pos) END AS hit, CASE WHEN q.predicted > s.cursor // 16777216 AND q.predicted < q.lim THEN q.predicted * 16777216 END AS top
    FROM walk s JOIN q ON q.book = s.book AND q.entry = s.entry + 1 LEFT JOIN f ON f.book = q.book AND f.entry = q.entry AND f.fit > 0 AND f.pos >= s.cursor AND f.page <= q.lim AND (q.predicted IS NULL OR abs(f.page - q.predicted) <= 2)
    GROUP BY q.book, q.entry, s.cursor, q.anchor, q.predicted, q.lim)),
u AS (SELECT s.book, s.entry, row_number() OVER (PARTITION BY s.book ORDER BY s.entry) AS r, (SELECT list(f.pos) FROM f WHERE f.book = s.book AND f.entry = s.entry AND f.fit = 2 AND NOT EXISTS (SELECT 1 FROM walk t WHERE t.book = f.book AND t.pos = f.pos)) AS spots
  FROM walk s JOIN q ON q.book = s.book AND q.entry = s.entry WHERE s.pos IS NULL AND NOT coalesce(q.expected > q.last, false)),
later(book, r, taken, pos) AS (SELECT DISTINCT book, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM u
  UNION ALL SELECT book, r, CASE WHEN len(free) = 1 THEN list_append(taken, free[1]) ELSE taken END, CASE WHEN len(free) = 1 THEN free[1] END FROM (
    SELECT u.book, u.r, v.taken, list_filter(coalesce(u.spots, []::BIGINT[]), lambda i: NOT list_contains(v.taken, i)) AS free FROM later v JOIN u ON u.book = v.book AND u.r = v.r + 1)),
placed AS (SELECT q.book, q.entry, coalesce(s.pos, v.pos) AS pos, CASE WHEN v.pos IS NOT NULL THEN 'out_of_order' ELSE s.how END AS how, q.expected, coalesce(q.expected > q.last, false) AS beyond
  FROM q LEFT JOIN walk s ON s.book = q.book AND s.entry = q.entry LEFT JOIN u ON u.book = q.book AND u.entry = q.entry LEFT JOIN later v ON v.book = u.book AND v.r = u.r)"""


@query(f"""WITH RECURSIVE {_BOOKS}
SELECT book, entry::INT AS entry, (pos // 16777216)::INT AS page, (pos % 16777216)::INT AS item, how, expected::INT AS expected, CASE WHEN pos IS NULL THEN CASE WHEN beyond THEN 'beyond_source' ELSE 'unplaced' END END AS problem FROM placed""")
def contents_placed(spark, d):
    """Every entry of every book with its place, how it was found, or why not."""
    return placing.place_entries(*_books(spark, d))


@query(f"""WITH RECURSIVE {_BOOKS},
s AS (SELECT p.book, p.pos, e.*, row_number() OVER (PARTITION BY p.book ORDER BY pos) AS place, bool_or(kind <> 'matter') OVER (PARTITION BY p.book ORDER BY pos) AS after FROM placed p JOIN e ON e.book = p.book AND e.entry = p.entry WHERE pos IS NOT NULL),
t AS (SELECT *, CASE WHEN kind <> 'matter' THEN kind WHEN after THEN 'back_matter' ELSE 'front_matter' END AS role FROM s)
SELECT book, place::INT AS place, entry::INT AS entry, (pos // 16777216)::INT AS page, (pos % 16777216)::INT AS item, role, number, title,
  slug || CASE WHEN row_number() OVER (PARTITION BY book, slug ORDER BY place) > 1 THEN '-' || row_number() OVER (PARTITION BY book, slug ORDER BY place) ELSE '' END AS slug,
  CASE WHEN role = 'chapter' THEN nullif(last_value(CASE role WHEN 'part' THEN place WHEN 'front_matter' THEN 0 WHEN 'back_matter' THEN 0 END IGNORE NULLS) OVER (PARTITION BY book ORDER BY place), 0)::INT END AS part
FROM (SELECT *, replace(lower(title), ' ', '-') AS slug FROM t)""")
def contents_elements(spark, d):
    """The elements that the placed entries make: roles, parts, slugs."""
    entries, headings, pages = _books(spark, d)
    return placing.elements(entries, placing.place_entries(entries, headings, pages))


def _orders(spark, d):
    """A customer's orders with the name of a part each, and his lineitems with theirs, both numbered."""
    part = L.table(workers_import(spark), d, "part").select("p_partkey", "p_name").hint("merge")  # names are far larger in memory than in their file
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey")
    count = part.count()
    titled = o.join(part, F.col("p_partkey") == F.col("o_orderkey") % count)
    w = Window.partitionBy("book").orderBy("o_orderkey", "l_linenumber", "l_partkey")
    lines = L.table(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey").withColumn("n", F.row_number().over(w) - 1)
    return titled, lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


_ORDERS = """o AS (SELECT o_custkey AS book, o_orderkey, p_name FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
n AS (SELECT o_custkey AS book, o_orderkey, p_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey) - 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH RECURSIVE {_ORDERS},
c AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY o_orderkey) AS number, replace(p_name, ' ', '') AS t FROM o),
d AS (SELECT DISTINCT book, lpad((n % 90 + 1)::VARCHAR, 2, '0') || '_' || replace(p_name, ' ', '_') || CASE WHEN n % 5 = 0 THEN '_more' ELSE '' END AS folder FROM n),
f AS (SELECT *, substr(folder, 1, 2)::INT AS no, replace(substr(folder, 4), '_', '') AS k FROM d),
w AS (SELECT c.book, c.number, coalesce(list(folder ORDER BY CASE WHEN starts_with(k, t) OR starts_with(t, k) THEN 0 ELSE 1 END, folder) FILTER (folder IS NOT NULL), []::VARCHAR[]) AS wishes
  FROM c LEFT JOIN f ON f.book = c.book AND (starts_with(k, t) OR starts_with(t, k) OR no = number) GROUP BY ALL),
walk(book, number, used, folder) AS (SELECT DISTINCT book, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR FROM c
  UNION ALL SELECT book, number, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END, free[1] FROM (
    SELECT w.book, w.number, s.used, list_filter(w.wishes, lambda i: NOT list_contains(s.used, i)) AS free FROM walk s JOIN w ON w.book = s.book AND w.number = s.number + 1))
SELECT book, number::INT AS number, folder FROM walk WHERE folder IS NOT NULL""")
def folders_matched(spark, d):
    """Each chapter's folder, each folder once: in SQL chapter by chapter, in Spark in rounds."""
    o, lines = _orders(spark, d)
    chapters = o.select("book", F.row_number().over(Window.partitionBy("book").orderBy("o_orderkey")).alias("number"), F.col("p_name").alias("title"))
    name = F.concat(F.lpad((F.col("n") % 90 + 1).cast("string"), 2, "0"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("n") % 5 == 0, "_more").otherwise(""))
    return organize.match_folders(chapters, lines.select("book", name.alias("folder")).distinct())


@query(f"""WITH RECURSIVE {_ORDERS},
s AS (SELECT o.book, o.o_orderkey % 3 AS number, row_number() OVER (PARTITION BY o.book, o.o_orderkey % 3 ORDER BY o.o_orderkey) AS place, replace(p_name, ' ', '') AS t, CASE WHEN o.o_orderkey % 2 = 0 THEN m.n // 3 END AS expected
  FROM o LEFT JOIN (SELECT o_orderkey, min(n) AS n FROM n GROUP BY 1) m USING (o_orderkey)),
h AS (SELECT book, o_orderkey % 3 AS number, row_number() OVER (PARTITION BY book, o_orderkey % 3 ORDER BY n) - 1 AS pos, CASE WHEN n % 7 > 0 THEN n // 3 END AS page,
  CASE WHEN n % 4 = 0 THEN '21' ELSE '' END AS label, replace(p_name, ' ', '') || CASE WHEN n % 3 = 0 THEN 'again' ELSE '' END AS k FROM n),
f AS (SELECT s.book, s.number, s.place, h.pos FROM s JOIN h ON h.book = s.book AND h.number = s.number AND (expected IS NULL OR page IS NULL OR abs(page - expected) <= 2) AND (k = t OR label || k = t OR (length(t) > 6 AND (starts_with(k, t) OR starts_with(label || k, t))))),
walk(book, number, place, seen, pos) AS (SELECT DISTINCT book, number, 0::BIGINT, -1::BIGINT, NULL::BIGINT FROM s
  UNION ALL SELECT s.book, s.number, s.place, coalesce(min(f.pos), w.seen), min(f.pos) FROM walk w JOIN s ON s.book = w.book AND s.number = w.number AND s.place = w.place + 1
    LEFT JOIN f ON f.book = s.book AND f.number = s.number AND f.place = s.place AND f.pos > w.seen GROUP BY s.book, s.number, s.place, w.seen)
SELECT book, number, place::INT AS place, pos FROM walk WHERE place > 0""")
def sections_located(spark, d):
    o, lines = _orders(spark, d)
    lines = written(lines.select("book", "o_orderkey", "n", "p_name"), "lines")
    number = F.col("o_orderkey") % 3
    first = lines.groupBy("o_orderkey").agg(F.min("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("book", "number").orderBy("o_orderkey"))
    sections = o.join(first, "o_orderkey", "left").withColumn("number", number).select("book", "number", place.alias("place"), F.col("p_name").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.floor(F.col("n") / 3)).cast("int").alias("expected"))
    pos = F.row_number().over(Window.partitionBy("book", "number").orderBy("n")) - 1
    title = F.concat("p_name", F.when(F.col("n") % 3 == 0, " again").otherwise(""))
    headings = lines.withColumn("number", number).select("book", "number", pos.alias("pos"), F.when(F.col("n") % 7 > 0, F.floor(F.col("n") / 3)).cast("int").alias("page"), F.when(F.col("n") % 4 == 0, "2.1").otherwise("").alias("label"), title.alias("title"))
    return organize.locate(sections, headings)


@query("""WITH p AS (SELECT lang AS book, source AS folder, doc_id AS file, text, string_split(text, chr(10)) AS l, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS i FROM documents),
q AS (SELECT *, CASE WHEN len(l) >= 3 AND file % 2 = 0 THEN i END AS starts FROM p),
r AS (SELECT *, coalesce(last_value(starts IGNORE NULLS) OVER (PARTITION BY book, folder ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opened FROM q),
s AS (SELECT book, folder, file, opened AS owner, CASE WHEN starts IS NULL THEN text ELSE array_to_string(l[1:2], chr(10)) || chr(10) END AS text FROM r
  UNION ALL SELECT book, folder, file, starts, array_to_string(l[3:], chr(10)) FROM r WHERE starts IS NOT NULL)
SELECT book, folder, file, owner::INT AS owner, md5(text) AS text_md5, true AS split FROM s WHERE text <> '' OR NOT EXISTS (SELECT 1 FROM s t WHERE t.file = s.file AND t.text <> '')""")
def folders_split(spark, d):
    """Every second document is cut before its third line; all pieces join again."""
    doc = L.table(spark, d, "documents").select(F.col("lang").alias("book"), F.col("source").alias("folder"), F.col("doc_id").alias("file"), "text")
    pages = doc.withColumn("place", F.col("file"))
    index = (F.row_number().over(Window.partitionBy("book", "folder").orderBy("file")) - 1).alias("index")
    starts = doc.select("book", "folder", "file", "text", index).where((F.size(F.split("text", "\n")) >= 3) & (F.col("file") % 2 == 0)).select("book", "folder", "file", F.lit(3).alias("line"), "index")
    return organize.split_folders(pages, starts).select("book", "folder", "file", "owner", F.md5(F.col("text").cast("binary")).alias("text_md5"), "split")


@query("""WITH s AS (SELECT lang AS book, doc_id, CASE WHEN lang = 'fr' THEN md5(text) ELSE text END AS text FROM documents WHERE lang <> 'es' OR doc_id % 2 = 0)
SELECT book, 'sections' AS table_name, count(*) AS rows, max(md5(text)) AS last FROM s GROUP BY book
UNION ALL SELECT book, 'sources', count(DISTINCT source), max(md5(source)) FROM (SELECT lang AS book, source FROM documents WHERE lang <> 'fr') GROUP BY book""")
def versions_loaded(spark, d):
    """Books loaded one after the other, one loaded anew with other texts and fewer tables, one with half its sections: what the last version shows."""
    import uuid

    doc = L.table(spark, d, "documents").select(F.col("lang").alias("book"), "doc_id", "source", "text")
    sections = lambda df: df.select("book", "doc_id", "text")
    sources = lambda df: df.select("book", "source").distinct()
    root = f"{shared_dir(spark)}/quillstack/versions-{uuid.uuid4().hex}"
    some, rest = doc.where("book in ('en', 'fr')"), doc.where("book not in ('en', 'fr')")
    versions.load(spark, root, {"sections": sections(some), "sources": sources(some)})
    versions.load(spark, root, {"sections": sections(rest), "sources": sources(rest)})
    versions.reload(spark, root, {"sections": sections(doc.where("book = 'fr'")).withColumn("text", F.md5(F.col("text").cast("binary")))})
    half = doc.where("book = 'es'")
    versions.reload(spark, root, {"sections": sections(half.where("doc_id % 2 = 0")), "sources": sources(half)})
    hashed = lambda name, c: versions.read(spark, root, name).groupBy("book").agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.max(F.md5(F.col(c).cast("binary"))).alias("last"))
    return hashed("sections", "text").unionByName(hashed("sources", "source"))
