"""Queries on catalogue filters, guards, orders and editorial state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog_filters as C
from ..operators import structure
from ..session import workers_import
from ..sources import library as L
from .registry import query


@query("SELECT book_id, title FROM book WHERE (lower(title) LIKE '%7%' OR lower(author) LIKE '%7%') AND category_id IN (SELECT id FROM category WHERE id = 'r1' OR parent_id = 'r1') AND language = 'fr' AND book_id IN (SELECT o_custkey FROM orders)", "catalogue")
def catalogue_filter(spark, d):
    books, categories, chapters = L.catalogue(spark, d)
    return C.catalogue(books, categories, "7 ", "r1", "fr", chapters).select("book_id", "title")


@query("SELECT c_custkey AS book_id, c_name AS title FROM customer WHERE c_custkey = 77")
def book_by_key(spark, d):
    return C.by_key(L.catalogue(spark, d)[0], "book_id", 77).select("book_id", "title")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')")
def glossary_filter(spark, d):
    terms = L.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("term"), F.col("p_brand").alias("expansion"))
    return C.glossary_filter(terms, " Brand#1").select("p_partkey")


@query("SELECT user_id, event_id FROM (SELECT *, event_type = 'purchase' AS f, CASE WHEN value IS NOT NULL THEN value > 90 END AS w FROM events) WHERE f OR w")
def shelf_saved(spark, d):
    e = L.table(spark, d, "events").withColumns({"favorite": F.col("event_type") == "purchase", "wishlist": F.col("value") > 90})
    return C.saved(e).select("user_id", "event_id")


@query("SELECT s.id, s.title, s.role, c.n AS chapter_sections FROM sections s JOIN (SELECT chapter, count(*) AS n FROM sections GROUP BY 1) c ON c.chapter = s.chapter", "sections")
def section_headers(spark, d):
    s = L.sections(spark, d).withColumn("draft_markdown", F.col("text"))
    chapters = s.groupBy("chapter").agg(F.count("*").alias("chapter_sections"))
    return C.section_header(s, chapters).drop("text", "chapter", "parent_id", "book", "status", "sort_order")


@query("SELECT user_id AS section_id, event_id AS revision_id, props FROM events WHERE event_id % 5 <> 2")
def revision_guard(spark, d):
    """Revisions asked for with another section's id are not given."""
    rev = L.table(spark, d, "events").select(F.col("user_id").alias("section_id"), F.col("event_id").alias("revision_id"), "props")
    asked = rev.select(F.when(F.col("revision_id") % 5 == 2, F.col("section_id") + 1).otherwise(F.col("section_id")).alias("section_id"), "revision_id")
    return C.owned_revision(rev, asked)


@query("SELECT p_name AS name FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 45) = 0")
def pending_migrations(spark, d):
    p = L.table(spark, d, "part").select(F.col("p_name").alias("name"), "p_size")
    return C.pending(p.select("name").distinct(), p.where("p_size > 45").select("name").distinct())


@query("SELECT c_mktsegment, c_nationkey, min(c_custkey) AS id FROM customer GROUP BY ALL")
def oldest_account(spark, d):
    c = L.table(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    return C.oldest(c, ["c_mktsegment", "c_nationkey"], "c_custkey").select("c_mktsegment", "c_nationkey", "id")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 6")
def reading_list(spark, d):
    """A list's six entries a reader."""
    return C.capped(L.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 6).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END) AS place FROM orders")
def page_file_order(spark, d):
    """Folders whose names all have page numbers (here falling ones) and others in natural order."""
    o, k = L.table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("x"), k, F.lit("_page_"), (F.lit(99999999) - F.col("o_orderkey")).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("part "), k, F.lit(".md")))
    return C.page_order(o.withColumn("name", name), ["o_custkey"]).select("o_custkey", "o_orderkey", "place")


_ENTRY = "entry AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'part' WHEN 'error' THEN 'matter' ELSE 'chapter' END AS kind, CASE WHEN event_type = 'view' THEN (event_id % 40)::VARCHAR END AS number, props AS title FROM events)"


def _entries(spark, d):
    kind = F.when(F.col("event_type") == "signup", "part").when(F.col("event_type") == "error", "matter").otherwise("chapter")
    return L.table(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), F.when(F.col("event_type") == "view", (F.col("event_id") % 40).cast("string")).alias("number"), F.col("props").alias("title"))


@query(f"WITH {_ENTRY} SELECT user_id, event_id FROM entry QUALIFY row_number() OVER (PARTITION BY user_id, kind, number, CASE WHEN number IS NULL THEN lower(title) END ORDER BY event_id) = 1")
def first_mention(spark, d):
    return C.first_seen(_entries(spark, d), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query(f"""WITH {_ENTRY}, r AS (SELECT *, count(*) FILTER (kind = 'matter') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM entry)
SELECT user_id, event_id, CASE WHEN kind = 'chapter' THEN last_value(CASE WHEN kind = 'part' THEN title END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS part FROM r""")
def part_carried(spark, d):
    return C.with_part(_entries(spark, d), ["user_id"], ["event_id"]).select("user_id", "event_id", "part")


@query("SELECT l_orderkey, l_linenumber, l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey) AS level FROM lineitem")
def indent_levels(spark, d):
    li = L.table(spark, d, "lineitem").withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("l_linenumber")), F.lit("x")))
    return C.indent_levels(li, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "level")


@query("SELECT c_nationkey, string_agg(n, '|' ORDER BY n) AS names FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS n FROM customer) GROUP BY 1")
def author_names(spark, d):
    c = L.table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.concat(F.lit(" "), "c_mktsegment", F.lit("  "))).alias("names"))
    return c.select("c_nationkey", F.array_join(F.array_sort(C.author_names(F.concat("names", F.array(F.lit(" "))))), "|").alias("names"))


@query("SELECT b.book, count(s.id) FILTER (s.role = 'toc') AS sections FROM books b LEFT JOIN sections s ON s.book = b.book GROUP BY 1", "sections", "books")
def import_table(spark, d):
    s = L.sections(spark, d).withColumn("role", F.when(F.col("role") == "toc", "section").otherwise("body"))
    return C.import_counts(L.books(spark, d).select("book"), s)


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'load' WHEN o_orderstatus = 'O' THEN 'reload' ELSE 'skip' END AS action, count(*) AS n FROM orders GROUP BY 1")
def import_actions(spark, d):
    return C.actions(L.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "load").when(F.col("o_orderstatus") == "O", "reload").otherwise("skip").alias("action")))


@query("""WITH down AS (SELECT id AS root, id FROM sections UNION ALL SELECT d.root, s.id FROM sections s JOIN down d ON s.parent_id = d.id)
SELECT root AS id, count(line_no) AS n FROM down LEFT JOIN blocks b ON b.section_id = down.id GROUP BY 1""", "sections", "blocks")
def blocks_below(spark, d):
    s = L.sections(spark, d)
    return C.blocks_below(s, L.blocks(s))


@query("""WITH o AS (SELECT min(p_partkey) AS id, p_name AS name FROM part WHERE p_size < 20 GROUP BY p_name), w AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT name FROM o))
SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY name), name FROM w""")
def upsert_authors(spark, d):
    p = L.table(spark, d, "part")
    old = p.where("p_size < 20").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return C.upsert_names(old, p.select(F.col("p_name").alias("name")))


@query("""WITH RECURSIVE u AS (SELECT c_custkey AS id, 'N' || c_nationkey || '@x' AS email, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS subject, c_custkey % 17 AS created_at, c_custkey % 3 = 1 AS relink FROM customer),
l AS (SELECT 'new' || s_suppkey AS subject, 'n' || s_nationkey || '@x' AS email, s_suppkey % 4 > 0 AS verified, s_suppkey AS since FROM supplier UNION ALL SELECT 's' || c_custkey, 'moved@x', true, c_custkey FROM customer WHERE c_custkey % 6 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY since) AS n FROM l WHERE verified AND subject NOT IN (SELECT subject FROM u WHERE subject IS NOT NULL)),
m AS (SELECT id, lower(email) AS email, row_number() OVER (PARTITION BY lower(email) ORDER BY created_at, id) AS n FROM u WHERE relink),
g AS (SELECT m.id, f.subject FROM m JOIN f USING (email, n)),
o AS (SELECT u.id, u.email, coalesce(g.subject, u.subject) AS subject, u.relink AND g.subject IS NULL AS relink FROM u LEFT JOIN g USING (id))
SELECT o.id, coalesce(l.email, o.email) AS email, o.subject, relink FROM o LEFT JOIN l USING (subject)
UNION ALL SELECT (SELECT max(id) FROM u) + row_number() OVER (ORDER BY subject), email, subject, false FROM l WHERE subject NOT IN (SELECT subject FROM o WHERE subject IS NOT NULL)""")
def relink_accounts(spark, d):
    """Marked accounts go to new subjects of their address, whatever its case; known subjects get a new address; the rest are new accounts."""
    c = L.table(spark, d, "customer")
    key = F.col("c_custkey")
    users = c.select(key.alias("id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("@x")).alias("email"), F.when(key % 3 == 0, F.concat(F.lit("s"), key.cast("string"))).alias("subject"), (key % 17).alias("created_at"), (key % 3 == 1).alias("relink"))
    s = L.table(spark, d, "supplier")
    new = s.select(F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("subject"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("@x")).alias("email"), (F.col("s_suppkey") % 4 > 0).alias("verified"), F.col("s_suppkey").alias("at"))
    moved = c.where(key % 6 == 0).select(F.concat(F.lit("s"), key.cast("string")).alias("subject"), F.lit("moved@x").alias("email"), F.lit(True).alias("verified"), key.alias("at"))
    return C.relink(users, new.unionByName(moved)).select("id", "email", "subject", "relink")


@query("SELECT l_orderkey AS book, l_partkey AS author FROM lineitem WHERE l_orderkey % 4 <> 1 UNION ALL SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 4 = 1")
def replace_authors(spark, d):
    li = L.table(spark, d, "lineitem")
    links = li.select(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("author"))
    return C.replace_links(links, li.where("l_orderkey % 4 = 1").select(F.col("l_orderkey").alias("book"), F.col("l_suppkey").alias("author")), "book")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def guarded_delete(spark, d):
    """Rows that something refers to stay."""
    s = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    stay, _ = C.delete_unused(s, s.where("id % 2 = 0"), [(L.table(spark, d, "lineitem").where("l_quantity > 45"), "l_suppkey")])
    return stay


@query("""WITH s AS (SELECT p_partkey AS id, p_partkey % 40 AS section, p_brand AS markdown, p_size FROM part), t AS (SELECT * FROM s WHERE p_size % 9 > 0)
SELECT section AS id, arg_max(markdown, id) AS draft_markdown, count(*) AS revisions FROM t GROUP BY section
UNION ALL SELECT p_partkey, p_name, 0 FROM part WHERE p_partkey NOT IN (SELECT section FROM t)""")
def draft_revisions(spark, d):
    """Many drafts of forty sections, some without a text, unchanged ones too: the last one stays, each is a revision."""
    p = L.table(spark, d, "part")
    sections = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("draft_markdown"))
    drafts = p.select((F.col("p_partkey") % 40).alias("id"), F.when(F.col("p_size") % 9 > 0, F.col("p_brand")).alias("markdown"), F.col("p_partkey").alias("saved_at"))
    now, revisions = C.save_drafts(sections, spark.createDataFrame([], "section_id long, markdown string, saved_at long"), drafts)
    counts = revisions.groupBy(F.col("section_id").alias("id")).agg(F.count("*").alias("revisions"))
    return now.join(counts, "id", "left").select("id", "draft_markdown", F.coalesce("revisions", F.lit(0)).alias("revisions"))


@query("SELECT conv_id AS revision_id, CASE WHEN conv_id % 3 = 0 THEN 'own' ELSE string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) END AS markdown FROM conversations GROUP BY conv_id")
def restore_revision(spark, d):
    c = L.table(spark, d, "conversations")
    place = F.struct("turn", "role", "text")
    rev = c.select(F.col("conv_id").alias("revision_id"), F.col("conv_id").alias("section_id")).distinct().withColumn("markdown", F.when(F.col("revision_id") % 3 == 0, "own"))
    return C.restore(rev, c.select(F.col("conv_id").alias("revision_id"), place.alias("sort_order"), F.coalesce("text", F.lit("")).alias("markdown"))).select("revision_id", "markdown")


@query("SELECT s.id, CASE WHEN s.parent_id IS NULL THEN 0 WHEN p.chapter IS NOT DISTINCT FROM s.chapter THEN (p.id % 5 + 1)::INT END AS depth, s.parent_id IS NULL OR coalesce(p.chapter IS NOT DISTINCT FROM s.chapter AND p.id IS NOT NULL, false) AS allowed FROM sections s LEFT JOIN sections p ON p.id = s.parent_id", "sections")
def parent_guard(spark, d):
    s = L.sections(spark, d)
    return C.new_subsections(s.select("id", "chapter", (F.col("id") % 5).cast("int").alias("depth")), s.select("id", "chapter", "parent_id")).select("id", "depth", "allowed")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN status ELSE 'new' END AS status FROM sections", "sections")
def status_carried(spark, d):
    s = L.sections(spark, d).select("id", "status", F.lit(None).cast("string").alias("draft_markdown"))
    matches = s.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"), F.when(F.col("id") % 7 == 0, "title").otherwise("chapter").alias("how"))
    return C.carry_status(matches, s, s.withColumn("status", F.lit("new"))).select("id", "status")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_nationkey < 5 THEN 'editor' ELSE 'reader' END AS role FROM customer")
def grant_editor(spark, d):
    users = L.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("email"), F.when(F.col("c_custkey") % 3 == 0, "s").alias("subject"), F.lit("reader").alias("role"))
    return C.grant(users, spark.range(5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("email"))).select("id", "role")


@query("SELECT o_custkey AS book, max(o_orderkey) FILTER (o_orderkey % 2 = 1) AS odd, max(o_orderkey) AS report FROM orders GROUP BY 1 HAVING max(o_orderkey) FILTER (o_orderkey % 2 = 1) IS NOT NULL")
def latest_reports(spark, d):
    """The new reports stand in place of the books' old ones."""
    o = L.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("book")).agg(F.max(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey"))).alias("odd"), F.max("o_orderkey").alias("report")).where("odd is not null")
    old = o.select("book", "odd", F.col("odd").alias("report"))
    return C.import_reports(old, o.where("odd <> report").select("book", "odd", "report"))


@query("SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END + l_linenumber - 1 AS line FROM lineitem")
def snippet_lines(spark, d):
    return L.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.file_line(F.col("l_partkey"), F.col("l_returnflag") == "R", F.col("l_linenumber")).alias("line"))
