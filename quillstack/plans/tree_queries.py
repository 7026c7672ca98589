"""Queries on the section tree and search."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators import search as S
from ..operators import searchindex as I
from ..operators import tree
from ..session import workers_import
from ..sources import library as L
from ..sources import versions
from .registry import query


def _visible(spark, d):
    return tree.visible_sections(L.sections(spark, d), L.books(spark, d))


@query("SELECT id, book, role FROM visible", "sections", "books", "visible")
def vis_sections(spark, d):
    return _visible(spark, d).select("id", "book", "role")


@query("SELECT id, id IN (SELECT id FROM visible) AS visible FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT -1)", "sections", "books", "visible")
def vis_single(spark, d):
    asked = L.table(spark, d, "documents").select(F.col("doc_id").alias("id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    return tree.is_visible(L.sections(spark, d), L.books(spark, d), asked)


def _index(spark, d):
    """The kept index of these tables: built by the first query that asks for it, and again when a table's files change."""
    root = f"{ranking.shared_dir(spark)}/quillstack/search-{library_mark(spark, d)}"
    if not versions.manifest(spark, root):
        I.build(spark, root, L.sections(workers_import(spark), d))
    return root, tree.visible_sections(I.table(spark, root, "heads"), L.books(spark, d))


def library_mark(spark, d) -> str:
    """A name for the state of the tables that sections come from: their folders, sizes and times."""
    states = []
    for name in ("documents", "labels"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = fs.getContentSummary(path)
        states.append((str(path), held.getLength(), held.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return hashlib.sha256(repr(states).encode()).hexdigest()[:24]


_TERMS = r"t AS (SELECT section_id, line_no, line, regexp_extract_all(lower(line), '[\p{L}\p{N}\p{M}]+') AS terms FROM blocks)"
_ASCII_TERMS = "t AS (SELECT section_id, line_no, line, regexp_extract_all(lower(line), '[a-z0-9]+') AS terms FROM blocks)"


def _library(match: str, words: str, like: str) -> str:
    return f"""
WITH {_TERMS}, h AS (SELECT DISTINCT ON (section_id) section_id, line, len(list_filter(terms, lambda x: x IN ({words}))) AS rank FROM t WHERE {match} ORDER BY section_id, rank DESC, line_no)
SELECT v.id AS section_id, v.title, v.book, round((coalesce(h.rank, 0) + CASE WHEN v.title ILIKE '{like}' THEN 1 ELSE 0 END) * CASE WHEN v.role IN ('toc', 'index') THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score, h.line AS snippet
FROM visible v LEFT JOIN h ON h.section_id = v.id WHERE h.section_id IS NOT NULL OR v.title ILIKE '{like}' ORDER BY score DESC, section_id LIMIT 50"""


_VIEWS = ("sections", "books", "blocks", "visible")


@query(_library("list_contains(terms, 'the') AND list_contains(terms, 'and')", "'the', 'and'", "%the and%"), *_VIEWS)
def search_library(spark, d):
    """The flagship: visible sections ranked by their best block and title."""
    return I.search_library(spark, *_index(spark, d), "the and")


@query(_library("(list_contains(terms, 'they') OR list_contains(terms, 'une')) AND NOT list_contains(terms, 'that')", "'they', 'une'", "%they or une -that%"), *_VIEWS)
def search_exclude(spark, d):
    return I.search_library(spark, *_index(spark, d), "they or une -that")


@query(_library("contains(' ' || array_to_string(terms, ' ') || ' ', ' of the ')", "'of', 'the'", '%"of the"%'), *_VIEWS)
def search_phrase(spark, d):
    return I.search_library(spark, *_index(spark, d), '"of the"')


@query(
    f"""WITH {_TERMS}, h AS (SELECT DISTINCT ON (section_id) section_id, line_no, len(list_filter(terms, lambda x: x = 'with')) AS rank FROM t WHERE list_contains(terms, 'with') ORDER BY section_id, rank DESC, line_no)
SELECT section_id, title, round(h.rank * CASE WHEN v.role IN ('toc', 'index') THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score, line_no FROM visible v JOIN h ON h.section_id = v.id WHERE v.book = 'en' ORDER BY score DESC, section_id LIMIT 20""",
    *_VIEWS,
)
def search_book(spark, d):
    return I.search_book(spark, *_index(spark, d), "en", "with")


@query("SELECT id, title FROM sections WHERE title ILIKE '%th_r%a%'", "sections")
def title_ilike(spark, d):
    """Wildcards in the user's text are live."""
    return L.sections(spark, d).where(F.col("title").ilike("%th_r%a%")).select("id", "title")


@query(
    f"WITH {_ASCII_TERMS} SELECT section_id, term, count(*) AS tf, string_agg(line_no || ':' || pos, ' ' ORDER BY line_no, pos) AS places FROM (SELECT section_id, line_no, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM t) GROUP BY ALL",
    "sections", "blocks",
)
def postings(spark, d):
    dealt = L.sections(spark, d).select("id", "text").repartition("id")  # texts move once, their words not at all
    each = S.with_terms(L.blocks(dealt)).select("section_id", "line_no", F.posexplode("terms").alias("pos", "term"))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "pos")))
    return each.groupBy("section_id", "term").agg(F.count("*").alias("tf"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["pos"].cast("string"))), " ").alias("places"))


@query(
    r"""SELECT section_id, line_no, regexp_replace(replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '(?i)\b(the|and)\b', '<mark>\1</mark>', 'g') AS marked FROM blocks""",
    "sections", "blocks",
)
def snippet_marked(spark, d):
    return L.blocks(L.sections(spark, d)).select("section_id", "line_no", S.marked(F.col("line"), ["the", "and"]).alias("marked"))


@query(
    """WITH outline AS (SELECT id, 0 AS depth, [sort_order] AS path FROM sections WHERE parent_id IS NULL
  UNION ALL SELECT s.id, o.depth + 1, list_append(o.path, s.sort_order) FROM sections s JOIN outline o ON s.parent_id = o.id)
SELECT id, depth, array_to_string(path, '/') AS path, row_number() OVER (ORDER BY path) AS place FROM outline""",
    "sections",
)
def outline_order(spark, d):
    o = ranking.numbered(tree.outline(L.sections(spark, d)), ["path", "id"])
    return o.select("id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "place")


@query(
    """WITH up AS (SELECT id AS asked, id, parent_id, title, 0 AS lvl FROM sections
  UNION ALL SELECT u.asked, s.id, s.parent_id, s.title, u.lvl + 1 FROM sections s JOIN up u ON s.id = u.parent_id)
SELECT asked, (max(lvl) OVER (PARTITION BY asked) - lvl)::INT AS level, id, title FROM up""",
    "sections",
)
def breadcrumbs(spark, d):
    s = L.sections(spark, d)
    return tree.breadcrumbs(s, s.select("id"))


@query("SELECT v.id, v.chapter, p.id AS parent FROM visible v LEFT JOIN visible p ON p.id = v.parent_id", "sections", "books", "visible")
def toc_effective_parent(spark, d):
    return tree.effective_parent(_visible(spark, d))


@query("SELECT DISTINCT s.book, s.chapter FROM sections s WHERE EXISTS (SELECT 1 FROM visible v WHERE v.book = s.book AND v.chapter IS NOT DISTINCT FROM s.chapter)", "sections", "books", "visible")
def chapters_nonempty(spark, d):
    return L.sections(spark, d).select("book", "chapter").distinct().join(_visible(spark, d).select("book", "chapter"), ["book", "chapter"], "left_semi")


@query("SELECT id, book, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM visible WINDOW w AS (PARTITION BY book ORDER BY chapter, sort_order)", "sections", "books", "visible")
def prev_next(spark, d):
    return tree.neighbours(_visible(spark, d), ["book"], ["chapter", "sort_order"]).select("id", "book", "prev_id", "next_id")


@query("WITH down AS (SELECT id FROM sections WHERE id IN (3, 7) UNION ALL SELECT s.id FROM sections s JOIN down d ON s.parent_id = d.id) SELECT section_id, line_no FROM blocks WHERE section_id NOT IN (SELECT id FROM down)", "sections", "blocks")
def cascade_delete(spark, d):
    """Blocks left when two sections go with all under them."""
    s = L.sections(spark, d)
    _, blocks = tree.cascade_delete(s, s.where("id IN (3, 7)").select("id"), L.blocks(s), "section_id")
    return blocks.select("section_id", "line_no")


@query("SELECT parent_id, coalesce(max(sort_order), -1) + 1 AS next_order FROM sections GROUP BY parent_id", "sections")
def next_sort_order(spark, d):
    return tree.next_sort_order(L.sections(spark, d), ["parent_id"])


@query(
    """SELECT s.parent_id, s.id, (row_number() OVER (PARTITION BY s.parent_id ORDER BY s.id DESC) - 1)::INT AS sort_order FROM sections s WHERE s.parent_id % 3 <> 1""",
    "sections",
)
def reorder_siblings(spark, d):
    """Children turned round; the lists that leave one out are refused."""
    s = L.sections(spark, d).where("parent_id is not null")
    wanted = s.groupBy("parent_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))
    wanted = wanted.withColumn("ids", F.when(F.col("parent_id") % 3 == 1, F.slice("ids", 2, 100)).otherwise(F.col("ids")))
    return tree.reorder(s, wanted)


@query(
    r"""SELECT s.id, string_agg('## ' || trim(line) || chr(10), '' ORDER BY line_no) AS body FROM blocks b JOIN visible s ON s.id = b.section_id GROUP BY s.id""",
    "sections", "books", "blocks", "visible",
)
def export_markdown(spark, d):
    lines = L.blocks(L.sections(spark, d)).join(_visible(spark, d).select(F.col("id").alias("section_id")), "section_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t"))))
    return lines.groupBy(F.col("section_id").alias("id")).agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("## "), x["t"], F.lit("\n"))), "").alias("body"))


@query("SELECT s.id, s.title FROM sections s WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.section_id = s.id) AND NOT EXISTS (SELECT 1 FROM sections c WHERE c.parent_id = s.id)", "sections", "blocks")
def empty_sections(spark, d):
    from ..operators.structure import empty_sections as op

    s = L.sections(spark, d)
    return op(s, L.blocks(s)).select("id", "title")

