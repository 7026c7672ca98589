"""Queries on Markdown structure, contents entries and flattened listings, over stand-ins made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contents, listings, markdown, unmangle
from ..sources import library as L
from ..session import workers_import
from .registry import query


def _pages(spark, d):
    """A page a document: its lines become headings, lists, quotes, fences, blanks and paragraphs in turn."""
    def made(line, i):
        k = F.pmod(i + F.col("doc_id"), F.lit(7))
        return F.when(k == 0, F.concat(F.lit("## "), line)).when(k == 1, F.concat(F.lit("- "), line)).when(k == 2, F.concat(F.lit("> "), line)).when(k == 3, F.concat(F.lit("```rust\n"), line, F.lit("\n\n```"))).when(k == 4, F.lit("")).otherwise(F.concat(F.lit("p "), line))

    return _made(L.table(workers_import(spark), d, "documents"), made)


def _made(doc, made):
    """A page a document, made of its lines where they lie; signs but letters, blanks, commas and dots are an x."""
    lines = F.split(F.regexp_replace("text", "[^a-zA-Z ,.\n]", "x"), "\n")
    return doc.select(F.col("doc_id").alias("page_id"), F.array_join(F.transform(lines, made), "\n").alias("source"))


_PARTS = """WITH l AS (SELECT doc_id AS page_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT page_id, i, CASE (i + page_id) % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'blockquote' WHEN 3 THEN 'code' WHEN 4 THEN 'blank' ELSE 'paragraph' END AS t FROM l),
b AS (SELECT page_id, i, t, CASE WHEN t = 'paragraph' AND lag(t) OVER (PARTITION BY page_id ORDER BY i) = 'paragraph' THEN 0 ELSE 1 END AS s FROM k)"""


@query(f"""{_PARTS},
m AS (SELECT b.page_id, b.i, b.t, sum(b.s) OVER (PARTITION BY b.page_id ORDER BY b.i) AS run, regexp_replace(x.line, '[^a-zA-Z ,.]', 'x', 'g') AS line FROM b JOIN (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) x USING (page_id, i)),
g AS (SELECT page_id, run, t AS block_type, string_agg(CASE t WHEN 'heading' THEN '## ' || line WHEN 'list' THEN '- ' || line WHEN 'blockquote' THEN '> ' || line WHEN 'code' THEN '```rust' || chr(10) || line || chr(10) || chr(10) || '```' ELSE 'p ' || line END, chr(10) ORDER BY i) AS markdown FROM m WHERE t <> 'blank' GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY run) - 1 AS sort_order, block_type, markdown FROM g""")
def markdown_blocks(spark, d):
    """Whole blocks with their text."""
    return markdown.blocks(_pages(spark, d)).select("page_id", "sort_order", "block_type", "markdown")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id AS page_id, i AS place, 'f' || regexp_replace(line, '[^a-zA-Z ,.]', 'x', 'g') AS caption FROM l WHERE i % 2 = 1""")
def image_captions(spark, d):
    """Images with a line of emphasis behind them every second time."""
    l = L.table(workers_import(spark), d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    line = F.regexp_replace("line", r"[^a-zA-Z ,.]", "x")
    source = F.concat(F.lit("![a](b"), F.col("i").cast("string"), F.lit(".png)\n\n"), F.when(F.col("i") % 2 == 1, F.concat(F.lit("*f"), line, F.lit("*"))).otherwise(F.concat(F.lit("f"), line)))
    pages = l.select(F.struct("doc_id", "i").alias("page_id"), source.alias("source"))
    return markdown.with_captions(markdown.blocks(pages)).where("caption is not null").select("page_id.doc_id", F.col("page_id.i").alias("place"), "caption").withColumnRenamed("doc_id", "page_id")


@query("SELECT p_partkey, row_id AS row, CASE row_id WHEN 0 THEN 'Name' ELSE p_name || '|' || p_size END AS first, CASE row_id WHEN 0 THEN 'Brand' ELSE p_brand END AS second FROM part, (VALUES (0), (1)) r(row_id)")
def table_cells(spark, d):
    """Tables with and without bars at the ends, with escaped bars in their cells."""
    bar = F.when(F.col("p_size") % 2 == 0, "|").otherwise("")
    source = F.concat(bar, F.lit(" Name | Brand "), bar, F.lit("\n"), bar, F.lit("---|:--:"), bar, F.lit("\n"), bar, "p_name", F.lit("\\|"), F.col("p_size").cast("string"), F.lit(" | "), "p_brand", bar)
    pages = L.table(workers_import(spark), d, "part").select(F.col("p_partkey").alias("page_id"), source.alias("source"))
    return markdown.table_rows(markdown.blocks(pages)).select(F.col("page_id").alias("p_partkey"), "row", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@query("SELECT p_partkey, p_name || ' and ' || p_brand || ' of ' || p_type AS text, 's' || p_brand || '.b' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS element_id FROM part")
def plain_texts(spark, d):
    p = L.table(spark, d, "part")
    md = F.concat(F.lit("## **"), "p_name", F.lit("** and [*"), "p_brand", F.lit("*](x) of `"), "p_type", F.lit("`"))
    rows = p.select("p_partkey", F.col("p_partkey").alias("sort_order"), F.lit("heading").alias("block_type"), F.concat(F.lit("s"), "p_brand").alias("section"), markdown.plain_text(md).alias("text"))
    return markdown.positional_ids(rows).select("p_partkey", "text", "element_id")


@query(f"{_PARTS} SELECT page_id, count(*) AS n, count(*) AS closed, min('rust') AS lang FROM b WHERE t = 'code' GROUP BY page_id")
def code_index(spark, d):
    code = markdown.code_blocks(markdown.blocks(_pages(spark, d)))
    return code.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("closed").alias("closed"), F.min("lang").alias("lang"))


@query("SELECT p_partkey, p_name AS term, p_brand AS expansion, p_size % 5 > 0 AS valid FROM part")
def term_lines(spark, d):
    p = L.table(workers_import(spark), d, "part")
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit(" → "), "p_brand", F.when(F.col("p_size") % 5 == 0, F.lit(" → again")).otherwise("")).alias("source"))
    return markdown.terms(markdown.blocks(pages)).select(F.col("page_id").alias("p_partkey"), "term", "expansion", "valid")


@query(r"""WITH RECURSIVE t AS (SELECT page_id, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS i FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '<(script|style).*?</(script|style)>|<!--.*?-->|<![^>]*>', '', 'gs'), '<[^<>]+>|[^<>]+') AS x FROM pages)),
k AS (SELECT page_id, i, CASE WHEN token IN ('<h1>', '<h2>') THEN '# h' WHEN token[1] = '<' THEN token ELSE 'p ' || regexp_replace(token, '[^a-zA-Z]', 'x', 'g') END AS markdown, CASE WHEN token IN ('<h1>', '<h2>') THEN 'heading' WHEN token[1] = '<' THEN 'html' ELSE 'paragraph' END AS block_type,
  CASE WHEN token[1] = '<' AND token NOT IN ('<h1>', '<h2>') THEN nullif(regexp_extract(token, '^</?([a-z0-9]+)', 1), '') END AS named FROM t),
r AS (SELECT *, CASE WHEN markdown[2] = '/' THEN named WHEN named NOT IN ('meta', 'br', 'img', 'hr', 'link', 'input') THEN named END AS tag FROM k),
walk(page_id, i, stack, opened) AS (SELECT DISTINCT page_id, -1::BIGINT, []::STRUCT(tag VARCHAR, i BIGINT)[], NULL::BIGINT FROM r
  UNION ALL SELECT r.page_id, r.i, CASE WHEN block_type = 'heading' THEN [] WHEN tag IS NULL THEN stack WHEN markdown[2] <> '/' THEN list_append(stack, {'tag': tag, 'i': r.i}) WHEN len(stack) > 0 AND stack[-1].tag = tag THEN stack[1:len(stack) - 1] ELSE stack END,
    CASE WHEN tag IS NOT NULL AND markdown[2] = '/' AND len(stack) > 0 AND stack[-1].tag = tag THEN stack[-1].i END FROM walk w JOIN r ON r.page_id = w.page_id AND r.i = w.i + 1),
m AS (SELECT page_id, opened, i AS closed FROM walk WHERE opened IS NOT NULL)
SELECT r.page_id, r.i AS sort_order, r.block_type, md5(r.markdown) AS markdown_md5, (SELECT markdown FROM r x WHERE x.page_id = r.page_id AND x.i = o.closed) AS close_tag, (SELECT max(opened) FROM m WHERE m.page_id = r.page_id AND opened < r.i AND closed > r.i) AS parent
FROM r LEFT JOIN m o ON o.page_id = r.page_id AND o.opened = r.i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = r.page_id AND m.closed = r.i)""")
def html_wrapped(spark, d):
    """Every tag and text of every page as a block of its own, tags and what they wrap put together again; a heading breaks all open ones."""
    p = L.table(workers_import(spark), d, "pages")
    bare = F.regexp_replace("html", r"(?s)<(script|style).*?</(script|style)>|<!--.*?-->|<![^>]*>", "")
    block = lambda t: F.when(t.isin("<h1>", "<h2>"), "# h").when(t.startswith("<"), t).otherwise(F.concat(F.lit("p "), F.regexp_replace(t, "[^a-zA-Z]", "x")))
    source = F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("(<[^<>]+>|[^<>]+)"), 1), block), "\n\n")
    found = markdown.html_wrappers(markdown.blocks(p.select("page_id", source.alias("source"))))
    return found.select("page_id", "sort_order", "block_type", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"), "close_tag", "parent")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
c AS (SELECT doc_id, i, regexp_replace(line, '[^a-zA-Z ,.]', 'x', 'g') AS line FROM l)
SELECT doc_id AS page_id, i * 2 AS sort_order, CASE i % 3 WHEN 0 THEN 'listItem[0]>code[1]' WHEN 1 THEN 'list[1]>listItem[0]>code[0]' END AS path, 'rust' AS lang, md5(chr(96) || chr(96) || chr(96) || 'rust' || chr(10) || line || chr(10) || chr(96) || chr(96) || chr(96)) AS code_md5,
  i * 20 + CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS start_line FROM c""")
def nested_code(spark, d):
    """Each line as code in a list item, in a list inside a quote, or on its own; a page is a document, twenty lines to each."""
    fence = F.lit("```")

    def made(line, i):
        item = F.concat(F.lit("- a\n  ```rust\n  "), line, F.lit("\n  ```" + "\n" * 16 + "---"))
        quote = F.concat(F.lit("> q\n>\n> - ```rust\n>   "), line, F.lit("\n>   ```" + "\n" * 15 + "---"))
        alone = F.concat(fence, F.lit("rust\n"), line, F.lit("\n"), fence, F.lit("\n" * 17 + "---"))
        return F.when(i % 3 == 0, item).when(i % 3 == 1, quote).otherwise(alone)

    pages = _made(L.table(workers_import(spark), d, "documents"), made)
    return markdown.code_index(markdown.blocks(pages)).select("page_id", "sort_order", "path", "lang", F.md5(F.col("markdown").cast("binary")).alias("code_md5"), "start_line")


def _contents_lines(part, number):
    """A contents line for each part, whose printed page is number."""
    size, page = F.col("p_size"), F.concat(F.lit(" ..... "), number.cast("string"))
    line = F.when(size % 4 == 0, F.concat(F.lit("- **Chapter "), size.cast("string"), F.lit("** The "), "p_name", page)).when(size % 4 == 1, F.concat(F.lit("Part IV "), "p_name", page)).when(size % 4 == 2, F.concat(F.lit("<b>"), "p_name", F.lit("</b>"), page)).otherwise(F.concat(F.lit("civil "), "p_name", page))
    return part.select("p_partkey", "p_size", line.alias("line"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'chapter' WHEN 1 THEN 'part' WHEN 2 THEN 'matter' END AS kind, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'IV' END AS number, (p_partkey % 10000)::VARCHAR AS page FROM part"""
)
def contents_entries(spark, d):
    rows = _contents_lines(L.table(spark, d, "part"), F.col("p_partkey") % 10000)
    return contents.entries(rows).select("p_partkey", "kind", "number", "page")


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'chapter' WHEN 1 THEN 'part' WHEN 2 THEN 'matter' END AS kind, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'IV' END AS number, (p_partkey % 10000)::VARCHAR AS page FROM part"""
)
def contents_entries_all(spark, d):
    """contents_entries over every part; a printed page has four digits at most."""
    rows = _contents_lines(L.table(spark, d, "part"), F.col("p_partkey") % 10000)
    return contents.entries(rows).select("p_partkey", "kind", "number", "page")


@query("""WITH p AS (SELECT o_custkey AS book, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT book, n AS place, CASE WHEN n % 4 = 0 THEN 'part' ELSE 'chapter' END AS kind, CASE WHEN n % 4 = 0 THEN n ELSE n - n // 4 END::VARCHAR AS number, o_orderkey::VARCHAR || 'x' AS title, (n * 3)::VARCHAR AS page FROM p""")
def contents_read(spark, d):
    """Each customer's orders as a contents list over pages of five lines, a part after every third chapter, each entry told twice."""
    o = L.table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).select(F.col("o_custkey").alias("book"), "n", F.col("o_orderkey").cast("string").alias("k"))
    n = F.col("n").cast("string")
    part = F.concat(F.lit("Part "), n, F.lit(": "), "k", F.lit("x"))
    chapter = F.concat(F.lit("Chapter "), (F.col("n") - F.floor(F.col("n") / 4)).cast("string"), F.lit(" - "), "k", F.lit("x"))
    line = F.concat(F.when(F.col("n") % 4 == 0, part).otherwise(chapter), F.lit(" . . . . "), (F.col("n") * 3).cast("string"))
    twice = o.select("book", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"), "n", line.alias("line")).select("book", (F.floor(F.col("n") / 5) + 1).cast("int").alias("page"), (F.col("n") * 2 + F.col("t") + 1).alias("line_no"), "line")
    head = o.select("book").distinct().select("book", F.lit(1).alias("page"), F.lit(0).cast("long").alias("line_no"), F.lit("## Table of Contents").alias("line"))
    return contents.read_contents(twice.withColumn("line_no", F.col("line_no").cast("long")).unionByName(head))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'let a = ' || q || ';' || chr(10) || 'if (a > 1) {' || chr(10) || '    f("x;{y}");' || chr(10) || '}' WHEN 1 THEN 'plain words ' || q ELSE 'SELECT a FROM b' END AS result,
  CASE l_linenumber % 3 WHEN 1 THEN 'no known language' WHEN 2 THEN 'no layout for this language' END AS skipped FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity::INT AS q FROM lineitem)"""
)
def unmangle_pages(spark, d):
    q, k = F.col("q").cast("string"), F.col("l_linenumber") % 3
    code = F.when(k == 0, F.concat(F.lit("let a = "), q, F.lit('; if (a > 1) { f("x;{y}"); }'))).when(k == 1, F.concat(F.lit("plain words "), q)).otherwise(F.lit("SELECT a FROM b"))
    rows = L.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct().withColumn("code", code)
    return unmangle.unmangle(rows).select("l_orderkey", "l_linenumber", "result", "skipped")


@query(
    r"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'let r = /a;' || q || '/;' || chr(10) || 'for (let i = 0; i < f(g(' || q || ')); i++) {' || chr(10) || '    /* ' || c || '; */ h(`' || c || '; ${i}`);' || chr(10) || '}'
  WHEN 1 THEN 'const f = on(e => {' || chr(10) || '    a(' || q || ');' || chr(10) || '    b({k: "' || c || '"});' || chr(10) || '}' || chr(10) || ');' WHEN 2 THEN 'let a = ' || q || '; // ' || c ELSE 'let s = "' || c END AS result,
  CASE l_linenumber % 4 WHEN 2 THEN 'line comment' WHEN 3 THEN 'open quote' END AS skipped FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity::INT AS q, trim(l_linestatus || ' ' || l_returnflag) AS c FROM lineitem)"""
)
def unmangle_modes(spark, d):
    """A listing a line item, made of its quantity and mode: regular expressions, heads with calls in calls, comments, templates, callbacks; two kinds stay."""
    q, k, c = F.col("q").cast("string"), F.col("l_linenumber") % 4, F.col("c")
    code = (
        F.when(k == 0, F.concat(F.lit("let r = /a;"), q, F.lit("/; for (let i = 0; i < f(g("), q, F.lit(")); i++) { /* "), c, F.lit("; */ h(`"), c, F.lit("; ${i}`); }")))
        .when(k == 1, F.concat(F.lit("const f = on(e => { a("), q, F.lit('); b({k: "'), c, F.lit('"}); });')))
        .when(k == 2, F.concat(F.lit("let a = "), q, F.lit("; // "), c)).otherwise(F.concat(F.lit('let s = "'), c))
    )
    rows = L.table(workers_import(spark), d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.trim(F.concat_ws(" ", "l_linestatus", "l_returnflag")).alias("c")).distinct().withColumn("code", code)
    return listings.unmangle(rows).select("l_orderkey", "l_linenumber", "result", "skipped")


@query("SELECT lang AS folder, count(*) AS files, count(*) FILTER (n_chars > 1000) AS changed, count(*) FILTER (doc_id % 3 = 0) AS skipped FROM documents GROUP BY lang")
def step_report(spark, d):
    files = L.table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") > 1000).alias("changed"), F.when(F.col("doc_id") % 3 == 0, "why").alias("skipped"))
    return unmangle.step_report(files)


@query("SELECT CASE WHEN a >= b THEN 'the' ELSE 'and' END AS profile, greatest(a, b) AS hits FROM (SELECT count(*) FILTER (contains(text, ' the ')) AS a, count(*) FILTER (contains(text, ' and ')) AS b FROM documents)")
def best_profile(spark, d):
    return unmangle.best_profile(L.table(spark, d, "documents"), {"the": " the ", "and": " and "})


@query(
    """WITH RECURSIVE p AS (SELECT DISTINCT user_id AS g, event_id AS e, floor(value * 10)::BIGINT AS h FROM events WHERE value IS NOT NULL),
step(g, e, h, n) AS (SELECT g, e, h, 1 FROM p UNION ALL SELECT DISTINCT b.g, b.e, b.h, a.n + 1 FROM step a JOIN p b ON a.g = b.g AND a.e < b.e AND a.h < b.h),
l AS (SELECT g, e, h, max(n) AS n FROM step GROUP BY ALL),
chain(g, n, x) AS (SELECT g, n, min({'e': e, 'h': h}) FROM l WHERE n = (SELECT max(n) FROM l m WHERE m.g = l.g) GROUP BY g, n
  UNION ALL SELECT c.g, c.n - 1, min({'e': l.e, 'h': l.h}) FROM chain c JOIN l ON l.g = c.g AND l.n = c.n - 1 AND l.e < c.x.e AND l.h < c.x.h GROUP BY c.g, c.n)
SELECT g AS book, x.e AS entry, x.h AS heading FROM chain"""
)
def anchor_chain(spark, d):
    """The earliest of the longest rising chains of (entry, heading) pairs of each user's events."""
    e = L.table(workers_import(spark), d, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("entry"), F.floor(F.col("value") * 10).cast("long").alias("heading")).where("heading is not null")
    return contents.anchor_chain(e)
