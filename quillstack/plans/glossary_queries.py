"""Queries on the inverted index, headlines and glossaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stemming import STOP_WORDS
from ..operators import fulltext as X
from ..operators import glossary as G
from ..operators import records
from ..operators.ranking import dealt, written
from ..operators.search import parse_query
from ..session import workers_import
from ..sources import library as L
from .registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_WORDS = f"""w AS (SELECT section_id, line_no, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS place FROM (SELECT section_id, line_no, regexp_extract_all(lower(line), '[a-z0-9]+') AS t FROM blocks)),
k AS (SELECT * FROM w WHERE NOT list_contains({_STOP}, term))"""
_KEYS = ["section_id", "line_no"]


def _index(spark, d, stems=False):
    return X.index(L.blocks(L.sections(workers_import(spark), d)), _KEYS, stems=stems)


def _kept(spark, d, stems):
    """The written index: texts are dealt before they are split, terms sorted where they lie."""
    lines = L.blocks(dealt(L.sections(workers_import(spark), d).select("id", "text"), "text", "id"))
    return written(X.index(lines, _KEYS, stems=stems).sortWithinPartitions("term"), "index")


@query(f"WITH {_WORDS} SELECT section_id, line_no, term, count(*) AS tf, string_agg(place, ' ' ORDER BY place) AS places FROM k GROUP BY ALL", "sections", "blocks")
def index_postings(spark, d):
    """The index's rows, made without a shuffle."""
    return _index(spark, d).select("section_id", "line_no", "term", "tf", F.array_join("places", " ").alias("places"))


@query(
    f"""WITH {_WORDS}, b AS (SELECT section_id, line_no, count(*) AS len FROM k GROUP BY ALL), s AS (SELECT count(*) AS n, avg(len) AS mean FROM b),
p AS (SELECT section_id, line_no, term, count(*) AS tf, list(place) AS places FROM k WHERE term IN ('une', 'er', 'der') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
m AS (SELECT section_id, line_no FROM p GROUP BY ALL HAVING count(*) FILTER (term IN ('une', 'er')) > 0 AND count(*) FILTER (term = 'der') = 0)
SELECT section_id, line_no, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS rank
FROM m JOIN p USING (section_id, line_no) JOIN f USING (term) JOIN b USING (section_id, line_no), s WHERE term <> 'der' GROUP BY ALL""",
    "sections", "blocks",
)
def search_ranked(spark, d):
    """BM25 over the postings of the query's terms; no text is looked at."""
    i = _kept(spark, d, stems=False)
    n, mean = X.statistics(i, _KEYS)
    return X.search(i, _KEYS, parse_query("une or er -der"), n, mean, stems=False).select(*_KEYS, F.round("rank", 6).alias("rank"))


@query(None)
def search_stemmed(spark, d):
    """The same with stems: tests hold it against a scan with the stemmer."""
    i = _kept(spark, d, stems=True)
    n, mean = X.statistics(i, _KEYS)
    return X.search(i, _KEYS, parse_query('ered or thing -"of ered"'), n, mean).select(*_KEYS, F.round("rank", 6).alias("rank"))


@query(
    """WITH w AS (SELECT section_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS ws FROM blocks),
i AS (SELECT section_id, line_no, ws, unnest(range(1, greatest(len(ws) - 30 + 1, 1) + 1)) AS i FROM w),
s AS (SELECT *, len(list_filter(ws[i:i + 29], lambda x: regexp_extract(lower(x), '[a-z0-9]+') IN ('une', 'er'))) AS n FROM i),
b AS (SELECT DISTINCT ON (section_id, line_no) section_id, line_no, ws[i:i + 29] AS run FROM s ORDER BY section_id, line_no, n DESC, i)
SELECT section_id, line_no, array_to_string(list_transform(run, lambda x: CASE WHEN regexp_extract(lower(x), '[a-z0-9]+') IN ('une', 'er') THEN '[' || x || ']' ELSE x END), ' ') AS marked, array_to_string(run, ' ') AS plain FROM b""",
    "sections", "blocks",
)
def headlines(spark, d):
    h = L.blocks(L.sections(workers_import(spark), d)).select(*_KEYS, X.headline(F.col("line"), parse_query("une er"), stems=False).alias("h"))
    return h.select(*_KEYS, F.translate("h", X.START + X.END, "[]").alias("marked"), X.plain(F.col("h")).alias("plain"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE instr(text, substr(text, 5, 9)) - 1 END AS start FROM sections WHERE length(text) > 20", "sections")
def quote_places(spark, d):
    """Quotes by their first place in the text; those that are not found stay, unplaced."""
    s = L.sections(spark, d).where("length(text) > 20").select("id", "text")
    quotes = s.select("id", F.when(F.col("id") % 3 == 0, "no such words here").otherwise(F.substring("text", 5, 9)).alias("quote"))
    return X.quote_places(quotes, s, "id").select("id", "start")


@query("SELECT p_partkey, p_size % 4 <> 1 AS kept, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS n, CASE p_size % 4 WHEN 1 THEN p_name ELSE 'English' END AS head FROM part")
def glossary_tables(spark, d):
    """A printed header, an odd shape, an entry in the header's place, guide words."""
    k, a = F.col("p_size") % 4, lambda *x: F.array(*[F.lit(v) if v != "p_name" else F.col(v) for v in x])
    headers = F.when(k == 0, a("English", "बोड़ो")).when(k == 1, a("p_name")).when(k == 2, a("p_name", "खोन्दो")).otherwise(a("abacus", "abbey"))
    rows = F.array(F.when(k == 1, a("p_name")).otherwise(a("p_name", "फरा")))
    out = G.term_tables(L.table(spark, d, "part").select("p_partkey", headers.alias("headers"), rows.alias("rows")))
    return out.select("p_partkey", "kept", F.size("entries").alias("n"), F.element_at("columns", 1).alias("head"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS book, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 7 < 3 THEN 'term' WHEN o_orderkey % 7 < 6 THEN 'meaning' ELSE 'other' END AS kind FROM orders),
r AS (SELECT *, (n - 1) // 2 AS page, lag(kind) OVER (PARTITION BY book, (n - 1) // 2 ORDER BY n) AS before FROM c),
p AS (SELECT book, page, bool_or(kind = 'other' OR (kind = 'term' AND coalesce(before, '') = 'term')) AS bad, arg_min(kind, n) AS first, arg_max(kind, n) AS last, count(*) FILTER (kind = 'term') AS terms FROM r GROUP BY ALL),
walk(book, page, ok, is_open) AS (SELECT DISTINCT book, -1::BIGINT, false, false FROM p
  UNION ALL SELECT book, page, x IS TRUE, x IS TRUE AND last = 'term' FROM (SELECT p.*, NOT bad AND terms > 0 AND (first = 'term' OR w.is_open) AS x FROM walk w JOIN p ON p.book = w.book AND p.page = w.page + 1)),
g AS (SELECT r.*, count(*) FILTER (kind = 'term') OVER (PARTITION BY r.book ORDER BY n) AS t FROM r JOIN walk w ON w.book = r.book AND w.page = r.page WHERE ok)
SELECT book, max('t' || o_orderkey) FILTER (kind = 'term') AS term, string_agg('फ' || o_orderkey, ' ' ORDER BY n) FILTER (kind = 'meaning') AS meaning FROM g GROUP BY book, t""")
def glossary_pairs(spark, d):
    """Terms, meanings and others over pages of two paragraphs: pages that begin with a meaning behind paired, refused and closed ones."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = L.table(workers_import(spark), d, "orders").withColumn("n", n).select(F.col("o_custkey").alias("book"), F.floor((F.col("n") - 1) / 2).alias("page"), "n", "o_orderkey")
    kind = F.col("o_orderkey") % 7
    text = F.when(kind < 6, F.concat(F.when(kind < 3, "t").otherwise("फ"), F.col("o_orderkey").cast("string"))).otherwise("…")
    out, _ = G.paired(rows.select("book", "page", F.col("n").alias("place"), text.alias("text")))
    return out.select("book", "term", F.nullif("meaning", F.lit("")).alias("meaning"))


@query("SELECT p_brand AS book, p_name AS term, string_agg(m, '; ' ORDER BY o) AS expansion FROM (SELECT p_brand, p_name, 'm' || lpad(p_size::VARCHAR, 2, '0') AS m, min(p_partkey) AS o FROM part GROUP BY ALL) GROUP BY ALL")
def glossary_dictionary(spark, d):
    p = L.table(spark, d, "part")
    line = F.concat(F.lit("- **"), "p_name", F.lit("** — *m"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("*"))
    return G.dictionary(p.select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("place"), line.alias("line")), ["book"], "place")


@query("""WITH u AS (SELECT 0 AS l, p_partkey AS place, p_name AS term, p_brand AS expansion FROM part WHERE p_size > 25 UNION ALL SELECT 1, p_partkey, p_name, p_type FROM part WHERE p_size <= 25)
SELECT l AS list, place, CASE WHEN n = 1 THEN 'kept' WHEN lower(expansion) = lower(f) THEN 'duplicate' ELSE 'conflict' END AS verdict FROM (SELECT *, row_number() OVER w AS n, first(expansion) OVER w AS f FROM u WINDOW w AS (PARTITION BY term ORDER BY l, place))""")
def glossary_merged(spark, d):
    p = L.table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("term"), "p_brand", "p_type", "p_size")
    both = G.merged(p.where("p_size > 25").withColumn("expansion", F.col("p_brand")), p.where("p_size <= 25").withColumn("expansion", F.col("p_type")))
    judged = records.first_wins(both.withColumn("_o", F.struct("_list", "place")), "term", "expansion", "_o")
    return judged.select(F.col("_list").alias("list"), "place", "verdict")


@query("""WITH walk AS (SELECT id, CASE WHEN id % 6 = 5 THEN 'own' || id ELSE 'ch-' || chapter END AS role FROM sections WHERE parent_id IS NULL
  UNION ALL SELECT s.id, CASE WHEN s.id % 6 = 5 THEN 'own' || s.id ELSE w.role END FROM sections s JOIN walk w ON s.parent_id = w.id) SELECT * FROM walk""", "sections")
def inherited_roles(spark, d):
    s = L.sections(spark, d).select("id", "parent_id", "chapter", F.when(F.col("id") % 6 == 5, F.concat(F.lit("own"), F.col("id").cast("string"))).alias("role"))
    return G.inherited_roles(s, s.select("chapter").distinct().withColumn("role", F.concat(F.lit("ch-"), "chapter")))
