"""Queries on readers' and editors' records and import reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators import records as R
from ..operators.tree import first_per_group, visible_sections
from ..sources import library as L
from .registry import query

NOW = "2024-02-05 00:00:00"


def _events(spark, d, kind=None):
    e = L.table(spark, d, "events")
    return e.where(F.col("event_type") == kind) if kind else e


def _meets(spark, d, key):
    """The stand-in join of events and documents, over all documents."""
    return F.expr(f"event_id % {max(1, L.table(spark, d, 'documents').count())} = {key}")


def _positions(spark, d):
    """The last view of each user in each book."""
    v = _events(spark, d, "view").join(L.sections(spark, d).select(F.col("id").alias("section_id"), "book"), _meets(spark, d, "section_id"))
    return first_per_group(v, ["user_id", "book"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "book", "section_id", "ts")


_POS = "pos AS (SELECT DISTINCT ON (e.user_id, s.book) e.user_id, s.book, s.id AS section_id, e.ts FROM events e JOIN sections s ON s.id = e.event_id % (SELECT count(*) FROM documents) WHERE e.event_type = 'view' ORDER BY e.user_id, s.book, e.ts DESC, e.event_id DESC)"


@query(f"WITH {_POS} SELECT p.user_id, p.book, p.section_id, p.ts FROM pos p JOIN visible v ON v.id = p.section_id", "sections", "books", "visible")
def me_reading(spark, d):
    """Latest positions in visible sections; editors see no more here than others."""
    shown = visible_sections(L.sections(spark, d), L.books(spark, d)).select(F.col("id").alias("section_id"))
    return _positions(spark, d).join(shown, "section_id", "left_semi").select("user_id", "book", "section_id", "ts")


@query("SELECT user_id, lang AS book, bool_or(event_type = 'purchase') AS favorite FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents) WHERE lang <> 'es' GROUP BY 1, 2")
def me_shelves(spark, d):
    docs = L.table(spark, d, "documents").select("doc_id", F.col("lang").alias("book")).join(L.books(spark, d).where("status = 'published'"), "book", "left_semi")
    return _events(spark, d).join(docs, _meets(spark, d, "doc_id")).groupBy("user_id", "book").agg(F.bool_or(F.col("event_type") == "purchase").alias("favorite"))


@query("SELECT e.event_id, e.user_id, v.id AS section_id, e.props AS note FROM events e JOIN visible v ON v.id = e.event_id % (SELECT count(*) FROM documents) WHERE e.event_type = 'click'", "sections", "books", "visible")
def me_annotations(spark, d):
    shown = visible_sections(L.sections(spark, d), L.books(spark, d)).select(F.col("id").alias("section_id"))
    return _events(spark, d, "click").join(shown, _meets(spark, d, "section_id")).select("event_id", "user_id", "section_id", F.col("props").alias("note"))


@query("SELECT e.event_id, e.user_id, v.id AS section_id, e.props AS note FROM events e JOIN visible v ON v.id = e.event_id % (SELECT count(*) FROM documents) WHERE e.event_type = 'click'", "sections", "books", "visible")
def me_annotations_all(spark, d):
    """me_annotations of every user."""
    shown = visible_sections(L.sections(spark, d), L.books(spark, d)).select(F.col("id").alias("section_id"))
    return _events(spark, d, "click").join(shown, _meets(spark, d, "section_id")).select("event_id", "user_id", "section_id", F.col("props").alias("note"))


@query("SELECT e.event_id, c.c_name AS reader, (e.value::INT % 5 + 1)::INT AS rating, e.ts FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'purchase' AND e.value IS NOT NULL ORDER BY e.ts DESC, e.event_id LIMIT 100")
def reviews(spark, d):
    e = _events(spark, d, "purchase").where("value is not null").join(L.table(spark, d, "customer"), F.expr("c_custkey = user_id"))
    rows = e.select("event_id", F.col("c_name").alias("reader"), (F.rint("value").cast("int") % 5 + 1).alias("rating"), "ts")
    return rows.orderBy(F.desc("ts"), "event_id").limit(100)


@query(f"SELECT event_id, user_id, ts + INTERVAL 30 DAY AS expires_at FROM events WHERE event_type = 'signup' AND ts + INTERVAL 30 DAY > TIMESTAMP '{NOW}'")
def sessions_alive(spark, d):
    s = _events(spark, d, "signup").withColumn("started", F.col("ts"))
    return R.alive(s, F.lit(NOW).cast("timestamp_ntz")).select("event_id", "user_id", "expires_at")


@query("SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events WHERE event_type IN ('view', 'click') ORDER BY user_id, event_type = 'click' DESC, ts DESC, event_id DESC")
def upsert_latest(spark, d):
    """Views as they were, then the clicks written over them."""
    rows = lambda k: _events(spark, d, k).select("user_id", "ts", "event_id", "value")
    base = first_per_group(rows("view"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return R.upsert_latest(base, rows("click"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) END, p_name) AS p_name, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 0 END, p_size)::INT AS p_size FROM part")
def coalesce_update(spark, d):
    old = L.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = old.where("p_partkey % 3 = 0 or p_partkey % 5 = 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 5 == 0, F.lit(0)).alias("p_size"))
    return R.coalesce_update(old, new, "p_partkey", ["p_name", "p_size"])


_TAKEN = "taken AS (SELECT DISTINCT 'book-' || (p_size % 7) || CASE WHEN p_size % 4 > 0 THEN '-' || (p_size % 4 + p_size % 2) ELSE '' END AS slug FROM part)"


@query(
    f"""WITH {_TAKEN}, wanted AS (SELECT 'book-' || i AS base FROM range(0, 9) t(i))
SELECT base, CASE WHEN base NOT IN (SELECT slug FROM taken) THEN base ELSE base || '-' || (SELECT min(i) FROM range(2, 50) r(i) WHERE base || '-' || i NOT IN (SELECT slug FROM taken)) END AS slug FROM wanted"""
)
def slug_unique_gap(spark, d):
    size = F.col("p_size")
    taken = L.table(spark, d, "part").select(F.concat(F.lit("book-"), (size % 7).cast("string"), F.when(size % 4 > 0, F.concat(F.lit("-"), (size % 4 + size % 2).cast("string"))).otherwise("")).alias("slug")).distinct()
    return R.free_slug(spark.range(9).select(F.concat(F.lit("book-"), F.col("id").cast("string")).alias("base")), taken)


@query("SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS s FROM part))")
def slug_unique_seq(spark, d):
    from ..functions.text import slugify

    p = L.table(spark, d, "part").withColumn("base", slugify(F.col("p_name")))
    return R.numbered_slugs(p, "base", [], ["p_partkey"]).select("p_partkey", "slug")


@query(
    """SELECT p_partkey, CASE WHEN n = 1 THEN 'kept' WHEN lower(p_brand) = lower(f) THEN 'duplicate' ELSE 'conflict' END AS verdict, f AS kept_expansion
  FROM (SELECT *, row_number() OVER w AS n, first(p_brand) OVER w AS f FROM part WINDOW w AS (PARTITION BY lower(p_name) ORDER BY p_partkey))"""
)
def glossary_first_wins(spark, d):
    p = L.table(spark, d, "part").withColumn("term", F.lower("p_name"))
    return R.first_wins(p, "term", "p_brand", "p_partkey").select("p_partkey", "verdict", "kept_expansion")


@query(
    """SELECT term, kept, string_agg(p_brand, '; ' ORDER BY p_partkey) AS others FROM
  (SELECT lower(p_name) AS term, first(p_brand) OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS kept, p_brand, p_partkey FROM part) WHERE lower(p_brand) <> lower(kept) GROUP BY term, kept"""
)
def glossary_conflicts(spark, d):
    return R.conflicts(L.table(spark, d, "part").withColumn("term", F.lower("p_name")), "term", "p_brand", "p_partkey")


_DIAG = "diag AS (SELECT event_id, user_id, event_type AS code, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, props AS message, ts FROM events)"


def _diagnostics(spark, d):
    sev = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return _events(spark, d).select("event_id", "user_id", F.col("event_type").alias("code"), sev.alias("severity"), F.col("props").alias("message"), "ts")


@query(f"WITH {_DIAG} SELECT user_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM diag GROUP BY 1")
def severity_hist(spark, d):
    return R.severity_histogram(_diagnostics(spark, d), ["user_id"])


@query(f"WITH {_DIAG} SELECT user_id, string_agg(code || '=' || n, ',' ORDER BY code) AS by_code FROM (SELECT user_id, code, count(*) AS n FROM diag GROUP BY ALL) GROUP BY 1")
def code_hist(spark, d):
    n = _diagnostics(spark, d).groupBy("user_id", "code").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.concat_ws("=", "code", F.col("n").cast("string"))))
    return n.groupBy("user_id").agg(F.array_join(listed, ",").alias("by_code"))


@query(f"WITH {_DIAG} SELECT event_id, code, severity FROM diag WHERE severity <> 'info' UNION ALL SELECT * FROM (SELECT event_id, code, severity FROM diag WHERE code = 'view' ORDER BY event_id LIMIT 300)")
def kept_diagnostics(spark, d):
    return R.kept_diagnostics(_diagnostics(spark, d), "view", 300, ["event_id"]).select("event_id", "code", "severity")


@query(f"WITH {_DIAG} SELECT event_id, code, n, place FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY event_id) AS place FROM diag) WHERE place <= 10")
def top_reasons(spark, d):
    return R.top_reasons(_diagnostics(spark, d), "code", ["event_id"]).select("event_id", "code", "n", "place")


@query(f"WITH {_DIAG} SELECT event_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, event_id) AS place FROM diag")
def severity_order(spark, d):
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return ranking.numbered(_diagnostics(spark, d).select("event_id", "severity"), [rank, "event_id"])


@query(f"WITH {_DIAG} SELECT event_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, event_id) AS place FROM diag")
def severity_order_all(spark, d):
    """severity_order over every user's diagnostics."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return ranking.numbered(_diagnostics(spark, d).select("event_id", "severity"), [rank, "event_id"])


@query(f"WITH {_DIAG} SELECT event_id, rpad(severity, 7, ' ') || ' ' || code || CASE WHEN event_id % 3 > 0 THEN ' (' || concat_ws(':', 'user' || user_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END) || ')' ELSE '' END || ': ' || coalesce(message, '') AS line FROM diag")
def diagnostic_lines(spark, d):
    from ..functions.text import diagnostic_line

    g, placed = _diagnostics(spark, d), F.col("event_id") % 3 > 0
    return g.select("event_id", diagnostic_line(F.col("severity"), F.col("code"), F.when(placed, F.concat(F.lit("user"), F.col("user_id").cast("string"))), F.when(placed & (F.col("event_id") % 2 == 0), F.col("event_id")), F.lit(None), F.coalesce("message", F.lit(""))).alias("line"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def offset_mode(spark, d):
    return R.first_mode(_events(spark, d), ["user_id"], "event_type", "ts")


@query("SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 = 0 AND md5(a.text) = md5(b.text) AND a.n_chars = b.n_chars)")
def stored_vs_new(spark, d):
    doc = L.table(spark, d, "documents").select("doc_id", F.lit("images").alias("key"), F.col("n_chars").alias("size"), F.md5("text").alias("md5"))
    return R.not_stored(doc, doc.where("doc_id % 3 = 0").drop("doc_id")).select("doc_id")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def recent_revisions(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, d).withColumn("_r", F.row_number().over(w)).where("_r <= 5").select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def recent_revisions_all(spark, d):
    """recent_revisions of every user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, d).withColumn("_r", F.row_number().over(w)).where("_r <= 5").select("user_id", "event_id", "ts")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS snapshot FROM conversations GROUP BY conv_id")
def publish_snapshot(spark, d):
    """Ordered aggregate of blocks into one revision."""
    c = L.table(spark, d, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("b"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n").alias("snapshot"))


@query("SELECT event_id, concat_ws(',', CASE WHEN value IS NULL OR value < 1 OR value > 90 THEN 'rating' END, CASE WHEN length(props) > 8 THEN 'note' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'kind' END) AS problems FROM events")
def validate_annotations(spark, d):
    e = _events(spark, d)
    problems = F.concat_ws(",", F.when(F.col("value").isNull() | (F.col("value") < 1) | (F.col("value") > 90), "rating"), F.when(F.length("props") > 8, "note"), F.when(~F.col("event_type").isin("view", "click", "purchase"), "kind"))
    return e.select("event_id", problems.alias("problems"))
