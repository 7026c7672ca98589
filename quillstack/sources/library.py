"""The library's relations, derived from the driver's tables.

A book is a language, a chapter a source, a section a document (a heap-shaped
tree by id), a block a line that is not blank.  Each function has its SQL twin
in ``SQL``, which the oracle statements are built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, book, chapter, status, role, title, sort_order, text.

    The status is a join: take texts from ``texts`` where they need none, else they are shuffled for it.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 8)).alias("parent_id"),
        F.col("lang").alias("book"),
        F.col("source").alias("chapter"),
        F.when(F.col("quality") == 0, "draft").otherwise("published").alias("status"),
        F.when(F.col("doc_id") % 20 == 0, "toc").otherwise("body").alias("role"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("doc_id").alias("sort_order"),
        "text",
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, status: Spanish is a draft."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("book")).distinct().withColumn("status", F.when(F.col("book") == "es", "draft").otherwise("published"))


def blocks(sections: DataFrame) -> DataFrame:
    """section_id, line_no, line: the lines that are not blank, in order from 0."""
    lines = sections.select(F.col("id").alias("section_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def texts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """ref, text (and keep: book, chapter) of each section, whose first line is its title and whose lines that are not blank are its blocks."""
    d = table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "ref", "lang": "book", "source": "chapter"})
    return d.select("ref", *keep, "text")


def catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, categories, chapters): customers on nations under regions, with their orders as chapters."""
    c = table(spark, sf_dir, "customer")
    book = c.select(
        F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.concat(F.lit("n"), "c_nationkey").alias("category_id"),
        F.when(F.col("c_acctbal") < 0, "draft").otherwise("published").alias("status"), (F.lit(1950) + F.col("c_custkey") % 70).cast("int").alias("year"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "und", "de")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("language"),
    )
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    sub = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    chapter = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chapter_id"), F.col("o_custkey").alias("book_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).alias("number")
    )
    return book, top.unionByName(sub), chapter


SQL = {
    "sections": """sections AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id > 0 THEN (d.doc_id - 1) // 8 END AS parent_id, d.lang AS book, d.source AS chapter,
  CASE WHEN l.quality = 0 THEN 'draft' ELSE 'published' END AS status, CASE WHEN d.doc_id % 20 = 0 THEN 'toc' ELSE 'body' END AS role,
  split_part(d.text, chr(10), 1) AS title, d.doc_id AS sort_order, d.text FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "books": """books AS (SELECT DISTINCT lang AS book, CASE WHEN lang = 'es' THEN 'draft' ELSE 'published' END AS status FROM documents)""",
    "blocks": """blocks AS (SELECT id AS section_id, i - 1 AS line_no, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sections) WHERE trim(line) <> '')""",
    "visible": """walk AS (SELECT s.id, s.status = 'published' AS ok FROM sections s WHERE s.parent_id IS NULL
  UNION ALL SELECT s.id, w.ok AND s.status = 'published' FROM sections s JOIN walk w ON s.parent_id = w.id),
  visible AS (SELECT s.* FROM sections s JOIN walk w USING (id) JOIN books b ON b.book = s.book WHERE w.ok AND b.status = 'published')""",
    "catalogue": """book AS (SELECT c_custkey AS book_id, c_name AS title, c_mktsegment AS author, 'n' || c_nationkey AS category_id, CASE WHEN c_acctbal < 0 THEN 'draft' ELSE 'published' END AS status,
  (1950 + c_custkey % 70)::INT AS year, ['en', 'fr', 'und', 'de'][c_custkey % 4 + 1] AS language FROM customer),
  category AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL::VARCHAR AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation),
  chapter AS (SELECT o_orderkey AS chapter_id, o_custkey AS book_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey::VARCHAR END AS number FROM orders)""",
}
