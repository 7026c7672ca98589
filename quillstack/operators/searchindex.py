"""A search index that is kept: segments behind one pointer, changed by deltas, deletes and merges.

A segment has three tables: ``words`` (a row for each word of each line, each
file sorted by word and book), ``lines`` (texts, sorted by section) and ``heads``
(sections without their texts), and perhaps ``gone``: sections of earlier
segments that it replaces or deletes.  A query reads in each file the row groups
of its own words, and texts only of the sections that it shows.  Words are runs
of letters, digits and combining marks in any script, in compatibility form and
lower case.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import normalize
from ..sources import versions
from . import ranking
from .search import WebQuery, damped, parse_query

WORD = r"[\p{L}\p{N}\p{M}]+"
_ASCII = r"^[\x00-\x7F]*$"
#: Bytes of text whose words one task sorts.
RUN_BYTES = ranking.RUN_BYTES


def words(lines: DataFrame) -> DataFrame:
    """word, book, section_id, line_no, pos: a row for each word; only lines with other signs than ASCII's go through Python for their normal form."""
    plain = F.col("line").rlike(_ASCII)
    both = lines.where(plain).unionByName(lines.where(~plain).withColumn("line", normalize(F.col("line"), "NFKC")))
    return both.select("book", "section_id", "line_no", F.posexplode(F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), 1)).alias("pos", "word"))


def _segment(root: str, sections: DataFrame, gone: DataFrame | None) -> dict[str, str]:
    spark, folder = sections.sparkSession, f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    sections.drop("text").write.parquet(f"{folder}/heads")
    each = sections.select("book", F.col("id").alias("section_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    each.hint("rebalance", "section_id").sortWithinPartitions("section_id", "line_no").write.parquet(f"{folder}/lines")
    _write_words(spark, folder)
    tables = ["heads", "lines", "words"]
    if gone is not None:
        gone.select("id").distinct().write.parquet(f"{folder}/gone")
        tables.append("gone")
    return {t: f"{folder}/{t}" for t in tables}


def _write_words(spark: SparkSession, folder: str) -> None:
    """The words of a folder's lines. Lines are dealt before they are split: a word's row is many times its text, so words are sorted where they lie."""
    lines = ranking.dealt(spark.read.parquet(f"{folder}/lines"), "line", "section_id", "line_no", most=RUN_BYTES)
    words(lines).sortWithinPartitions("word", "book", "section_id", "line_no", "pos").write.option("compression", "zstd").parquet(f"{folder}/words")


def _named(segments: list[dict[str, str]]) -> dict[str, str]:
    return {f"{k:06d}.{t}": p for k, s in enumerate(segments) for t, p in s.items()}


def _segments(spark: SparkSession, root: str) -> list[dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for name, path in sorted(versions.manifest(spark, root).items()):
        k, table = name.split(".")
        out.setdefault(k, {})[table] = path
    return list(out.values())


def build(spark: SparkSession, root: str, sections: DataFrame) -> None:
    """The index of these sections and nothing else. sections: id, book, text, and what else ``heads`` is to hold."""
    versions.switch(spark, root, versions.manifest(spark, root), _named([_segment(root, sections, None)]))


def update(spark: SparkSession, root: str, sections: DataFrame, deleted: DataFrame | None = None) -> None:
    """Sections anew or for the first time, and deleted ones (id), as one further segment; nothing that is there is rewritten."""
    before = versions.manifest(spark, root)
    gone = sections.select("id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("id"))
    versions.switch(spark, root, before, _named([*_segments(spark, root), _segment(root, sections, gone)]))


def merge(spark: SparkSession, root: str) -> None:
    """All segments as one, without what is gone; queries give the same rows before and after."""
    before, folder = versions.manifest(spark, root), f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    table(spark, root, "heads").write.parquet(f"{folder}/heads")
    table(spark, root, "lines").hint("rebalance", "section_id").sortWithinPartitions("section_id", "line_no").write.parquet(f"{folder}/lines")
    _write_words(spark, folder)
    versions.switch(spark, root, before, _named([{name: f"{folder}/{name}" for name in ("heads", "lines", "words")}]))


def table(spark: SparkSession, root: str, name: str, kept: Column | None = None) -> DataFrame:
    """heads, lines or words of the visible segments (rows where ``kept``), without what later segments replace."""
    key = "id" if name == "heads" else "section_id"
    out, gone = [], None
    for s in reversed(_segments(spark, root)):
        df = spark.read.parquet(s[name])
        df = df if kept is None else df.where(kept)
        out.append(df if gone is None else df.join(gone.withColumnRenamed("id", key), key, "left_anti").select(*df.columns))
        if "gone" in s:
            later = spark.read.parquet(s["gone"])
            gone = later if gone is None else gone.unionByName(later)
    return reduce(DataFrame.unionByName, reversed(out))


def asked(text: str) -> WebQuery:
    return parse_query(text, term=WORD)


def hits(spark: SparkSession, root: str, query: WebQuery, book: str | None = None) -> DataFrame:
    """book, section_id, line_no, rank of every line that matches, from its words' rows alone: the number of its words that the query asks for."""
    wanted = sorted({w for g in query.groups for p in g for w in p})
    every = sorted({*wanted, *(w for p in query.excluded for w in p)})
    if not wanted:
        return table(spark, root, "words", F.lit(False)).select("book", "section_id", "line_no", F.lit(0).cast("long").alias("rank"))
    kept = F.col("word").isin(every) & (F.lit(True) if book is None else F.col("book") == book)
    phrases = [p for g in query.groups for p in g] + query.excluded
    placed = {w for p in phrases if len(p) > 1 for w in p}
    name = {w: f"w{i}" for i, w in enumerate(every)}
    found = [F.collect_list(F.when(F.col("word") == w, F.col("pos"))).alias(name[w]) if w in placed else F.count_if(F.col("word") == w).alias(name[w]) for w in every]
    rows = table(spark, root, "words", kept).groupBy("book", "section_id", "line_no").agg(*found)

    def has(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return (F.size(name[phrase[0]]) if phrase[0] in placed else F.col(name[phrase[0]])) > 0
        return F.size(reduce(F.array_intersect, [_moved(name[w], k) for k, w in enumerate(phrase)])) > 0

    need = [reduce(lambda a, b: a | b, [has(p) for p in g]) for g in query.groups] + [~has(p) for p in query.excluded]
    rank = reduce(lambda a, b: a + b, [(F.size(name[w]) if w in placed else F.col(name[w])).cast("long") for w in wanted])
    return rows.where(reduce(lambda a, b: a & b, need)).select("book", "section_id", "line_no", rank.alias("rank"))


def _moved(places: str, back: int) -> Column:
    return F.transform(places, lambda x: x - back)


def _best(rows: DataFrame) -> DataFrame:
    """Each section's best line, the first of equals; a max of structs, which Spark combines before the shuffle."""
    best = F.max(F.struct("rank", (-F.col("line_no")).alias("n")))
    return rows.groupBy("section_id").agg(best.alias("_b")).select("section_id", F.col("_b.rank").alias("rank"), (-F.col("_b.n")).alias("line_no"))


def search_library(spark: SparkSession, root: str, visible: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """section_id, title, book, score, snippet: text hits and title hits of the visible sections, best first; a title hit adds 1.

    The ids of the rows that are shown (``limit`` at most) come to the driver, so
    that texts are read by them alone.
    """
    titled = F.ilike("title", F.lit("%" + text.strip()[:200] + "%"))
    best = _best(hits(spark, root, asked(text)))
    scored = visible.join(best, visible["id"] == best["section_id"], "left").where(F.col("rank").isNotNull() | titled)
    score = damped(F.coalesce("rank", F.lit(0)) + F.when(titled, 1).otherwise(0))
    top = scored.select("id", "title", "book", F.round(score, 6).alias("score"), "line_no").orderBy(F.desc("score"), "id").limit(limit).collect()
    shown = spark.createDataFrame(top, "section_id long, title string, book string, score double, line_no int")
    lines = table(spark, root, "lines", F.col("section_id").isin([r["id"] for r in top])).select("section_id", "line_no", F.col("line").alias("snippet"))
    return shown.join(lines, ["section_id", "line_no"], "left").orderBy(F.desc("score"), "section_id").select("section_id", "title", "book", "score", "snippet")


def search_book(spark: SparkSession, root: str, visible: DataFrame, book: str, text: str, limit: int = 20) -> DataFrame:
    """section_id, title, score, line_no: text hits of one book, read from its rows of the words."""
    scored = visible.where(F.col("book") == book).join(_best(hits(spark, root, asked(text), book)), F.col("id") == F.col("section_id"))
    return scored.select("section_id", "title", F.round(damped(F.col("rank")), 6).alias("score"), "line_no").orderBy(F.desc("score"), "section_id").limit(limit)
