"""Outline recovery as windows: running maxima, fills, islands, occurrences, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increasing(df: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number is above all before them in the group; the maximum starts at 0, so 0 is never kept."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_top", F.coalesce(F.max(number).over(before), F.lit(0))).where(F.col(number) > F.col("_top")).drop("_top")


def gaps(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """Rows with the previous number where one or more are left out between."""
    before = F.lag(number).over(Window.partitionBy(*group).orderBy(number))
    return df.withColumn("previous", before).where(F.col(number) > F.col("previous") + 1)


def fill(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """out: the last known value at or before each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def nearest(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """out: the last known value before or at each row, or else the first one after."""
    w = Window.partitionBy(*group).orderBy(*order)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(last, F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))))


def islands(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """One row per run of neighbours with equal keys: group, key, first, last, n."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    runs = df.withColumn("_run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run", key).agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n")).drop("_run")


def counted(df: DataFrame, group: list[str], order: list[str], printed: str) -> DataFrame:
    """df with number: the printed one where there is one, else one more than before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = df.withColumn("_b", F.count(printed).over(w))  # 0 before the first printed one
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    since = F.row_number().over(inner) - F.when(F.col("_b") > 0, 1).otherwise(0)
    return at.withColumn("number", F.coalesce(F.first(printed).over(inner), F.lit(0)) + since).drop("_b")


def neighbours_of(df: DataFrame, group: list[str], order: list[str], kind: Column, text: str) -> DataFrame:
    """df with lead_in and follow_up: the text just before and after where kind holds there, else null."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = F.when(kind, F.col(text))
    return df.withColumns({"lead_in": F.lag(marked).over(w), "follow_up": F.lead(marked).over(w)})


def duplicate_titles(df: DataFrame, group: list[str], title: str, order: list[str]) -> DataFrame:
    """Rows whose title (case and spaces apart) an earlier sibling has, with that one's id."""
    key = F.lower(F.regexp_replace(F.trim(F.col(title)), r"\s+", " "))
    w = Window.partitionBy(*group, key).orderBy(*order)
    return df.withColumns({"first_id": F.first("id").over(w), "_n": F.row_number().over(w)}).where("_n > 1").drop("_n")


def match_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, how: by title and occurrence, by place where chapters are as long, to the chapter's or the book's start.

    old and new: book, chapter, chapter_order, id, title, sort_order (in reading
    order inside the chapter).  The book's start is the first section of its
    first chapter that has one.  Null chapters and titles match their like.
    """

    def placed(df: DataFrame) -> DataFrame:
        same = Window.partitionBy("book", "chapter", "title").orderBy("sort_order")
        chapter = Window.partitionBy("book", "chapter").orderBy("sort_order")
        return df.select("book", "chapter", "id", "title", F.row_number().over(same).alias("nth"), F.row_number().over(chapter).alias("place"), F.count("*").over(Window.partitionBy("book", "chapter")).alias("size"), "chapter_order", "sort_order")

    def joined(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
        """right's id as value where all keys are equal, nulls too."""
        named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias(value))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return left.join(named, match, "left").drop(*[f"_{k}" for k in keys])

    n = placed(new)
    found = joined(placed(old), n, ["book", "chapter", "title", "nth"], "t")
    found = joined(found, n, ["book", "chapter", "place", "size"], "p")
    found = joined(found, n.where("place = 1"), ["book", "chapter"], "c")
    found = joined(found, n.groupBy("book").agg(F.min(F.struct("chapter_order", "sort_order", "id"))["id"].alias("id")), ["book"], "b")
    how = F.when(F.col("t").isNotNull(), "title").when(F.col("p").isNotNull(), "place").when(F.col("c").isNotNull(), "chapter").when(F.col("b").isNotNull(), "book").otherwise("lost")
    return found.select(F.col("id").alias("old_id"), F.coalesce("t", "p", "c", "b").alias("new_id"), how.alias("how"))


def locate_issues(issues: DataFrame, sections: DataFrame) -> DataFrame:
    """issues with section_id: the section of the same file, else the first one of the same folder, else null.

    issues: issue_id, file. sections: id, file, sort_order.
    """
    from ..functions.text import dir_name

    by_file = sections.groupBy("file").agg(F.min(F.struct("sort_order", "id"))["id"].alias("_f"))
    by_dir = sections.withColumn("_d", dir_name(F.col("file"))).groupBy("_d").agg(F.min(F.struct("sort_order", "id"))["id"].alias("_s"))
    return issues.join(by_file, "file", "left").withColumn("_d", dir_name(F.col("file"))).join(by_dir, "_d", "left").select("issue_id", "file", F.coalesce("_f", "_s").alias("section_id"))


def empty_sections(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections with neither blocks nor children."""
    kids = sections.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return sections.join(blocks.select(F.col("section_id").alias("id")).distinct(), "id", "left_anti").join(kids, "id", "left_anti")
