"""Catalogue operators: book lists, categories, facets, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_chapters(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """books with chapter_count, the chapters that have a number (front matter has none)."""
    n = chapters.groupBy("book_id").agg(F.count("number").alias("_n"))
    return books.join(n, "book_id", "left").withColumn("chapter_count", F.coalesce("_n", F.lit(0))).drop("_n")


def all_chapters(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """books with chapter_count over all chapters."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("_n"))
    return books.join(n, "book_id", "left").withColumn("chapter_count", F.coalesce("_n", F.lit(0))).drop("_n")


def with_categories(books: DataFrame, categories: DataFrame) -> DataFrame:
    """books with their category's and its parent's names."""
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("parent_id").alias("category_parent_id"))
    p = categories.select(F.col("id").alias("category_parent_id"), F.col("name").alias("category_parent_name"))
    return books.join(c, "category_id", "left").join(p, "category_parent_id", "left")


def author_lists(books: DataFrame, authors: DataFrame) -> DataFrame:
    """books with author: the names of its author rows in name order, or else its own free text.

    authors: book_id, name.
    """
    names = authors.groupBy("book_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("_names"))
    return books.join(names, "book_id", "left").withColumn("author", F.coalesce("_names", "author")).drop("_names")


def shared_author_lists(books: DataFrame, authors: DataFrame, on: list[str]) -> DataFrame:
    """As ``author_lists``, for books that share their authors: a list is made once for all books that agree in ``on``.

    authors: the columns ``on``, name.  Nulls in ``on`` share nothing.  Books that
    share a list come one after the other, a large group in several partitions, so
    that files with dictionaries hold a list once and not once a book.
    """
    names = authors.groupBy(*on).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("_names"))
    parts = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = books.repartitionByRange(parts, *on, "book_id").sortWithinPartitions(*on)
    return grouped.join(names, on, "left").withColumn("author", F.coalesce("_names", "author")).drop("_names")


def category_counts(categories: DataFrame, books: DataFrame) -> DataFrame:
    """categories with book_count, of books directly in each."""
    n = books.groupBy("category_id").agg(F.count("*").alias("book_count"))
    return categories.join(n, categories["id"] == n["category_id"], "left").select("id", "name", "parent_id", F.coalesce("book_count", F.lit(0)).alias("book_count"))


def category_tree(categories: DataFrame) -> DataFrame:
    """root, name, children (names in order): categories whose parent is unknown are roots."""
    p = categories.select(F.col("id").alias("_p"))
    rooted = categories.join(p, F.col("parent_id") == F.col("_p"), "left")
    kids = rooted.where("_p is not null").groupBy("_p").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("children")).withColumnRenamed("_p", "_k")
    return rooted.where("_p is null").join(kids, F.col("id") == F.col("_k"), "left").select("id", "name", F.coalesce("children", F.lit("")).alias("children"))


def category_facet(books: DataFrame, categories: DataFrame) -> DataFrame:
    """top, child, n: counts per top category and per child; books on a top count there only."""
    c = categories.select(F.col("id").alias("category_id"), "name", F.col("parent_id").alias("_parent"))
    p = categories.select(F.col("id").alias("_parent"), F.col("name").alias("_parent_name"))
    named = books.join(c, "category_id").join(p, "_parent", "left").select(F.coalesce("_parent_name", "name").alias("top"), F.when(F.col("_parent_name").isNotNull(), F.col("name")).alias("child"))
    sets = named.groupingSets([["top"], ["top", "child"]], "top", "child").agg(F.count("*").alias("n"), F.grouping("child").alias("g"))
    return sets.where("g = 1 or child is not null").select("top", "child", "n")


def language_facet(books: DataFrame) -> DataFrame:
    """language, n: undetermined languages are left out."""
    return books.where(F.col("language").isNotNull() & (F.col("language") != "und")).groupBy("language").agg(F.count("*").alias("n"))


def catalogue_page(books: DataFrame, text: str, order: list[Column], page: int, size: int = 24) -> tuple[DataFrame, DataFrame]:
    """(one page of the books whose title or author contains text, pages: their number, one at least)."""
    hit = F.lower(F.col("title")).contains(text.lower()) | F.lower(F.coalesce("author", F.lit(""))).contains(text.lower())
    found = books.where(hit)
    return found.orderBy(*order).offset((page - 1) * size).limit(size), found.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("pages"))


def page_strip(df: DataFrame, page: str = "page", total: str = "total") -> DataFrame:
    """df with strip: the page numbers shown, first, last and around the current one, '…' for gaps."""
    near = F.array_sort(F.array_distinct(F.filter(F.array(F.lit(1), F.col(total), F.col(page) - 1, F.col(page), F.col(page) + 1), lambda p: (p >= 1) & (p <= F.col(total)))))
    shown = F.transform(near, lambda p, i: F.when((i > 0) & (p - F.coalesce(F.try_element_at(near, i), F.lit(0)) > 1), F.concat(F.lit("… "), p.cast("string"))).otherwise(p.cast("string")))
    return df.withColumn("strip", F.array_join(shown, " "))
