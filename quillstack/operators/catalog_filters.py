"""Catalogue, reading and editorial views: filters, guards, orders and the state that they change, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """The rows whose column equals value; raises LookupError if there is none."""
    found = df.where(F.col(column).eqNullSafe(F.lit(value)))
    if found.limit(1).count() == 0:
        raise LookupError(f"no row has {column} = {value!r}")
    return found


def catalogue(books: DataFrame, categories: DataFrame, text: str | None = None, category: str | None = None, language: str | None = None, shelf: DataFrame | None = None, columns: tuple[str, ...] = ("title", "author", "series")) -> DataFrame:
    """Books whose title, author or series contains the text, in the category or under it, in the language and on the shelf; None: any.

    Null fields contain nothing.  shelf: book_id.
    """
    out = books
    if text:
        wanted = text.strip().lower()
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in columns if c in books.columns]))
    if category is not None:
        under = categories.where((F.col("id") == category) | (F.col("parent_id") == category)).select(F.col("id").alias("category_id"))
        out = out.join(under, "category_id", "left_semi")
    if language is not None:
        out = out.where(F.col("language") == language)
    return out if shelf is None else out.join(shelf.select("book_id").distinct(), "book_id", "left_semi")


def saved(shelves: DataFrame) -> DataFrame:
    """Books that a reader has marked in any way."""
    return shelves.where(F.coalesce("favorite", F.lit(False)) | F.coalesce("wishlist", F.lit(False)))


def glossary_filter(terms: DataFrame, text: str) -> DataFrame:
    """Terms whose name or expansion contains the text, case apart; '' keeps all."""
    t = text.strip().lower()
    return terms.where(F.coalesce(F.lower("term").contains(t), F.lit(False)) | F.coalesce(F.lower("expansion").contains(t), F.lit(False))) if t else terms


def section_header(sections: DataFrame, chapters: DataFrame, draft: bool = False) -> DataFrame:
    """Sections with their chapter's title and number; the saved draft only for editors."""
    out = sections.join(chapters, "chapter")
    return out if draft or "draft_markdown" not in out.columns else out.drop("draft_markdown")


def owned_revision(revisions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (section_id, revision_id) pairs whose revision belongs to their section, with the revision's columns."""
    return asked.join(revisions, ["section_id", "revision_id"])


def pending(files: DataFrame, applied: DataFrame, name: str = "name") -> DataFrame:
    """Migrations on disk that have not been applied."""
    return files.join(applied.select(name), name, "left_anti")


def oldest(accounts: DataFrame, group: list[str], created: str = "created_at", key: str = "id") -> DataFrame:
    """The oldest account of each group (of equals the lowest key): the one to link."""
    best = accounts.groupBy(*group).agg(F.min(F.struct(created, key)).alias("_m"))
    return best.select(*group, F.col(f"_m.{key}").alias(key), F.col(f"_m.{created}").alias(created))


def capped(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group: what a list on a page shows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def page_order(files: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """files with place: by the page numbers in the names of a group whose names all have one, else in natural order."""
    from ..functions.text import natural_key

    number = F.regexp_extract(name, r"_page_([0-9]+)\.md$", 1)
    w = Window.partitionBy(*group)
    numbered = files.withColumn("_all", F.min(F.when(number != "", 1).otherwise(0)).over(w)).withColumn("_key", natural_key(F.col(name)))
    first = F.when(F.col("_all") == 1, number.cast("int"))
    return numbered.withColumn("place", F.row_number().over(w.orderBy(first, "_key", name))).drop("_all", "_key")


def first_seen(entries: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first mention of each contents entry: by kind and number, or by kind and title where there is no number."""
    key = F.when(F.coalesce("number", F.lit("")) != "", F.concat_ws(":", "kind", "number")).otherwise(F.concat_ws(":", "kind", F.lower("title")))
    w = Window.partitionBy(*group, key).orderBy(*order)
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_part(elements: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """elements with part: the last part before a chapter or appendix, none behind the next front or back matter."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = elements.withColumn("_run", F.count_if(F.col("kind") == "matter").over(w))
    inner = Window.partitionBy(*group, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = F.last(F.when(F.col("kind") == "part", F.col("title")), ignorenulls=True).over(inner)
    return runs.withColumn("part", F.when(F.col("kind").isin("chapter", "appendix"), part)).drop("_run")


def indent_levels(lines: DataFrame, group: list[str], text: str = "line") -> DataFrame:
    """lines with level: spaces (a tab is two) beyond the least indented line of the group, halved."""
    width = F.length(F.replace(F.regexp_extract(text, r"^(\s*)", 1), F.lit("\t"), F.lit("  ")))
    return lines.withColumn("_w", width).withColumn("level", F.floor((F.col("_w") - F.min("_w").over(Window.partitionBy(*group))) / 2).cast("int")).drop("_w")


def author_names(names: Column) -> Column:
    """A book's authors as they are saved: trimmed, each once, none empty."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def import_counts(books: DataFrame, sections: DataFrame) -> DataFrame:
    """book, sections (of role section), blocks: the lines of an import's table."""
    return books.join(sections.groupBy("book").agg(F.count_if(F.col("role") == "section").alias("sections")), "book", "left").select(*books.columns, F.coalesce("sections", F.lit(0)).alias("sections"))


def actions(imports: DataFrame) -> DataFrame:
    """How many books an import loads, reloads and skips."""
    return imports.groupBy("action").agg(F.count("*").alias("n"))


def blocks_below(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """id, n: blocks of each section and of all sections under it."""
    from .tree import descendants

    own = blocks.groupBy("section_id").agg(F.count("*").alias("_n"))
    under = descendants(sections, sections.select("id"))
    return under.join(own, under["id"] == own["section_id"], "left").groupBy("root").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).withColumnRenamed("root", "id")


def upsert_names(old: DataFrame, wanted: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """key, name of all old and wanted names: known names keep their key, new ones follow the largest in order of name."""
    fresh = wanted.select(name).where(F.col(name).isNotNull()).distinct().join(old, name, "left_anti")
    from .ranking import numbered

    top = old.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))
    new = numbered(fresh, [name], "_n").join(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias(key), name)
    return old.select(key, name).unionByName(new)


def relink(users: DataFrame, logins: DataFrame) -> DataFrame:
    """users after the logins: marked accounts go to their owner's subject, known subjects get their new address, others become accounts.

    users: id, email, subject, created_at, relink.  logins: subject, email,
    verified, at.  A verified login whose subject no account has takes the oldest
    account of its address (without regard to case) that is marked ``relink``,
    and the mark goes; of several new subjects with one address, each takes the
    next, in the order of their first logins.  A subject's last login gives its
    address.  New accounts' ids follow the largest, in order of the subjects.
    Logins without a subject count for nothing.
    """
    from .ranking import numbered

    real = logins.where("subject is not null").withColumn("email", F.lower("email"))
    last = real.groupBy("subject").agg(F.max_by("email", F.struct("at", "email")).alias("_email"), F.min("at").alias("_since"))
    first = real.where("verified and coalesce(email, '') <> ''").join(users.select("subject").where("subject is not null"), "subject", "left_anti").groupBy("subject").agg(F.min(F.struct("at", "email")).alias("_f"))
    turn = first.select("subject", F.col("_f.email").alias("_key"), F.row_number().over(Window.partitionBy("_f.email").orderBy("_f.at", "subject")).alias("_n"))
    marked = users.where("relink and email is not null").select("id", F.lower("email").alias("_key"), F.row_number().over(Window.partitionBy(F.lower("email")).orderBy("created_at", "id")).alias("_n"))
    given = marked.join(turn, ["_key", "_n"]).select("id", F.col("subject").alias("_s"))
    owned = users.join(given, "id", "left").withColumns({"subject": F.coalesce("_s", "subject"), "relink": F.when(F.col("_s").isNotNull(), False).otherwise(F.col("relink"))}).drop("_s")
    known = owned.join(last, "subject", "left").withColumn("email", F.coalesce("_email", "email")).select(*users.columns)
    fresh = last.join(owned.select("subject").where("subject is not null"), "subject", "left_anti")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    new = numbered(fresh, ["subject"], "_n").join(F.broadcast(top))
    made = {"id": (F.col("_top") + F.col("_n")).cast(users.schema["id"].dataType), "email": F.col("_email"), "subject": F.col("subject"), "created_at": F.col("_since").cast(users.schema["created_at"].dataType), "relink": F.lit(False)}
    return known.unionByName(new.select(*(made.get(c, F.lit(None)).alias(c) for c in users.columns)))


def replace_links(links: DataFrame, wanted: DataFrame, left: str) -> DataFrame:
    """Links after those of every left key in wanted have been replaced by wanted's, each once."""
    return links.join(wanted.select(left).distinct(), left, "left_anti").unionByName(wanted.select(*links.columns).distinct())


def delete_unused(rows: DataFrame, asked: DataFrame, users: list[tuple[DataFrame, str]], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, asked keys refused): a row goes only if no other table refers to it."""
    used = reduce(lambda a, b: a.unionByName(b), [df.select(F.col(c).alias(key)).where(F.col(key).isNotNull()) for df, c in users]).distinct()
    refused = asked.select(key).distinct().join(used, key, "left_semi")
    return rows.join(asked.select(key).distinct().join(refused, key, "left_anti"), key, "left_anti"), refused


def save_drafts(sections: DataFrame, revisions: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, each with the last of its drafts; revisions with one more for every draft that was saved, changed or not).

    sections: id, draft_markdown.  drafts: id, markdown, saved_at.  revisions:
    section_id, markdown, saved_at.  Drafts without a text or of no section are refused.
    """
    saved = drafts.where("markdown is not null").join(sections.select("id"), "id", "left_semi")
    last = saved.groupBy("id").agg(F.max(F.struct("saved_at", "markdown"))["markdown"].alias("_m"))
    now = sections.join(last, "id", "left").withColumn("draft_markdown", F.coalesce("_m", "draft_markdown")).select(*sections.columns)
    return now, revisions.unionByName(saved.select(F.col("id").alias("section_id"), "markdown", "saved_at").select(*revisions.columns))


def restore(revisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """section_id, revision_id, markdown: a revision's own Markdown, or its blocks put together where it has none.

    revisions: section_id, revision_id, markdown.  blocks: revision_id, sort_order, markdown.
    """
    listed = F.array_sort(F.collect_list(F.struct("sort_order", "markdown")))
    made = blocks.groupBy("revision_id").agg(F.array_join(F.transform(listed, lambda x: x["markdown"]), "\n\n").alias("_b"))
    return revisions.join(made, "revision_id", "left").select("section_id", "revision_id", F.coalesce("markdown", "_b", F.lit("")).alias("markdown"))


def new_subsections(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (chapter, parent_id, title) with depth and whether it is allowed: a parent must be a section of the same chapter; without one the depth is 0."""
    p = sections.select(F.col("id").alias("parent_id"), F.col("chapter").alias("_c"), F.col("depth").alias("_d"))
    ok = F.col("parent_id").isNull() | F.coalesce(F.col("_c").eqNullSafe(F.col("chapter")) & F.col("_d").isNotNull(), F.lit(False))
    return wanted.join(p, "parent_id", "left").withColumn("allowed", ok).withColumn("depth", F.when(F.col("allowed"), F.coalesce(F.col("_d") + 1, F.lit(0)))).select(*wanted.columns, "depth", "allowed")


def carry_status(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """new with the status and draft of the old sections that match by title or place; other matches carry nothing.

    matches: old_id, new_id, how.  old and new: id, status, draft_markdown.
    """
    kept = matches.where(F.col("how").isin("title", "place")).join(old.select(F.col("id").alias("old_id"), F.col("status").alias("_s"), F.col("draft_markdown").alias("_d")), "old_id")
    one = kept.groupBy(F.col("new_id").alias("id")).agg(F.min_by(F.struct("_s", "_d"), "old_id").alias("_k"))
    return new.join(one, "id", "left").withColumn("status", F.coalesce("_k._s", "status")).withColumn("draft_markdown", F.coalesce("_k._d", "draft_markdown")).select(*new.columns)


def grant(users: DataFrame, emails: DataFrame, role: str = "editor") -> DataFrame:
    """users with the role for those of the given addresses that have signed in."""
    asked = emails.select(F.lower("email").alias("_e")).distinct().withColumn("_ok", F.lit(True))
    named = users.join(asked, F.lower("email") == F.col("_e"), "left")
    return named.withColumn("role", F.when(F.col("_ok") & F.col("subject").isNotNull(), role).otherwise(F.col("role"))).select(*users.columns)


def import_reports(old: DataFrame, new: DataFrame, key: str = "book") -> DataFrame:
    """One report a book: the new one in place of the old."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def file_line(start: Column, fenced: Column, line: Column) -> Column:
    """The file's line of a snippet's line: a fence takes one."""
    return start + F.when(fenced, 1).otherwise(0) + line - 1
