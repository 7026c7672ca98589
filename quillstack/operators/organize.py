"""Splitting chapter folders into sections: a written contents list, folders for its chapters, headings for its sections, cuts in the pages.

Nothing is gathered by book: lists are read by window functions, chapters find
their folders in rounds over all books at once, sections find their headings by
the streamed cursor of ``placing``, and pages are cut where they lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..functions.unicode import letters_key
from .placing import BAND, follow
from .ranking import written

#: Characters that a chapter's title must have, and a section's must exceed, before a longer name that begins with it counts.
CHAPTER_PREFIX, SECTION_PREFIX = 4, 6


def _label(title: Column) -> Column:
    """The number that leads a title: "1.2", "A.1"; '' if there is none."""
    first = F.substring_index(title, " ", 1)
    return F.when((first != title) & first.rlike(r"^(?:[0-9]+|[A-Z])(?:\.[0-9]+)+$"), first).otherwise("")


def _unlabelled(title: Column) -> Column:
    return F.when(_label(title) != "", F.trim(F.substring(title, F.length(_label(title)) + 1, F.length(title)))).otherwise(F.trim(title))


def contents_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters: book, number, title, page, subsections; sections: book, number, place, label, title, page).

    lines: book, line_no, line of a written list: ``1. **Title** — 3``, below it
    items ``- 1.1 Section — 4``.  The least indented items of a chapter are its
    sections, deeper ones are only counted.  A chapter told again
    (``_(continued)_``) goes on; any other line at the margin ends one.  Items
    without a page are not read.
    """
    w = Window.partitionBy("book").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.rtrim(F.regexp_replace("line", r"\s+$", ""))
    number = F.regexp_extract(line, r"^([0-9]{1,18})\.\s", 1)
    body = F.ltrim(F.regexp_replace(line, r"^\s*(?:[0-9]+\.|-)\s", ""))
    page = F.regexp_extract(body, r"\s—\s+([0-9]{1,9})$", 1)
    unpaged = F.when(page != "", F.regexp_replace(body, r"\s+—\s+[0-9]+$", "")).otherwise(body)
    title = F.trim(F.regexp_replace(F.regexp_replace(unpaged, r"\s+_\(continued\)_$", ""), r"^\*\*|\*\*$", ""))
    chapter = (number != "") & (title != "")
    item = line.rlike(r"^\s+- ") & (page != "")
    rows = lines.select(
        "book", "line_no", F.when(chapter, number.cast("long")).when(line.rlike(r"^\S"), -1).alias("_n"), item.alias("_item"), title.alias("title"), F.when(page != "", page.cast("int")).alias("page"),
        F.length(F.regexp_extract(line, r"^(\s*)", 1)).alias("_indent"),
    ).withColumn("number", F.last("_n", ignorenulls=True).over(w))
    inside = rows.where("number >= 0")
    told = inside.groupBy("book", "number").agg(
        F.min_by("title", F.when(F.col("_n") >= 0, F.col("line_no"))).alias("title"), F.min_by("page", F.when((F.col("_n") >= 0) & F.col("page").isNotNull(), F.col("line_no"))).alias("page"),
        F.count_if(F.col("_item") & F.col("_n").isNull()).alias("_items"),
    )
    of = Window.partitionBy("book", "number")
    entries = inside.where(F.col("_item") & F.col("_n").isNull()).withColumn("_base", F.min("_indent").over(of)).where("_indent = _base")
    sections = entries.select("book", "number", F.row_number().over(of.orderBy("line_no")).alias("place"), _label(F.col("title")).alias("label"), _unlabelled(F.col("title")).alias("title"), "page")
    counted = sections.groupBy("book", "number").agg(F.count("*").alias("_s"))
    chapters = told.join(counted, ["book", "number"], "left").select("book", "number", "title", "page", (F.col("_items") - F.coalesce("_s", F.lit(0))).alias("subsections"))
    return chapters, sections


def folder_parts(name: Column) -> tuple[Column, Column]:
    """Number and title of a chapter folder ``03_Title`` or ``P2-03_Title``; the number is null where the name isn't one, or is a part's own (``P2-00_``)."""
    bare = F.regexp_replace(name, "(?i)^P[0-9]+-", "")
    number = F.regexp_extract(bare, "^([0-9]{2,3})_.", 1)
    part = (bare != name) & number.rlike("^0+$")
    return F.when((number != "") & ~part, number.cast("int")), F.when(number != "", F.substring(bare, F.length(number) + 2, F.length(bare)))


def _wishes(chapters: DataFrame, folders: DataFrame) -> DataFrame:
    """book, number, rank (from 1), folder: the folders that a chapter would take, the best first: by title, then by number, each in the names' order."""
    # Keys are made once: each of the joins below would make them again, for every place that names them.
    number, title = folder_parts(F.col("folder"))
    f = written(folders.select("book", "folder", number.alias("_no"), title.alias("_t")).select("book", "folder", "_no", letters_key(F.col("_t")).alias("k")), "folders")
    c = written(chapters.select("book", "number", letters_key(F.col("title")).alias("t")), "chapters")
    n = CHAPTER_PREFIX
    titled = c.where(F.length("t") >= n)
    long = titled.withColumn("_h", F.left("t", F.lit(n))).join(f.where(F.length("k") >= n).withColumn("_h", F.left("k", F.lit(n))), ["book", "_h"]).where(F.col("k").startswith(F.col("t")) | F.col("t").startswith(F.col("k")))
    short = titled.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.left("t", i)))).join(f.where(F.length("k") < n), ["book", "k"])
    numbered = c.join(f, (c["book"] == f["book"]) & (c["number"] == f["_no"])).select(c["book"], "number", "folder", F.lit(1).alias("_by"))
    each = long.unionByName(short, allowMissingColumns=True).select("book", "number", "folder", F.lit(0).alias("_by")).unionByName(numbered)
    once = each.groupBy("book", "number", "folder").agg(F.min("_by").alias("_by")).withColumn("_order", natural_key(F.col("folder")))
    return once.select("book", "number", "folder", F.row_number().over(Window.partitionBy("book", "number").orderBy("_by", "_order", "folder")).alias("rank"))


def match_folders(chapters: DataFrame, folders: DataFrame) -> DataFrame:
    """book, number, folder: each chapter's folder, each folder once; chapters choose in the order of their numbers.

    chapters: book, number, title.  folders: book, folder (those to be split).
    The choice is found in rounds over all books: every chapter asks for its next
    folder, a folder keeps the lowest chapter that has asked, the others ask on.
    When no one of a book has to, each of its chapters has what it would have
    taken in turn, and the book is left out of what follows, with its wishes.  A
    round is a join and an aggregation, its outcome a written table; the rounds
    are as many as the longest run of refusals.
    """
    wishes = written(_wishes(chapters, folders), "wishes")
    asked, settled = wishes.where("rank = 1").select("book", "number", "rank"), []
    while True:
        held = asked.join(wishes, ["book", "number", "rank"]).repartition("book")
        least = F.min("number").over(Window.partitionBy("book", "folder"))
        open_ = F.bool_or(~F.col("kept")).over(Window.partitionBy("book"))
        state = written(held.withColumn("kept", F.col("number") == least).withColumn("open", open_), "asked")
        settled.append(state.where("not open").select("book", "number", "folder"))
        left = state.where("open")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        wishes = written(wishes.join(left.select("book").distinct(), "book", "left_semi"), "wishes")
        asked = left.select("book", "number", (F.col("rank") + F.when(F.col("kept"), 0).otherwise(1)).alias("rank"))


def page_offset(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """book, page_offset: how far a book's pages lie behind the printed ones, by most of its chapters' first pages; of equals, the one of the lowest chapter.

    pairs: book, number, page, folder.  pages: book, folder, page.
    """
    first = pages.groupBy("book", "folder").agg(F.min("page").alias("_first"))
    each = pairs.join(first, ["book", "folder"]).select("book", "number", (F.col("_first") - F.col("page")).alias("page_offset")).where("page_offset is not null")
    counts = each.groupBy("book", "page_offset").agg(F.count("*").alias("_n"), F.min("number").alias("_least"))
    best = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("_n"), "_least"))
    return counts.withColumn("_r", best).where("_r = 1").select("book", "page_offset")


def locate(sections: DataFrame, headings: DataFrame) -> DataFrame:
    """book, number, place, pos of every section: the first heading behind the one before it that has its title, near its page.

    sections: book, number, place, title, expected (page, null: anywhere).
    headings: book, number, pos (their order in the chapter, from 0), page (null:
    unknown), label, title.  A heading fits if its title, with or without its
    label, is the section's, or begins with it where that has over six letters.
    pos is null for a section that isn't found.
    """
    n = SECTION_PREFIX + 1
    s = sections.select("book", "number", "place", "expected", letters_key(F.col("title")).alias("t"))
    whole = letters_key(F.concat_ws(" ", F.nullif("label", F.lit("")), "title"))
    h = headings.select("book", "number", "pos", "page", F.explode(F.array_distinct(F.array(letters_key(F.col("title")), whole))).alias("k"))
    s, h = written(s, "sections"), written(h, "headings")  # each of the six joins below would make the keys again
    near = F.col("expected").isNull() | F.col("page").isNull() | (F.abs(F.col("page") - F.col("expected")) <= BAND)
    bin_ = lambda c: F.floor(c / (BAND + 1))
    # Sections with a page meet headings of the bins around it; the rest meet all of the title.
    paged = s.where("expected is not null").withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: bin_(F.col("expected")) + d)))
    ways = ((paged, h.where("page is not null").withColumn("_b", bin_(F.col("page"))), ["_b"]), (s.where("expected is not null"), h.where("page is null"), []), (s.where("expected is null"), h, []))
    found = []
    for a, b, extra in ways:
        on = ["book", "number", *extra]
        equal = a.join(b.withColumn("t", F.col("k")), [*on, "t"])
        longer = a.where(F.length("t") >= n).withColumn("_h", F.left("t", F.lit(n))).join(b.where(F.length("k") >= n).withColumn("_h", F.left("k", F.lit(n))), [*on, "_h"]).where(F.col("k").startswith(F.col("t")))
        found += [x.where(near).select("book", "number", "place", "pos") for x in (equal, longer)]
    cands = found[0]
    for x in found[1:]:
        cands = cands.unionByName(x)
    none = F.lit(None).cast("long")
    group = F.struct("book", "number").alias("book")
    entry = s.select(group, F.col("place").alias("entry"), none.alias("pos"), none.alias("anchor"), none.alias("predicted"), none.alias("limit"), F.lit(0).cast("long").alias("first"))
    rows = entry.unionByName(cands.distinct().select(group, F.col("place").alias("entry"), F.col("pos").cast("long").alias("pos")), allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in entry.schema}
    placed = rows.repartition("book").sortWithinPartitions("book", "entry", F.asc_nulls_first("pos")).mapInArrow(follow, f"book {kinds['book']}, entry {kinds['entry']}, pos long, how string")
    return placed.select("book.book", "book.number", F.col("entry").alias("place"), "pos")


def numbered_sections(headings: DataFrame) -> DataFrame:
    """book, folder, pos, label, title: a folder's headings ``N.1``, ``N.2`` where N is the commonest first part (of equals, the first seen); of one number, the first heading.

    headings: book, folder, pos, label, title.
    """
    two = headings.where(F.col("label").rlike(r"^(?:[0-9]+|[A-Z])\.[0-9]+$")).withColumn("_first", F.substring_index("label", ".", 1))
    of = Window.partitionBy("book", "folder")
    counts = two.groupBy("book", "folder", "_first").agg(F.count("*").alias("_n"), F.min("pos").alias("_p"))
    best = counts.withColumn("_r", F.row_number().over(of.orderBy(F.desc("_n"), "_p"))).where("_r = 1").select("book", "folder", "_first")
    nth = F.row_number().over(Window.partitionBy("book", "folder", "label").orderBy("pos"))
    return two.join(best, ["book", "folder", "_first"]).withColumn("_nth", nth).where("_nth = 1").select("book", "folder", "pos", "label", "title")


def cut_pages(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """book, folder, file, owner, piece, text: every page as it is, or cut at the lines where sections start.

    pages: book, folder, file, place (order in the folder), text.  starts: book,
    folder, file, line (from 1), index (of the section, from 0).  What stands
    before a folder's first start stays with the folder (owner -1); a page
    without a start belongs to the section that is open.  Pieces are numbered in
    the page's order; none is empty unless the page is.
    """
    cuts = starts.groupBy("book", "folder", "file").agg(F.array_sort(F.collect_list(F.struct(F.greatest(F.col("line") - 1, F.lit(0)).alias("at"), F.col("index").alias("owner")))).alias("_cuts"))
    w = Window.partitionBy("book", "folder").orderBy("place", "file").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.join(cuts, ["book", "folder", "file"], "left").withColumn("_open", F.coalesce(F.last(F.element_at("_cuts", -1)["owner"], ignorenulls=True).over(w), F.lit(-1)))
    none = F.array().cast("array<struct<at:int,owner:int>>")
    marks = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("_open").cast("int").alias("owner"))), F.transform(F.coalesce("_cuts", none), lambda c: F.struct(c["at"].cast("int").alias("at"), c["owner"].cast("int").alias("owner"))))
    split = rows.withColumns({"_lines": F.split(F.coalesce("text", F.lit("")), r"(?<=\n)"), "_marks": marks})
    total = F.size("_lines")
    upto = lambda i: F.coalesce(F.try_element_at("_marks", i + 2)["at"], total)
    text = lambda m, i: F.array_join(F.slice("_lines", m["at"] + 1, F.greatest(upto(i) - m["at"], F.lit(0))), "")
    pieces = F.transform("_marks", lambda m, i: F.struct(m["owner"].alias("owner"), F.when(m["at"] < total, text(m, i)).otherwise("").alias("text")))
    full = F.filter(pieces, lambda p: p["text"] != "")
    kept = F.when(F.size(full) > 0, full).otherwise(F.slice(pieces, 1, 1))
    return split.select("book", "folder", "file", F.posexplode(kept).alias("piece", "_p")).select("book", "folder", "file", "_p.owner", "piece", "_p.text")


def broken(pages: DataFrame, pieces: DataFrame) -> DataFrame:
    """book, folder, files: folders whose pieces, put together in the sections' order, aren't their pages byte for byte, and how many pages are wrong.

    Two pieces of a page for one section would overwrite each other: that is broken, too.
    """
    joined = pieces.groupBy("book", "folder", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("owner", "piece", "text"))), lambda p: p["text"]), "").alias("_text"), (F.count("*") > F.count_distinct("owner")).alias("_twice"))
    both = pages.select("book", "folder", "file", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_want")).join(joined, ["book", "folder", "file"], "full")
    wrong = F.col("_want").isNull() | F.col("_text").isNull() | F.col("_twice") | (F.sha2(F.col("_text").cast("binary"), 256) != F.col("_want"))
    return both.where(wrong).groupBy("book", "folder").agg(F.count("*").alias("files"))


def split_folders(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """pages cut by the plan (``cut_pages``), where every page of a folder joins again; a folder that doesn't stays as it was, all with owner -1.  ``split`` tells which."""
    pieces = written(cut_pages(pages, starts), "pieces")
    bad = broken(pages, pieces).select("book", "folder")
    whole = pages.join(bad, ["book", "folder"], "left_semi").select("book", "folder", "file", F.lit(-1).alias("owner"), F.lit(0).alias("piece"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("split"))
    return pieces.join(bad, ["book", "folder"], "left_anti").withColumn("split", F.lit(True)).unionByName(whole)
