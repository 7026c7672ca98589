"""Where contents entries begin in a book's pages.

An entry stands at a heading that fits it or at the top of a page.  Exact fits
that keep the order of both the contents and the book are anchors
(``contents.anchor_chain``).  Every other entry is looked for behind the entry
placed before it and not beyond the next anchor's page: near the page that its
printed number and the nearest anchor's offset predict, or anywhere if nothing
predicts it.

Candidates come from equality joins (number, whole title, or first six
characters, each within a page or between two anchors).  The cursor, which is
what makes the search sequential, runs over sorted rows: an entry, then its
candidates in book order.  It holds one position and one entry, so a book may
have any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import printed
from ..functions.labels import role
from ..functions.unicode import slugify
from .contents import anchor_chain, match_strength
from .ranking import written

#: Pages before and behind the predicted one that are searched.
BAND = 2
#: Items of a page at most; a position is page * ITEMS + item.
ITEMS = 1 << 24
HOW = ("title", "page", "out_of_order")


def _number(pages: DataFrame) -> DataFrame:
    """The page of each number: of several pages with one number, the last."""
    return pages.where("number is not null").groupBy("book", "number").agg(F.max("page").alias("_of"))


def _beginnings(words: Column, labels: Column) -> Column:
    """The keys that an entry and a heading that fits it share: a label, a short title, or the first six characters of one, with its rest."""
    kind = "array<struct<key: string, rest: string>>"
    none = F.lit(None).cast("string").alias("rest")
    of = F.when(F.length(words) >= 6, F.array(F.struct(F.concat(F.lit("w"), F.left(words, F.lit(6))).alias("key"), F.substring(words, 7, 1 << 30).alias("rest"))))
    of = of.when(words != "", F.array(F.struct(F.concat(F.lit("s"), words).alias("key"), none))).otherwise(F.array().cast(kind))
    return F.explode(F.concat(F.transform(labels, lambda m: F.struct(F.concat(F.lit("m"), m).alias("key"), none)), of))


def _candidates(entries: DataFrame, headings: DataFrame, on: list[str]) -> DataFrame:
    """book, entry, pos, exact of every fitting heading, among rows that agree in ``on``; fitting as ``contents.strength`` has it. Headings are shuffled once, without what the key tells."""
    label = F.when(F.col("number").isNotNull(), F.array(F.lower("number"))).otherwise(F.array().cast("array<string>"))
    e = entries.select(*on, "entry", _beginnings(F.col("words"), label).alias("_b")).select(*on, "entry", "_b.key", F.col("_b.rest").alias("e"))
    h = headings.select(*on, "pos", _beginnings(F.col("words"), F.col("marks")).alias("_b")).select(*on, "pos", "_b.key", F.col("_b.rest").alias("h"))
    exact = F.col("h").isNull() | (F.col("e") == F.col("h"))
    found = e.join(h, [*on, "key"]).where(exact | F.col("e").startswith(F.col("h")) | F.col("h").startswith(F.col("e")))
    return found.groupBy("book", "entry", "pos").agg(F.bool_or(exact).alias("exact"))


def _exact(entries: DataFrame, headings: DataFrame) -> DataFrame:
    same = entries.where("words <> ''").select("book", "entry", "words").join(headings.select("book", "pos", "words"), ["book", "words"]).select("book", "entry", "pos")
    label = entries.where("number is not null").select("book", "entry", F.lower("number").alias("_m")).join(headings.select("book", "pos", F.explode("marks").alias("_m")), ["book", "_m"]).select("book", "entry", "pos")
    return same.unionByName(label).distinct()


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a book by entry: the entry (no ``pos``), then its candidates. Gives each entry its position and how it was found."""
    book = entry = None
    begun = False
    cursor, found, row = 0, None, None
    out: list[tuple] = []

    def settle() -> None:
        nonlocal cursor
        pos, how = found
        if pos is None and row["predicted"] is not None and cursor // ITEMS < row["predicted"] < row["limit"]:
            pos, how = row["predicted"] * ITEMS, "page"
        if pos is not None:
            cursor = pos + 1
        out.append((book, entry, pos, how))

    def batch(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (schema.field("book").type, schema.field("entry").type, pa.int64(), pa.string()), strict=True)], ["book", "entry", "pos", "how"])

    schema = None
    for b in batches:
        schema = b.schema
        names = ("book", "entry", "pos", "anchor", "predicted", "limit", "first")
        for values in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            r = dict(zip(names, values, strict=True))
            if r["pos"] is None:
                if begun:
                    settle()
                if not begun or r["book"] != book:
                    cursor = r["first"] * ITEMS
                begun, book, entry, row = True, r["book"], r["entry"], r
                found = (r["anchor"], "title") if r["anchor"] is not None and r["anchor"] >= cursor else (None, None)
            elif found[0] is None and r["pos"] >= cursor:
                found = (r["pos"], "title")
        if out:
            yield batch(schema)
    if begun:
        settle()
        yield batch(schema)


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a book by entry and position, all of entries without a place: an entry with one free heading takes it. Holds the headings taken here."""
    book, entry, begun = None, None, False
    taken: set[int] = set()
    free: list[int] = []
    for b in batches:
        out: list[tuple] = []
        for g, e, pos in zip(b.column("book").to_pylist(), b.column("entry").to_pylist(), b.column("pos").to_pylist(), strict=True):
            if not begun or (g, e) != (book, entry):
                if begun and len(free) == 1:
                    out.append((book, entry, free[0]))
                    taken.add(free[0])
                if not begun or g != book:
                    taken.clear()
                begun, book, entry, free = True, g, e, []
            if pos not in taken and len(free) < 2:
                free.append(pos)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], b.schema.field(c).type) for i, c in enumerate(("book", "entry", "pos"))], ["book", "entry", "pos"])
        last = b
    if begun and len(free) == 1:
        yield pa.RecordBatch.from_arrays([pa.array([v], last.schema.field(c).type) for c, v in (("book", book), ("entry", entry), ("pos", free[0]))], ["book", "entry", "pos"])


def place_entries(entries: DataFrame, headings: DataFrame, pages: DataFrame) -> DataFrame:
    """book, entry, page, item, how, expected, problem of every entry.

    entries: book, entry (their order), number, title, printed (the page number
    as printed; null if none or roman).  headings: book, page, item, title, of
    the pages behind the contents.  pages: book, page (from 0), number (of its
    file), body (behind the contents).

    ``how``: at a heading ("title"), at the top of the predicted page ("page"),
    or, for an entry that found no place in order, at the one heading that is its
    title and where nothing else begins ("out_of_order").  ``expected`` is the
    page number that the print predicts; ``problem`` of an entry without a place
    is "beyond_source" if that lies behind the last page, else "unplaced".
    Entries of books without pages are unplaced; null books, entries and
    positions are left out; of headings at one position any is taken.
    """
    e = written(entries.where("book is not null and entry is not null").withColumn("words", printed.keys(F.col("title"))["words"]).select("book", "entry", "number", "printed", "words"), "entries")
    keyed = headings.where("book is not null and page is not null and item is not null").withColumn("_k", printed.keys(F.col("title")))
    h = written(keyed.select("book", "page", (F.col("page").cast("long") * ITEMS + F.col("item")).alias("pos"), F.col("_k.words").alias("words"), F.col("_k.marks").alias("marks")), "headings")
    exact = written(_exact(e, h), "exact")
    anchors = anchor_chain(exact, "book", "entry", "pos")
    book = pages.groupBy("book").agg((F.max("page") + 1).alias("_pages"), F.max_by("number", "page").alias("_last"), F.coalesce(F.min(F.when(F.col("body"), F.col("page"))), F.max("page") + 1).alias("first"))
    order = Window.partitionBy("book").orderBy("entry")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    numbers = pages.select("book", F.col("page").cast("long").alias("_at"), F.col("number").alias("_no"))
    known = e.join(anchors.withColumnRenamed("pos", "anchor"), ["book", "entry"], "left").withColumn("_at", F.floor(F.col("anchor") / ITEMS))
    known = known.join(numbers, ["book", "_at"], "left").join(book, "book", "left").withColumn("_offset", F.col("_no") - F.col("printed"))
    near = F.coalesce(F.last("_offset", ignorenulls=True).over(before), F.first("_offset", ignorenulls=True).over(behind))
    limit = F.coalesce(F.first("_at", ignorenulls=True).over(behind), F.col("_pages"))
    seg = F.count("anchor").over(order.rowsBetween(Window.unboundedPreceding, 0))  # an anchor that is passed over has the cursor behind it
    known = known.withColumns({"expected": F.col("printed") + near, "limit": limit, "seg": seg})
    known = written(known.join(_number(pages).withColumnsRenamed({"number": "expected", "_of": "predicted"}), ["book", "expected"], "left"), "known")
    # Headings within the band of a predicted page, and headings between two anchors for the others.
    banded = known.where("predicted is not null").withColumn("page", F.explode(F.transform(F.sequence(F.lit(-BAND), F.lit(BAND)), lambda d: F.col("predicted") + d))).where("page <= limit")
    close = _candidates(banded, h, ["book", "page"])
    # A heading lies behind _upto anchors, _low of them on earlier pages; stretches between anchors go on to the end of the next anchor's page.
    marked = anchors.select("book", F.floor(F.col("pos") / ITEMS).cast(h.schema["page"].dataType).alias("page"), "pos", F.lit(1).alias("_a"))
    both = h.withColumn("_a", F.lit(0)).unionByName(marked, allowMissingColumns=True)
    upto = F.sum("_a").over(Window.partitionBy("book").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))
    low = F.coalesce(F.sum("_a").over(Window.partitionBy("book").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    between = both.withColumns({"_upto": upto, "_low": low}).where("_a = 0").withColumn("seg", F.explode(F.sequence("_low", "_upto")))
    loose = _candidates(known.where("predicted is null").select("book", "entry", "number", "words", "seg"), between, ["book", "seg"])
    cands = close.unionByName(loose)
    rows = known.select("book", "entry", F.lit(None).cast("long").alias("pos"), "anchor", "predicted", "limit", "first").unionByName(cands.select("book", "entry", "pos"), allowMissingColumns=True)
    rows = rows.where("limit is not null or pos is not null").withColumns({c: F.col(c).cast("long") for c in ("predicted", "limit", "first")})
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    placed = written(rows.repartition("book").sortWithinPartitions("book", "entry", F.asc_nulls_first("pos")).mapInArrow(follow, f"book {kinds['book']}, entry {kinds['entry']}, pos long, how string"), "placed")
    beyond = F.col("expected") > F.col("_last")
    full = known.join(placed, ["book", "entry"], "left").select("book", "entry", "number", "words", "expected", "pos", "how", F.coalesce(beyond & F.col("pos").isNull(), F.lit(False)).alias("_beyond"))
    left = full.where("pos is null and not _beyond")
    free = exact.join(left.select("book", "entry"), ["book", "entry"], "left_semi").join(placed.where("pos is not null").select("book", "pos").distinct(), ["book", "pos"], "left_anti")
    again = free.select("book", "entry", "pos").repartition("book").sortWithinPartitions("book", "entry", "pos").mapInArrow(_second, f"book {kinds['book']}, entry {kinds['entry']}, pos long")
    both = full.join(again.withColumnRenamed("pos", "_again"), ["book", "entry"], "left").withColumn("how", F.when(F.col("_again").isNotNull(), HOW[2]).otherwise(F.col("how"))).withColumn("pos", F.coalesce("pos", "_again"))
    problem = F.when(F.col("pos").isNull(), F.when(F.col("_beyond"), "beyond_source").otherwise("unplaced"))
    return both.select("book", "entry", F.floor(F.col("pos") / ITEMS).cast("int").alias("page"), F.pmod("pos", F.lit(ITEMS)).cast("int").alias("item"), "how", F.col("expected").cast("int").alias("expected"), problem.alias("problem"))


def elements(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """book, place, entry, page, item, role, number, title, slug, part: the book's elements in order, from 1 (0: what comes before them).

    entries: book, entry, kind, number, title.  placed: book, entry, page, item.
    Unplaced entries make no element.  A role is the entry's label, the role that
    an unnumbered title names, or front or back matter by its place before or
    behind the first labelled element.  ``part`` is the place of the part that
    an element belongs to: the last one before it that no front or back matter
    has closed.  Equal slugs are counted on.
    """
    w = Window.partitionBy("book").orderBy("page", "item")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = placed.where("page is not null").join(entries.select("book", "entry", "kind", "number", "title"), ["book", "entry"]).withColumn("place", F.row_number().over(w))
    named = role(F.regexp_replace("title", r"\s+", "-"))
    labelled = F.max(F.col("kind") != "matter").over(upto)
    kind = F.when(F.col("kind") != "matter", F.col("kind")).otherwise(F.coalesce(named, F.when(labelled, "back_matter").otherwise("front_matter")))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).when(F.col("kind") == "chapter", F.concat(F.lit("Chapter "), "number")).otherwise(F.concat_ws(" ", F.initcap("kind"), "number"))
    typed = starts.withColumns({"role": kind, "title": title})
    step = F.when(F.col("role") == "part", F.col("place")).when(F.col("role").isin("front_matter", "back_matter"), 0)
    opened = F.last(step, ignorenulls=True).over(upto)
    part = F.when(~F.col("role").isin("part", "front_matter", "back_matter"), F.nullif(opened, F.lit(0)))
    based = typed.withColumns({"part": part, "_slug": slugify(F.col("title"))})
    nth = F.row_number().over(Window.partitionBy("book", "_slug").orderBy("place"))
    slug = F.when(nth == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), nth.cast("string")))
    return based.select("book", "place", "entry", "page", "item", "role", "number", "title", slug.alias("slug"), "part")


def assign(items: DataFrame, elements: DataFrame, entries: DataFrame) -> DataFrame:
    """items with place (of their element, 0 before the first) and kind: opening headings that fit the entry, two at most, are "title", others "subheading".

    items: book, page, item, kind, title.  elements: ``elements``.  entries: book, entry, number, title.
    """
    e = elements.join(entries.select("book", "entry", F.col("number").alias("_no"), F.col("title").alias("_name")), ["book", "entry"])
    marks = e.select("book", "page", "item", F.lit(0).alias("_i"), F.struct("place", "_no", "_name").alias("_e"))
    both = items.withColumns({"_i": F.lit(1), "_e": F.lit(None).cast(marks.schema["_e"].dataType)}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("book").orderBy("page", "item", "_i").rowsBetween(Window.unboundedPreceding, 0)
    owned = both.withColumn("_e", F.last("_e", ignorenulls=True).over(w)).where("_i = 1")
    fits = (F.col("kind") == "heading") & F.col("_e").isNotNull() & (match_strength(F.col("_e._name"), F.col("title"), F.col("_e._no")) > 0)
    own = Window.partitionBy("book", "place").orderBy("page", "item").rowsBetween(Window.unboundedPreceding, 0)
    flagged = owned.withColumns({"place": F.coalesce("_e.place", F.lit(0)), "_fits": fits})
    opening = F.bool_and("_fits").over(own) & (F.count("*").over(own) <= 2)
    kind = F.when(opening, "title").when(F.col("kind") == "heading", "subheading").otherwise(F.col("kind"))
    return flagged.withColumn("_k", kind).drop("_i", "_e", "_fits", "kind").withColumnRenamed("_k", "kind")
