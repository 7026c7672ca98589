"""Placing contents entries: a golden book, and random books against the rule told one entry at a time."""

import random

from pyspark.sql import functions as F

from quillstack.functions import printed
from quillstack.operators import contents, placing

ENTRIES = "book string, entry int, number string, title string, printed int"
HEADINGS = "book string, page int, item int, title string"
PAGES = "book string, page int, number int, body boolean"


def fit(entry, heading):
    words, other = printed.title_words(entry[3] or ""), printed.title_words(heading[3])
    if (entry[2] or "").lower() in printed.marks(heading[3]) or (words and words == other):
        return 2
    return int(min(len(words), len(other)) >= 6 and (words.startswith(other) or other.startswith(words)))


def chain(pairs):
    """The longest chain that rises in both, taking the earliest pair at each step from the end."""
    pairs = sorted(set(pairs))
    n = {}
    for p in pairs:
        n[p] = 1 + max((n[q] for q in pairs if q[0] < p[0] and q[1] < p[1]), default=0)
    want, at, out = max(n.values(), default=0), None, {}
    while want:
        at = min(p for p in pairs if n[p] == want and (at is None or p[0] < at[0] and p[1] < at[1]))
        out[at[0]] = at[1]
        want -= 1
    return out


def told(entries, headings, pages):
    """Entry by entry, with everything in memory."""
    entries, headings = sorted(entries, key=lambda e: e[1]), sorted(headings, key=lambda h: h[1:3])
    spot = lambda h: h[1] * placing.ITEMS + h[2]
    number, total = {p[1]: p[2] for p in pages}, max(p[1] for p in pages) + 1
    page_of = {p[2]: p[1] for p in sorted(pages, key=lambda p: p[1])}
    anchors = chain([(e[1], spot(h)) for e in entries for h in headings if fit(e, h) == 2])
    cursor = min((p[1] for p in pages if p[3]), default=total) * placing.ITEMS
    out, lost = {}, []
    for k, e in enumerate(entries):
        known = [(j, number[anchors[x[1]] // placing.ITEMS] - x[4]) for j, x in enumerate(entries) if j != k and x[1] in anchors and x[4] is not None]
        offset = next((o for j, o in reversed(known) if j < k), next((o for j, o in known if j > k), None))
        expected = None if offset is None or e[4] is None else e[4] + offset
        predicted = page_of.get(expected)
        limit = next((anchors[x[1]] // placing.ITEMS for x in entries[k + 1 :] if x[1] in anchors), total)
        pos = how = None
        if anchors.get(e[1], -1) >= cursor:
            pos, how = anchors[e[1]], "title"
        else:
            near = [spot(h) for h in headings if spot(h) >= cursor and h[1] <= limit and (predicted is None or abs(h[1] - predicted) <= 2) and fit(e, h)]
            if near:
                pos, how = near[0], "title"
            elif predicted is not None and cursor // placing.ITEMS < predicted < limit:
                pos, how = predicted * placing.ITEMS, "page"
        if pos is None:
            if expected is not None and expected > number[total - 1]:
                out[e[1]] = (None, None, expected, "beyond_source")
                continue
            lost.append((e, expected))
            continue
        cursor, out[e[1]] = pos + 1, (pos, how, expected, None)
    taken = {o[0] for o in out.values()}
    for e, expected in lost:
        free = [spot(h) for h in headings if fit(e, h) == 2 and spot(h) not in taken]
        out[e[1]] = (free[0], "out_of_order", expected, None) if len(free) == 1 else (None, None, expected, "unplaced")
        taken.update(free[:1] if len(free) == 1 else [])
    return out


def placed(spark, entries, headings, pages):
    rows = placing.place_entries(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(headings, HEADINGS), spark.createDataFrame(pages, PAGES)).collect()
    assert len({(r.book, r.entry) for r in rows}) == len(rows) == len(entries)
    return {(r.book, r.entry): (None if r.page is None else r.page * placing.ITEMS + r.item, r.how, r.expected, r.problem) for r in rows}


def test_random_books(spark):
    rng = random.Random(8)
    titles = ["Setting Up", "Setting Up Again", "Closures", "Whales", "Index", "Whales and more", "On", ""]
    entries, headings, pages = [], [], []
    for b in range(40):
        n = rng.randrange(2, 12)
        for p in range(n):
            pages.append((f"b{b}", p, p + 1 + (p > 4) + (rng.random() < 0.1), p > 1))
            for i in range(rng.randrange(3)):
                t = rng.choice(titles)
                if p > 1:
                    headings.append((f"b{b}", p, i, rng.choice([t, f"Chapter {rng.randrange(1, 6)}: {t}", f"{rng.randrange(1, 6)} {t}", "Part II", t.upper()])))
        for k in range(rng.randrange(1, 9)):
            entries.append((f"b{b}", k, rng.choice([None, str(k + 1), "ii"]), rng.choice(titles), rng.choice([None, rng.randrange(1, n + 6), k * 2])))
    got = placed(spark, entries, headings, pages)
    for b in range(40):
        mine = [[r for r in rows if r[0] == f"b{b}"] for rows in (entries, headings, pages)]
        want = told(*mine)
        assert {k: got[f"b{b}", k] for k in want} == want
    assert {how for _, how, _, _ in got.values()} == {"title", "page", "out_of_order", None} and {p for *_, p in got.values()} == {None, "unplaced", "beyond_source"}


def test_a_printed_book(spark):
    """A table with dot leaders; the offset of pages drifts, one entry is printed last though it is listed first."""
    contents_page = """# Contents at a Glance

| <b>About the Author .....</b>                   | <b>xi</b>   |
|-------------------------------------------------|-------------|
| <b>Introduction .....</b>                       | <b>xiii</b> |
| ■ <b>Chapter 1: First Steps .....</b>           | <b>1</b>    |
| An inner line                                   | 2           |
| ■ <b>Chapter 2: Understanding Loops .....</b>   | <b>3</b>    |
| <b>Index .....</b>                              | <b>6</b>    |"""
    pages = ["Cover", contents_page, "## **Introduction**", "## **First Steps**", "## On one system", "## **Understanding Loops**", "more", "## **Index**", "## **About the Author**"]
    lines = [("a", p, i, x) for p, text in enumerate(pages) for i, x in enumerate(text.split("\n"))]
    found = contents.read_contents(spark.createDataFrame(lines, "book string, page int, line_no int, line string")).orderBy("place").collect()
    assert [(r.kind, r.number, r.title, r.page) for r in found] == [
        ("matter", None, "About the Author", "xi"), ("matter", None, "Introduction", "xiii"), ("chapter", "1", "First Steps", "1"), ("chapter", "2", "Understanding Loops", "3"), ("matter", None, "Index", "6"),
    ]
    entries = [("a", r.place, r.number, r.title, int(r.page) if r.page.isdigit() else None) for r in found]
    headings = [("a", p, 0, text.strip("#* ")) for p, text in enumerate(pages) if p > 1 and text.startswith("#")]
    got = placed(spark, entries, headings, [("a", p, p + 1, p > 1) for p in range(len(pages))])
    assert [(got["a", e][0] // placing.ITEMS, got["a", e][1]) for e in range(1, 6)] == [(8, "out_of_order"), (2, "title"), (3, "title"), (5, "title"), (7, "title")]


def test_little(spark):
    assert placed(spark, [], [], []) == {}
    assert placed(spark, [("a", 0, "1", "One thing", 3)], [], []) == {("a", 0): (None, None, None, "unplaced")}
    assert placed(spark, [("a", 0, "1", "One thing", 3)], [("a", 4, 0, "Chapter 1")], [("a", i, i, True) for i in range(6)])["a", 0] == (4 * placing.ITEMS, "title", None, None)


def test_a_book_with_most_rows_streams(spark):
    """The cursor's memory is one entry and one position: a batch at a time, nothing is gathered by book."""
    plan = placing.place_entries(spark.createDataFrame([("a", 0, "1", "x", 1)], ENTRIES), spark.createDataFrame([("a", 0, 0, "x")], HEADINGS), spark.createDataFrame([("a", 0, 0, True)], PAGES))._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "BatchEvalPython" not in plan
    n = 20000
    entries = [("big", k, str(k + 1), f"title {k} w", k) for k in range(n)] + [("s", 0, "1", "x", None)]
    headings = [("big", k, 0, f"Chapter {k + 1}" if k % 2 else "else") for k in range(n)]
    got = placed(spark, entries, headings, [("big", k, k, True) for k in range(n)])
    assert sum(v[1] == "title" for v in got.values()) == n // 2 and got["big", 2][1] == "page"


def test_candidates_fit_by_one_join(spark):
    """As ``contents.strength`` says of every pair, with headings shuffled once."""
    words = ["", "a", "abcde", "abcdef", "abcdefg", "abcdefgh i", "abcdeg", "éàüöñç", "éàüöñçx", "abcdef "]
    e = spark.createDataFrame([(b, i, n, w) for b in (1, 2) for i, (w, n) in enumerate((w, n) for w in words for n in (None, "1", "IV"))], "book int, entry int, number string, words string")
    h = spark.createDataFrame([(b, i, w, m) for b in (1, 3) for i, (w, m) in enumerate((w, m) for w in words for m in ([], ["1"], ["iv", "2"]))], "book int, pos int, words string, marks array<string>")
    found = placing._candidates(e, h, ["book"])
    fit = contents.strength(F.col("e.words"), F.col("number"), F.col("h.words"), F.col("marks"))
    want = e.alias("e").join(h.alias("h"), F.col("e.book") == F.col("h.book")).select("e.book", "entry", "pos", fit.alias("fit")).where("fit > 0")
    assert {tuple(r) for r in found.collect()} == {(r.book, r.entry, r.pos, r.fit == 2) for r in want.collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
