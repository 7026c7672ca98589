"""The organiser: a golden book, random books against the rule told in turn, and cuts that must join again."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import organize
from quillstack.operators.ranking import written

LIST = """# Table of Contents
- **Preface** — xiii
## Part I. Basics
1. **Threads** — 1
   - 1.1 Spawning — 2
     - 1.1.1 Thread ID — 2
   - 1.2 Scoped Threads — 3
2. **Atomics** — 5
   - Atomic Loads — 5
## Part II
   - Nobody's — 6
1. **Threads** _(continued)_
   - 1.3 Late — 4
   - no page"""
PAGES = {
    "01_Threads/b_page_0011.md": "## CHAPTER 1 Threads\n\nIntro.\n\n## 1.1 Spawning\n\nSpawn.\n",
    "01_Threads/b_page_0012.md": "## Thread ID\n\nIds.\n\n## 1.2 Scoped Threads\n\nScoped.\n",
    "01_Threads/b_page_0013.md": "More scoped.\n",
    "02_Atomics/b_page_0015.md": "## Atomics\n\nWhy.\n\n## Atomic Loads\n\nLoad.",
}


def test_contents_list(spark):
    lines = [("b", i, x) for i, x in enumerate(LIST.split("\n"))]
    chapters, sections = organize.contents_list(spark.createDataFrame(lines, "book string, line_no int, line string"))
    assert [tuple(r)[1:] for r in chapters.orderBy("number").collect()] == [(1, "Threads", 1, 1), (2, "Atomics", 5, 0)]
    assert [tuple(r)[1:] for r in sections.orderBy("number", "place").collect()] == [(1, 1, "1.1", "Spawning", 2), (1, 2, "1.2", "Scoped Threads", 3), (1, 3, "1.3", "Late", 4), (2, 1, "", "Atomic Loads", 5)]


def key(t):
    return "".join(c for c in t.lower() if c.isalnum())


def in_turn(chapters, folders):
    used, out = set(), {}
    for number, title in sorted(chapters):
        want, free = key(title), [f for f in sorted(folders) if f not in used]
        named = [f for f in free if len(want) >= 4 and (key(f[3:]).startswith(want) or want.startswith(key(f[3:])))]
        hit = (named or [f for f in free if int(f[:2]) == number] or [None])[0]
        if hit:
            used.add(hit)
            out[number] = hit
    return out


def test_folders_are_chosen_in_turn(spark):
    rng = random.Random(4)
    names = ["Threads", "Threads_more", "Atomics", "Ato", "Locks", "Thr", "Locks_and_keys", "…"]
    chapters, folders = [], []
    for b in range(60):
        chapters += [(b, n, rng.choice(names).replace("_", " ")) for n in rng.sample(range(1, 9), rng.randrange(1, 7))]
        folders += [(b, f"{n:02d}_{rng.choice(names)}") for n in rng.sample(range(1, 9), rng.randrange(1, 7))]
    got = organize.match_folders(spark.createDataFrame(chapters, "book int, number int, title string"), spark.createDataFrame(folders, "book int, folder string")).collect()
    for b in range(60):
        assert {r.number: r.folder for r in got if r.book == b} == in_turn([c[1:] for c in chapters if c[0] == b], [f for x, f in folders if x == b])
    none = spark.createDataFrame([], "book int, folder string")
    assert organize.match_folders(spark.createDataFrame(chapters, "book int, number int, title string"), none).count() == 0
    parts = spark.createDataFrame([("P2-03_The_end",), ("P2-00_Part",), ("x",), ("012_a",)], "f string")
    assert [tuple(r) for r in parts.select(*organize.folder_parts(F.col("f"))).collect()] == [(3, "The_end"), (None, "Part"), (None, None), (12, "a")]


def test_settled_books_leave_the_rounds(spark, monkeypatch):
    rounds = []

    def counted(df, tag):
        out = written(df, tag)
        if tag == "asked":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(organize, "written", counted)
    chapters = [(0, n, "Same title") for n in range(1, 6)] + [(b, 1, "Threads") for b in range(1, 30)]
    folders = [(0, f"{n:02d}_Same_title") for n in range(11, 16)] + [(b, "07_Threads") for b in range(1, 30)]
    got = organize.match_folders(spark.createDataFrame(chapters, "book int, number int, title string"), spark.createDataFrame(folders, "book int, folder string")).collect()
    assert {(r.book, r.number, r.folder) for r in got} == {(0, n, f"{n + 10}_Same_title") for n in range(1, 6)} | {(b, 1, "07_Threads") for b in range(1, 30)}
    assert rounds == [34, 5, 5, 5, 5]


def test_page_offset(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 5, "b"), (1, 3, 9, "c"), (2, 1, None, "a"), (2, 2, 3, "b")], "book int, number int, page int, folder string")
    pages = spark.createDataFrame([(1, "a", 11), (1, "a", 12), (1, "b", 16), (1, "c", 20), (2, "a", 4), (2, "b", 3)], "book int, folder string, page int")
    assert {(r.book, r.page_offset) for r in organize.page_offset(pairs, pages).collect()} == {(1, 11), (2, 0)}


def test_sections_are_located_in_turn(spark):
    rng = random.Random(6)
    titles = ["Spawning", "Spawning threads", "Loads", "Scoped", "Scoped Threads!"]
    sections, headings = [], []
    for c in range(80):
        sections += [(1, c, i, rng.choice(titles), rng.choice([None, rng.randrange(12)])) for i in range(rng.randrange(1, 6))]
        headings += [(1, c, i, rng.choice([None, i]), rng.choice(["", "", "2.1"]), rng.choice(titles)) for i in range(rng.randrange(0, 12))]
    got = organize.locate(spark.createDataFrame(sections, "book int, number int, place int, title string, expected int"), spark.createDataFrame(headings, "book int, number int, pos int, page int, label string, title string")).collect()
    assert len(got) == len(sections)
    for c in range(80):
        cursor, want = -1, {}
        for _, _, place, title, expected in [s for s in sections if s[1] == c]:
            t = key(title)
            fits = [h[2] for h in headings if h[1] == c and h[2] > cursor and (expected is None or h[3] is None or abs(h[3] - expected) <= 2) and any(k == t or len(t) > 6 and k.startswith(t) for k in (key(h[5]), key(h[4] + h[5])))]
            want[place] = fits[0] if fits else None
            cursor = fits[0] if fits else cursor
        assert {r.place: r.pos for r in got if r.number == c} == want


def test_numbered_sections(spark):
    rows = [(1, "a", i, n, f"t{i}") for i, n in enumerate(["1.1", "2.1", "2.2", "2.1", "2.1.1", "", "A.1", "1.2"])]
    got = organize.numbered_sections(spark.createDataFrame(rows, "book int, folder string, pos int, label string, title string")).orderBy("pos").collect()
    assert [r.label for r in got] == ["2.1", "2.2"]


def tree(spark):
    rows = [("b", name.split("/")[0], name.split("/")[1], i, text) for i, (name, text) in enumerate(PAGES.items())]
    return spark.createDataFrame([*rows, ("b", "03_Empty", "x.md", 0, ""), ("b", "03_Empty", "y.md", 1, None)], "book string, folder string, file string, place int, text string")


def test_pages_are_cut_and_join_again(spark):
    starts = [("b", "01_Threads", "b_page_0011.md", 5, 0), ("b", "01_Threads", "b_page_0012.md", 5, 1), ("b", "02_Atomics", "b_page_0015.md", 5, 0)]
    plan = spark.createDataFrame(starts, "book string, folder string, file string, line int, index int")
    got = organize.split_folders(tree(spark), plan).collect()
    assert all(r.split for r in got) and organize.broken(tree(spark), organize.cut_pages(tree(spark), plan)).count() == 0
    assert {(r.folder[:2], r.file[-5:-3], r.owner): r.text for r in got} == {
        ("01", "11", -1): "## CHAPTER 1 Threads\n\nIntro.\n\n", ("01", "11", 0): "## 1.1 Spawning\n\nSpawn.\n", ("01", "12", 0): "## Thread ID\n\nIds.\n\n", ("01", "12", 1): "## 1.2 Scoped Threads\n\nScoped.\n",
        ("01", "13", 1): "More scoped.\n", ("02", "15", -1): "## Atomics\n\nWhy.\n\n", ("02", "15", 0): "## Atomic Loads\n\nLoad.", ("03", "x", -1): "", ("03", "y", -1): "",
    }


@pytest.mark.parametrize("bad", [[(1, 1), (5, 0)], [(1, 0), (3, 1), (5, 0)]])
def test_a_broken_plan_leaves_the_old_tree(spark, bad):
    starts = [("b", "01_Threads", "b_page_0012.md", line, i) for line, i in bad] + [("b", "02_Atomics", "b_page_0015.md", 5, 0)]
    got = organize.split_folders(tree(spark), spark.createDataFrame(starts, "book string, folder string, file string, line int, index int")).collect()
    old = {r.file: r.text for r in got if r.folder == "01_Threads"}
    assert old == {n.split("/")[1]: t for n, t in PAGES.items() if n.startswith("01")} and not any(r.split for r in got if r.folder == "01_Threads")
    assert len([r for r in got if r.folder == "02_Atomics" and r.split]) == 2
