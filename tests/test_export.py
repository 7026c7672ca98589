"""Exports and reports in reading order, and the files they are written to."""

import random

import pytest

from quillstack.operators import export
from quillstack.sources import ordered

BOOKS = "book string, title string, author string, slug string"
SECTIONS = "id long, parent_id long, book string, chapter string, sort_order long, title string, role string, numbering string, at string"
BLOCKS = "section_id long, line_no int, line string"
CHAPTERS = "book string, chapter string, role string, number string, title string"


def joined(rows):
    return "".join(r.text + "\n" for r in rows)


@pytest.fixture
def small(spark):
    books = spark.createDataFrame([("b", "Whales", "Ann", "whales"), ("e", "Empty", None, None)], BOOKS)
    sections = spark.createDataFrame(
        [(1, None, "b", "c1", 0, "Sea", "section", "1", "a.md:1"), (2, 1, "b", "c1", 1, "Deep", "section", "1.1", "a.md:9"), (3, 1, "b", "c1", 0, "Shore", "body", None, None),
         (4, 3, "b", "c1", 0, "Sand", "section", None, None), (5, None, "b", "c0", 7, "Before", "section", None, None), (6, 99, "b", "c1", 0, "Lost", "section", None, None)], SECTIONS)
    blocks = spark.createDataFrame([(1, 0, "Water."), (1, 2, "Salt."), (2, 0, "Dark."), (3, 0, "Dry."), (4, 0, "Ü — 水")], BLOCKS)
    return books, export.reading(sections), blocks


def test_reading_order(small):
    got = [(r.id, r.depth) for r in small[1].orderBy("place").collect()]
    assert got == [(5, 0), (1, 0), (3, 1), (4, 1), (2, 1)]  # the child of a body section stays at its depth; 6 has no root


def test_markdown_and_print(spark, small, tmp_path):
    books, sections, blocks = small
    want = "# Whales\n\nAnn\n\n## c0 — Before\n\n## c1 — Sea\n\nWater.\n\nSalt.\n\n## c1 — Shore\n\nDry.\n\n## c1 — Sand\n\nÜ — 水\n\n## c1 — Deep\n\nDark.\n\n"
    ordered.write(export.markdown(books, sections, blocks), f"{tmp_path}/md", ["book"], ["place", "line"], 40)
    parts = ordered.read(spark, f"{tmp_path}/md").orderBy("part").collect()
    assert "".join(p.text for p in parts) == want and len(parts) > 2 and {p.book for p in parts} == {"b"}
    assert [p.start for p in parts] == [sum(len(q.text.encode()) for q in parts[:i]) for i in range(len(parts))]
    assert all(p.bytes == len(p.text.encode()) for p in parts)
    chapters = export.printed(sections, blocks).where("chapter = 'c1'").orderBy("place", "line").collect()
    assert joined(chapters) == "## Sea\n\nWater.\n\nSalt.\n\n## Shore\n\nDry.\n\n## Sand\n\nÜ — 水\n\n## Deep\n\nDark.\n\n"


def test_report(spark, small):
    books, sections, blocks = small
    chapters = spark.createDataFrame([("b", "c0", "preface", None, "Preface"), ("b", "c1", "chapter", "1", "The sea")], CHAPTERS)
    found = spark.createDataFrame([("b", 1, "info", "empty", None, "nothing"), ("b", 2, "error", "lost", "a.md:3", "no root"), ("b", 3, "error", "twice", None, None)], "book string, place int, severity string, code string, at string, message string")
    code = spark.createDataFrame([("b", 1, "c1.code1", "JS", "javascript", "ok", "a.md:4", "a | b\nc")], "book string, place int, code_id string, language string, normalized string, status string, at string, facts string")
    terms = spark.createDataFrame([("b", 1, "API", "an interface", "a door; a wall", "a.md:5"), ("b", 2, "CPU", "a chip", None, None)], "book string, place int, term string, expansion string, others string, at string")
    rows = export.report(books, chapters, sections, blocks, found, code, terms).orderBy("phase", "place", "line").collect()
    assert joined(r for r in rows if r.book == "b") == """# Whales

- **Slug:** `whales`
- **Author:** Ann
- **Parsed:** 2 chapters, 5 sections, 5 content blocks, 1 code blocks, 2 glossary terms, 0 symbols

## Contents

- **Preface** (preface) — starts ?, 0 blocks
  - Before — 0 blocks
- **Chapter 1: The sea** (chapter) — starts a.md:1, 5 blocks
  - 1 Sea — 2 blocks
    - Sand — 1 blocks
    - 1.1 Deep — 1 blocks

## Diagnostics

2 errors, 0 warnings, 1 info.

- **error** `lost` (a.md:3): no root
- **error** `twice`: 
- **info** `empty`: nothing

## Code blocks

| Id | Language | Analysis | Where | Facts |
|---|---|---|---|---|
| c1.code1 | JS → javascript | ok | a.md:4 | a \\| b c |

## Glossary

- **API** — an interface *(also defined as: a door; a wall)* (a.md:5)
- **CPU** — a chip ()

## Symbols

None.

---

# Book

## Preface

<!-- c0 · preface · ? -->

### Before

## Chapter 1: The sea

<!-- c1 · chapter · a.md:1 -->

### 1 Sea

Water.

Salt.

Dry.

#### Sand

Ü — 水

#### 1.1 Deep

Dark.

"""
    empty = joined(r for r in rows if r.book == "e")
    assert empty.startswith("# Empty\n\n- **Parsed:** 0 chapters") and empty.count("None.") == 4 and "No chapters." in empty


def test_files_of_many_groups(spark, tmp_path):
    """Nulls and values that look alike are groups of their own; a third of all pieces in one, a piece over the part's size, empty texts, line ends of other systems."""
    rng = random.Random(5)
    groups = [None, "", "A b", "a-b", "hot", "hot", "hot", "2024-01-01"]
    rows = [(rng.choice(groups), i, rng.choice([None, "", "x\r\ny", "\n", "é" * 30, "z" * 500, "w"]), i) for i in range(900)]
    pieces = spark.createDataFrame(rows, "g string, n long, text string, start_line int").repartition(7)
    ordered.write(pieces, f"{tmp_path}/x", ["g"], ["n"], 256)
    got = {}
    for p in ordered.read(spark, f"{tmp_path}/x").orderBy("part").collect():
        got[p.g] = got.get(p.g, "") + p.text
        assert p.bytes == len(p.text.encode()) < 256 + 501
    assert got == {g: "".join((t or "") + "\n" for h, _, t, _ in rows if h == g) for g in set(groups)}
    ordered.write(pieces.limit(0), f"{tmp_path}/none", ["g"], ["n"])
    assert ordered.read(spark, f"{tmp_path}/none").count() == 0


def test_failed_writer_leaves_no_manifest(spark, tmp_path):
    bad = spark.createDataFrame([("a", 1, "x")], "g string, n long, text string").selectExpr("g", "n", "raise_error('lost') text")
    with pytest.raises(Exception, match="lost"):
        ordered.write(bad, f"{tmp_path}/bad", ["g"], ["n"])
    with pytest.raises(Exception, match="(?i)path"):
        ordered.read(spark, f"{tmp_path}/bad")


def test_texts_move_once_to_their_places(spark, small, tmp_path):
    """Reading moves no text; a part that is missing, in a group whose name is empty, too, has a null; placing joins by one number."""
    import shutil

    rows = [(g, i, f"{g}{i}") for g in ("", "b", None) for i in range(9)]
    pieces = spark.createDataFrame(rows, "book string, line long, text string")
    manifest = ordered.write(pieces, f"{tmp_path}/x", ["book"], ["line"], 9)
    lost = manifest.where("book = '' and part = 1").first()
    shutil.rmtree(f"{tmp_path}/x/parts/folder={lost.folder}/part=1")
    back = ordered.read(spark, f"{tmp_path}/x")
    got = {(r.book, r.part): r.text for r in back.collect()}
    assert len(got) == manifest.count() == back.count() and [k for k, v in got.items() if v is None] == [("", 1)]
    assert "".join(v for (b, _), v in sorted(got.items(), key=lambda x: x[0][1]) if b == "b") == "".join(f"b{i}\n" for i in range(9))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [folder#" not in "\n".join(x for x in plan.split("\n") if "text" in x)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ordered.read(spark, f"{tmp_path}/x")._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange hashpartitioning" in up and "text#" in down for up, down in zip(plan.split("\n"), plan.split("\n")[1:]))
        placed = ordered.placed(pieces, ["book"], ["line"], 9)
        joins = [x for x in placed._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
        assert any("[_id#" in x for x in joins) and not any("line#" in x for x in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_told_pieces_are_the_same_text(spark, tmp_path):
    """Blank lines, none at all, no text, line ends of other systems, runs over many parts: told pieces lie where whole ones do."""
    rng = random.Random(7)
    bits = ["", " ", "x", "é" * 9, "one\r", "\t", "|a|", "水 " * 5]
    texts = [(i, rng.choice([None, "\n".join(rng.choice(bits) for _ in range(rng.randrange(40)))])) for i in range(120)]
    sections = [(i, rng.choice(["b", "B", ""]), "c", i + 1) for i, _ in texts if i % 11]
    s = spark.createDataFrame(sections, "id long, book string, chapter string, place long")
    books = spark.createDataFrame([(b, b, None) for b in ("b", "B", "", "none")], "book string, title string, author string")
    whole = spark.createDataFrame(texts, "ref long, text string").repartition(5)
    blocks = spark.createDataFrame([(i, n, x) for i, t in texts if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" ")], "section_id long, line_no int, line string")
    titled = s.join(whole.selectExpr("ref id", "substring_index(text, '\n', 1) title"), "id")
    pieces = export.markdown(books, titled, blocks)
    want = sorted(tuple(r) for r in ordered.placed(pieces, ["book"], ["place", "line"], 50).select("book", "place", "line", "start", "text").collect())
    sizes = ordered.measured(whole)
    told = export.markdown_told(books, s, sizes)
    filled = ordered.filled(ordered.started(told, ["book"], ["place", "line"]), whole, sizes)
    assert sorted(tuple(r) for r in filled.select("book", "place", "line", "start", "text").collect()) == want
    lines = {i: [x for x in (t or "").split("\n") if x.strip(" ")] for i, t in texts}
    assert all([r[4] for r in want if r[:2] == (b, p) and r[2] >= 0] == [x + "\n" for x in lines[i]] for i, b, _, p in sections)

    def files(manifest, path):
        assert manifest.count() > 20
        return sorted(tuple(r) for r in ordered.read(spark, path).select("book", "folder", "part", "start", "bytes", "pieces", "text").collect())

    a = files(ordered.write(pieces, f"{tmp_path}/a", ["book"], ["place", "line"], 50), f"{tmp_path}/a")
    assert files(ordered.write_told(told, whole, sizes, f"{tmp_path}/b", ["book"], ["place", "line"], 50), f"{tmp_path}/b") == a
    assert all(len(r[6].encode()) == r[4] for r in a)


@pytest.mark.parametrize("name", ["report_pieces", "export_pieces"])
def test_texts_are_shuffled_once_and_not_written(spark, name):
    """The documents' texts go from their files through one shuffle, without a sort or a table of their own."""
    from quillstack import plans

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    seen, nodes = [plan], []
    while seen:
        node = seen.pop()
        nodes.append(node)
        seen += [node.initialPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
    texts = [n for n in nodes if "text" in [n.output().apply(i).name() for i in range(n.output().size())]]
    names = [n.nodeName() for n in texts]
    assert names.count("Exchange") == 1 and "Sort" not in names
    scans = [n.toString() for n in texts if n.nodeName().startswith("Scan")]
    assert len(scans) == 1 and "documents.parquet" in scans[0]


def test_sums_begin_anew_in_each_group(spark):
    from quillstack.operators import ranking

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c" * rng.randrange(9)]), i, rng.randrange(5)) for i in range(700)]
    got = ranking.running(spark.createDataFrame(rows, "g string, n long, v long").repartition(6), ["g", "n"], "v", "s", ["g"]).collect()
    want = {(g, n): sum(v for h, m, v in rows if h == g and m < n) for g, n, _ in rows}
    assert {(r.g, r.n): r.s for r in got} == want and len(got) == len(rows)
