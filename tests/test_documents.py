"""Goldens for Markdown structure, contents entries and listings."""

import itertools
import random

from pyspark.sql import functions as F

from quillstack.operators import contents, markdown, structure, unmangle

PAGE = """# Title

First line
goes on.

- item
  more of it
- item two

```python
# not a heading

x = 1
```
> quote
> goes on
| a | b |
|---|---|
![alt](x.png)
---
API → Application Interface
A → b → c
<div>
[^1]: note
[ref]: http://x"""


def test_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "```\nopen\n# still code")], "page_id long, source string")
    rows = markdown.blocks(pages).orderBy("page_id", "sort_order").collect()
    assert [r.block_type for r in rows if r.page_id == 1] == ["heading", "paragraph", "list", "code", "blockquote", "table", "image", "thematic_break", "paragraph", "html", "footnote", "definition"]
    assert [r.sort_order for r in rows if r.page_id == 1] == list(range(12))
    code = [r for r in rows if r.block_type == "code"]
    assert code[0].lang == "python" and code[0].markdown.count("\n") == 4 and rows[0].level == 1
    assert [r.page_id for r in rows if r.page_id != 1] == [4]
    found = markdown.code_blocks(markdown.blocks(pages)).orderBy("page_id").collect()
    assert [(r.closed, r.lead_in) for r in found] == [(True, None), (False, None)]


def test_lines_by_the_rules():
    kinds = lambda text: [k for k, _ in markdown.line_kinds(text.split("\n"))]
    assert kinds("```\n~~~\n```\n# H\ntext") == ["code", "code", "code", "heading", "paragraph"]
    assert kinds("````md\n```\nx\n```\n````\nafter") == ["code"] * 5 + ["paragraph"]
    assert kinds("- a\n  b\n  c\nlazy\n\n  more\n\nout") == ["list"] * 4 + ["blank", "list", "blank", "paragraph"]
    assert kinds("Title\n=====\nSub\nof it\n---\nx") == ["heading"] * 5 + ["paragraph"]
    assert kinds("    code\n\n    more\n\ntext\n    not code") == ["code", "blank", "code", "blank", "paragraph", "paragraph"]
    assert kinds("a | b\n--|--\n1 | 2\n\na | b\nno table") == ["table"] * 3 + ["blank", "paragraph", "paragraph"]
    assert kinds("> q\nlazy\n\n---\n*a*") == ["blockquote", "blockquote", "blank", "thematic_break", "paragraph"]


def test_headings_and_indented_code_as_blocks(spark):
    source = "Title\nof two\n======\n\n    a\n\n    b\ntext\n\nSub\n---"
    rows = markdown.blocks(spark.createDataFrame([(1, source)], "page_id long, source string")).orderBy("sort_order").collect()
    assert [(r.block_type, r.level, r.markdown.count("\n")) for r in rows] == [("heading", 1, 2), ("code", None, 2), ("paragraph", None, 0), ("heading", 2, 1)]


def test_every_line_has_one_owner(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, source string")
    text = markdown.to_markdown(markdown.blocks(pages)).first().source
    keep = lambda s: [x for x in s.split("\n") if x.strip()]
    assert keep(text) == keep(PAGE)
    again = markdown.blocks(spark.createDataFrame([(1, text)], "page_id long, source string")).orderBy("sort_order")
    assert [r.block_type for r in again.collect()] == [r.block_type for r in markdown.blocks(pages).orderBy("sort_order").collect()]


def test_terms(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, source string")
    rows = markdown.terms(markdown.blocks(pages)).collect()
    assert {(r.term, r.expansion, r.valid) for r in rows} == {("API", "Application Interface", True), ("A", "b", False)}


def test_contents_entries(spark):
    lines = ["- **Chapter 3** The End ..... 41", "IV. Fourth thing . . . xii", "Part II Later", "Appendix A: More 200", "Preface … ix", "**Preface** (xi)", "2.1 Sub 7", "Just words", "Civil war", "Part II", "3 Title 12", "62 1.7.1 Title 9"]
    rows = contents.entries(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")).orderBy("i").collect()
    want = [("chapter", "3", "41"), (None, None, "xii"), ("part", "II", None), ("appendix", "A", "200"), (None, None, "ix"), ("matter", None, "xi"), (None, None, "7"), (None, None, None), (None, None, None), ("part", "II", None), ("chapter", "3", "12"), (None, None, "9")]
    assert [(r.kind, r.number, r.page) for r in rows] == want
    assert rows[0].title == "The End" and rows[5].title == "Preface"


def test_read_contents(spark):
    a = [(1, "# Some book"), (2, "## Contents"), (2, "**Preface** ix"), (2, "Part One: Begin 1"), (2, "1 First 3"), (2, "1.1 Sub 4"), (2, "Chapter II: Second .... 20"), (3, "2 again 30"), (3, "3 Third 40"), (3, "**A Extra** 50"), (3, "**Index** 60"), (4, "No page"), (5, "4 Far 70")]
    b = [(1, "# Chapters"), (1, "* Large models"), (1, "* Preface"), (1, "* Attention"), (1, "* Appendix A. Torch"), (2, "Text 12 x")]
    rows = [("a", p, i, t) for i, (p, t) in enumerate(a)] + [("b", p, i, t) for i, (p, t) in enumerate(b)] + [("c", 1, 0, "# Nothing")]
    df = spark.createDataFrame(rows, "book string, page int, line_no int, line string")
    got = contents.read_contents(df).orderBy("book", "place").collect()
    assert [(r.kind, r.number, r.title, r.page) for r in got if r.book == "a"] == [("matter", None, "Preface", "ix"), ("part", "One", "Begin", "1"), ("chapter", "1", "First", "3"), ("chapter", "2", "Second", "20"), ("chapter", "3", "Third", "40"), ("appendix", "A", "Extra", "50"), ("matter", None, "Index", "60")]
    assert [(r.kind, r.number, r.title) for r in got if r.book == "b"] == [("chapter", "1", "Large models"), ("matter", None, "Preface"), ("chapter", "2", "Attention"), ("appendix", "A", "Torch")]
    heads = spark.createDataFrame([("a", 0, "Chapter 2"), ("a", 1, "THIRD!"), ("a", 2, "3. Third"), ("b", 3, "Third")], "book string, place int, title string")
    assert {(r.book, r.entry, r.heading) for r in contents.exact_pairs(contents.read_contents(df), heads).collect()} == {("a", 4, 0), ("a", 5, 1), ("a", 5, 2)}
    items = spark.createDataFrame([(1, i, k) for i, k in enumerate(["heading", "heading", "heading", "p", "heading"])], "element int, place int, kind string")
    assert [r.kind for r in contents.element_body(items).orderBy("place").collect()] == ["subheading", "p", "subheading"]


def test_match_strength(spark):
    got = spark.range(1).select(*[contents.match_strength(F.lit(a), F.lit(b)) for a, b in (("The End!", "the  end"), ("Getting", "Getting started"), ("The", "The end"), ("", ""))]).first()
    assert tuple(got) == (2, 1, 0, 0)


def test_anchor_chain_is_longest(spark):
    rng = random.Random(3)
    pairs = [(b, rng.randrange(8), rng.randrange(8)) for b in range(6) for _ in range(9)]
    got = contents.anchor_chain(spark.createDataFrame(pairs, "book long, entry long, heading long")).collect()
    for b in range(6):
        mine = sorted({(e, h) for x, e, h in pairs if x == b})
        best = max(n for n in range(1, 9) for c in itertools.combinations(mine, n) if all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(c)))
        chain = sorted((r.entry, r.heading) for r in got if r.book == b)
        assert len(chain) == best and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(chain))


def test_listings(spark):
    rows = [
        (0, 'public class A { int f() { return 1; } String s = "a;b{"; }'),
        (1, "for (int i = 0; i < 3; i++) { let x = 1; }"),
        (2, "some prose; nothing else"),
        (3, "const a = 1;\nconst b = 2;"),
        (4, ">>> let x = 2"),
        (5, None),
        (6, ""),
    ]
    got = unmangle.unmangle(spark.createDataFrame(rows, "id int, code string")).orderBy("id").collect()
    assert got[0].result == 'public class A {\n    int f() {\n        return 1;\n    }\n    String s = "a;b{";\n}'
    assert got[1].result == "for (int i = 0; i < 3; i++) {\n    let x = 1;\n}"
    assert [r.skipped for r in got[2:5]] == ["no known language", "not flattened", "program output"]
    assert all(r.result == r.code for r in got if r.skipped)
    stable = unmangle.unmangle(spark.createDataFrame([(r.id, r.result) for r in got], "id int, code string")).orderBy("id").collect()
    assert [r.result for r in stable] == [r.result for r in got]


def test_running_number(spark):
    rows = [(1, i, p) for i, p in enumerate([None, None, 5, None, None, 9, None])]
    got = structure.counted(spark.createDataFrame(rows, "g int, i int, p int"), ["g"], ["i"], "p").orderBy("i").collect()
    assert [r.number for r in got] == [1, 2, 5, 6, 7, 9, 10]


def test_listings_whose_meaning_a_break_would_change_stay(spark):
    odd = ["let r = /a;b/; f();", "for (let i = 0; i < f(g(x)); i++) { let a = 1; }", "let a = 1; /* t; u */ f();"]
    kept = unmangle.unmangle(spark.createDataFrame(list(enumerate(odd)), "id int, code string")).orderBy("id").collect()
    assert [r.skipped for r in kept] == ["regular expression", "deep brackets", "template or comment"] and [r.result for r in kept] == odd
    codes = ["const x = `a; b`;", "let a = 1; // note; more", 'let u = "http://x; y"; f();', "let a = 1;\r\n"]
    got = unmangle.unmangle(spark.createDataFrame(list(enumerate(codes)), "id int, code string")).orderBy("id").collect()
    assert [r.skipped for r in got[:3]] == ["template or comment", "template or comment", None]
    assert got[2].result == 'let u = "http://x; y";\nf();' and all(r.result == c for r, c in zip(got[:2], codes[:2], strict=True))
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(unmangle.without_markup(F.lit(r"**let** a\_b = \*p; _x_ snake_case_id"))) == "let a_b = *p; x snake_case_id"
    assert one(unmangle.step_language(F.lit("JSX"))) == "js" and one(unmangle.step_language(F.lit("psql"))) == "sql" and one(unmangle.step_language(F.lit("c"))) is None
    assert one(unmangle.keep_line_ends(F.lit("a\r\nb"), F.lit("x\ny"))) == "x\r\ny"
    pages = spark.createDataFrame([(1, "# h\ntext\n\n```\ncode\n```\n- a\n\n> q\n\nmore")], "page_id long, source string")
    assert [r.text for r in unmangle.paragraphs(pages).orderBy("sort_order").collect()] == ["text", "more"]


def test_code_through_analysers(spark):
    from quillstack.operators import code

    def functions(text):
        if "?" in text:
            raise ValueError("odd sign")
        return [(line.split()[1], "fn", i) for i, line in enumerate(text.split("\n"), 1) if line.startswith("fn ")]

    registry = code.Registry()
    registry.add(["rust"], functions)
    rows = [("rs", "x\nfn a\nfn b", 10, True), ("rust", "?", 1, False), ("go", "x", 1, True), (None, "x", 1, True), ("RUST", None, 1, True)]
    got = code.analyse(spark.createDataFrame(rows, "lang string, code string, start_line int, fenced boolean"), registry).collect()
    assert [(r.status, r.problem) for r in got] == [("analysed", None), ("parse_error", "odd sign"), ("unsupported", None), ("unanalysed", None), ("analysed", None)]
    assert [(f.name, f.line) for f in got[0].facts] == [("a", 12), ("b", 13)]
