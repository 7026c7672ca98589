"""Goldens for Unicode keys, labels, the stemmer, headlines, editorial state."""

import duckdb
from pyspark.sql import functions as F

from quillstack import plans
from quillstack.functions import labels as B
from quillstack.functions import text as X
from quillstack.functions import unicode as N
from quillstack.functions.stemming import stem
from quillstack.operators import catalog_filters as C
from quillstack.operators import fulltext, glossary, records, tree
from quillstack.operators.search import parse_query


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_unicode_keys(spark):
    got = spark.range(1).select(N.slugify(F.lit(" Ça ﬁn— Ⅳ! ")), N.term_key(F.lit("ＡＢ  c ")), N.letters_key(F.lit("Te-st ①")), N.slugify(F.lit(None).cast("string")), N.folder_name(F.lit(8), F.lit(120), F.lit("A  b: c?")), N.folder_name(F.lit(2), F.lit(9), F.lit("…"))).first()
    assert list(got) == ["ca-fin-iv", "ab c", "test1", None, "009_A_b_c", "03_Untitled"]


def test_labels(spark):
    got = spark.range(1).select(
        B.chapter_label_number(F.lit("Chapter-IV")), B.chapter_label_number(F.lit("नैथि खोन्दो")), B.chapter_label_number(F.lit("जिसेथि आयदा")), B.chapter_label_number(F.lit("3 pigs")), B.role(F.lit("About-the-Author")),
        B.role(F.lit("x")), B.file_title(F.lit("03_HTTPServer_inGo.md")), B.content_type(F.lit("a/.png")), F.size(B.formulas(F.lit("$5 or $10"))), B.formulas(F.lit(r"so $\\pi r^2$। and $$x$$"))[0],
    ).first()
    assert list(got)[:9] == ["4", "2", "11", None, "about_author", None, "HTTP Server in Go", "application/octet-stream", 0]
    assert [one(spark, X.trailing_page(F.lit(t))) for t in ("Part II", "Preface (xi)", "Alpha .... 12", "Chapter I", "Some 12345")] == ["", "xi", "12", "", ""]
    assert [one(spark, X.heading_number(F.lit(t))) for t in ("1.Title", "1.2.Intro", "1.2Intro", "3D x", "2 x", "2.")] == ["1", "1.2", "1.2", "", "2", ""]


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in pairs} == pairs


def test_search_over_the_index(spark):
    rows = [(1, "The runner was running fast"), (2, "He runs; nobody else"), (3, "nothing"), (4, None), (5, "fast fast cars")]
    blocks = spark.createDataFrame(rows, "id int, line string")
    i = fulltext.index(blocks, ["id"])
    n, mean = fulltext.statistics(i, ["id"])
    ids = lambda q: {r.id for r in fulltext.search(i, ["id"], parse_query(q), n, mean).collect()}
    assert n == 4 and ids("run") == {1, 2} and ids('"running fast"') == {1} and ids("run -nobody") == {1} and ids("cars or nothing") == {3, 5} and ids("the of") == set()
    assert ids('"runner was running"') == {1} and ids('"runner running"') == set() and ids('"the runner"') == {1}
    best = fulltext.search(i, ["id"], parse_query("fast"), n, mean).orderBy(F.desc("rank")).first()
    assert best.id == 5
    line = " ".join(["w"] * 40 + ["Runs", "<b>", "running!"] + ["z"] * 40)
    h = one(spark, fulltext.headline(F.lit(line), parse_query("run")))
    assert len(h.split()) == 30 and one(spark, fulltext.marked(F.lit("\u0002a\u0003 <b>"))) == "<mark>a</mark> &lt;b&gt;"
    assert h.count("\u0002") == 2 and one(spark, fulltext.plain(F.lit(h))).split()[-1] == "running!"


def test_glossary_pages(spark):
    rows = [(1, 1, "apple"), (1, 2, "सेब"), (1, 3, "pear"), (2, 1, "नाश"), (2, 2, "और"), (3, 1, "plum"), (3, 2, "fig"), (4, 1, "kiwi"), (4, 2, "फल")]
    pairs, bad = glossary.paired(spark.createDataFrame([("b", *r) for r in rows], "book string, page int, place int, text string"))
    assert {(r.term, r.meaning) for r in pairs.collect()} >= {("apple", "सेब"), ("kiwi", "फल")} and 3 in {r.page for r in bad.collect()}
    rows = [(1, 1, "apple"), (1, 2, "सेब"), (2, 1, "नाश"), (2, 2, "plum"), (3, 1, "फल"), (3, 2, "kiwi"), (3, 3, "कीवी"), (4, 1, "fig"), (5, 1, "अंजीर"), (5, 2, "date"), (6, 1, "खजूर")]
    pairs, bad = glossary.paired(spark.createDataFrame([("b", *r) for r in rows], "book string, page int, place int, text string"))
    assert {(r.term, r.meaning) for r in pairs.collect()} == {("apple", "सेब"), ("fig", "अंजीर"), ("date", "")} and {r.page for r in bad.collect()} == {2, 3, 6}
    d = glossary.dictionary(spark.createDataFrame([(1, "- **a** one"), (2, "* **a** – two"), (3, "- **a** on"), (4, "x")], "place int, line string"), [], "place")
    assert d.first().expansion == "one; two"


def test_trees_deeper_than_a_hundred(spark):
    s = spark.createDataFrame([(i, i - 1 if i else None, "b", "published", "t", i) for i in range(150)], "id long, parent_id long, book string, status string, title string, sort_order long")
    b = spark.createDataFrame([("b", "published")], "book string, status string")
    assert tree.visible_sections(s, b).count() == 150
    assert tree.breadcrumbs(s, s.where("id = 149").select("id")).count() == 150


def test_editorial_state(spark):
    users = spark.createDataFrame([(1, "a", None, 5, True), (2, "A", None, 3, True), (3, "b", "s3", 1, True), (4, None, None, 1, True), (5, "c", None, 1, False)], "id int, email string, subject string, created_at int, relink boolean")
    logins = spark.createDataFrame([("a", "new", True, 1), ("B2", "s3", True, 1), ("c", "x", True, 2), (None, "y", True, 3), ("a", "unproven", False, 0), ("a", None, True, 9)], "email string, subject string, verified boolean, at int")
    got = {r.id: (r.subject, r.email, r.relink) for r in C.relink(users, logins).collect()}
    assert got == {1: (None, "a", True), 2: ("new", "a", False), 3: ("s3", "b2", True), 4: (None, None, True), 5: (None, "c", False), 6: ("unproven", "a", False), 7: ("x", "c", False), 8: ("y", None, False)}
    sections = spark.createDataFrame([(1, "same"), (2, None)], "id int, draft_markdown string")
    drafts = spark.createDataFrame([(1, "same", 1), (2, "a", 1), (2, "b", 2), (2, None, 3), (9, "z", 1)], "id int, markdown string, saved_at int")
    now, revisions = C.save_drafts(sections, spark.createDataFrame([], "section_id int, markdown string, saved_at int"), drafts)
    assert {tuple(r) for r in now.collect()} == {(1, "same"), (2, "b")} and sorted(tuple(r)[:2] for r in revisions.collect()) == [(1, "same"), (2, "a"), (2, "b")]
    terms = spark.createDataFrame([(1, "k", "an interface"), (2, "k", "An  interface"), (3, "k", "ａn interface"), (4, "k", "other")], "o int, key string, e string")
    assert [r.verdict for r in records.first_wins(terms, "key", "e", "o").orderBy("o").collect()] == ["kept", "duplicate", "duplicate", "conflict"]
    old = spark.createDataFrame([(1, "x"), (7, "y")], "id long, name string")
    got = {(r.id, r.name) for r in C.upsert_names(old, spark.createDataFrame([("y",), ("b",), ("a",), (None,), ("a",)], "name string")).collect()}
    assert got == {(1, "x"), (7, "y"), (8, "a"), (9, "b")}
    import pytest

    with pytest.raises(LookupError):
        C.by_key(old, "name", "none")


def test_postings_are_flat_rows_handed_on_in_parts(spark):
    long = " ".join(["fish", "sea", "sky"] * 50_000)
    blocks = spark.createDataFrame([(1, "a", long), (2, "b", None), (3, "c", "fish ran and fish ran"), (4, "d", "")], "id long, k string, line string").coalesce(1)
    i = fulltext.index(blocks, ["id", "k"], stems=False)
    assert i.columns == ["id", "k", "term", "tf", "places", "length"]
    plan = i._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    rows = {(r.id, r.k, r.term): (r.tf, r.places[:2], r.length) for r in i.collect()}
    assert rows == {**{(1, "a", t): (50_000, [n, n + 3], 150_000) for n, t in enumerate(("fish", "sea", "sky"))}, (3, "c", "fish"): (2, [0, 3], 4), (3, "c", "ran"): (2, [1, 4], 4)}


def test_slugs_of_odd_titles_are_as_in_sql(spark, tmp_path):
    """Titles without letters, compatibility letters, marks of other scripts, a final sigma, Hangul."""
    titles = ["--- !", "", "x²½ ﬁn Ａ", "नमस्ते दुनिया", "ΟΔΟΣ Σ", "강각 가", "İß ẞ\nb", None, "a ", "Ⅳ ㎏"]
    spark.createDataFrame(list(enumerate(titles)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = plans.queries()["slugify_unicode"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(plans.oracle_sql()["slugify_unicode"]).select("doc_id", "slug").fetchall())
