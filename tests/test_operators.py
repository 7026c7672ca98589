"""Edges that the driver's tables don't show."""

from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import records, search, tree


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_query_parser():
    q = search.parse_query('one or two "of the" -not -"so on" or three')
    assert q.groups == [[["one"], ["two"]], [["of", "the"], ["three"]]] and q.excluded == [["not"], ["so", "on"]]
    assert search.parse_query("  ").groups == [] and search.parse_query("x" * 300).groups == [[["x" * 200]]]


def test_nothing_matches_an_empty_query(spark):
    blocks = spark.createDataFrame([(1, 0, "a b")], "section_id long, line_no int, line string")
    assert search.best_blocks(blocks, search.parse_query("")).count() == 0


def test_reorder_refuses_incomplete_lists(spark):
    s = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 20), (5, None), (6, None)], "id long, parent_id long")
    wanted = spark.createDataFrame([(10, [2, 1]), (20, [4]), (None, [6, 5])], "parent_id long, ids array<long>")
    got = {(r.parent_id, r.id, r.sort_order) for r in tree.reorder(s, wanted).collect()}
    assert got == {(10, 2, 0), (10, 1, 1), (None, 6, 0), (None, 5, 1)}
    twice = spark.createDataFrame([(10, [2, 1, 1])], "parent_id long, ids array<long>")
    assert tree.reorder(s.where("parent_id = 10"), twice).count() == 0


def test_visibility_of_hidden_ancestors(spark):
    s = spark.createDataFrame([(1, None, "b", "draft"), (2, 1, "b", "published"), (3, None, "b", "published"), (4, 3, "c", "published")], "id long, parent_id long, book string, status string")
    b = spark.createDataFrame([("b", "published"), ("c", "draft")], "book string, status string")
    assert [r.id for r in tree.visible_sections(s, b).collect()] == [3]
    assert tree.visible_sections(s, b, editor=True).count() == 4
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    assert {r.id for r in tree.is_visible(s, b, asked).where("visible").collect()} == {3}


def test_scalar_functions(spark):
    assert one(spark, X.slugify(F.lit("  -- "))) == "untitled"
    assert one(spark, X.roman_to_int(F.lit("MCMXciv"))) == 1994 and one(spark, X.roman_to_int(F.lit("abc"))) is None
    assert one(spark, X.fence(F.lit("a ```` b"))) == "`" * 5 and one(spark, X.fence(F.lit("a"))) == "```"
    assert one(spark, X.heading_number(F.lit("1.2.3Intro"))) == "1.2.3" and one(spark, X.heading_number(F.lit("3D graphics"))) == ""
    assert one(spark, X.natural_key(F.lit("p10"))) > one(spark, X.natural_key(F.lit("p9")))
    assert one(spark, F.crc32(F.lit("123456789").cast("binary"))) == 0xCBF43926
    assert one(spark, X.page_number(F.lit("book_page_0012.md"), F.lit(3))) == 12 and one(spark, X.page_number(F.lit("x.md"), F.lit(3))) == 3


def test_upsert_keeps_the_rest(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 9, "b")], "k long, t long, v string")
    delta = spark.createDataFrame([(2, 3, "c"), (2, 4, "d"), (3, 1, "e")], "k long, t long, v string")
    got = {tuple(r) for r in records.upsert_latest(base, delta, ["k"], ["t"]).collect()}
    assert got == {(1, 5, "a"), (2, 4, "d"), (3, 1, "e")}
