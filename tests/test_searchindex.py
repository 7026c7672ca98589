"""The kept index: any script, phrases, exclusions, deltas and merges, against the words told in Python; and what a query reads."""

import unicodedata

import pytest
import regex

from quillstack.operators import searchindex as index

SECTIONS = "id long, book string, title string, role string, text string"
FIRST = [
    (1, "a", "École", "body", "École über दाब्ले naïve\n\nthe cat and the dog and the end"), (2, "a", "Two", "toc", "The cat sat\nof the cat"), (3, "b", "the and", "body", "nothing here"),
    (4, "b", "Fish", "index", "ﬁsh of\nthe sea"), (5, "a", None, "body", None), (6, "b", "Empty", "body", ""),
]
QUERIES = ["the", "दाब्ले", "école über", '"of the"', '"the cat" -sat', "fish or dog", "cat -dog", '"the dog and the"', "", "-the", "the the", "école"]


def told(rows, text):
    q, out = index.asked(text), {}
    wanted = {w for g in q.groups for p in g for w in p}
    for id_, book, _, _, body in rows:
        for n, line in enumerate((body or "").split("\n")):
            words = regex.findall(index.WORD, unicodedata.normalize("NFKC", line).lower())
            has = lambda p: any(words[i : i + len(p)] == p for i in range(len(words)))  # noqa: E731,B023
            if q.groups and all(any(map(has, g)) for g in q.groups) and not any(map(has, q.excluded)):
                out[book, id_, n] = sum(w in wanted for w in words)
    return out


def got(spark, root, text, book=None):
    return {(r.book, r.section_id, r.line_no): r["rank"] for r in index.hits(spark, root, index.asked(text), book).collect()}


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.build(spark, path, spark.createDataFrame(FIRST, SECTIONS))
    return path


def test_hits_deltas_and_merges(spark, root):
    for text in QUERIES:
        assert got(spark, root, text) == told(FIRST, text), text
    assert got(spark, root, "the", "a") == {k: v for k, v in told(FIRST, "the").items() if k[0] == "a"}
    index.update(spark, root, spark.createDataFrame([(2, "a", "Two", "body", "the new cat"), (7, "c", "Seven", "body", "the sea of the cat")], SECTIONS), spark.createDataFrame([(4,)], "id long"))
    now = [r for r in FIRST if r[0] not in (2, 4)] + [(2, "a", "Two", "body", "the new cat"), (7, "c", "Seven", "body", "the sea of the cat")]
    index.update(spark, root, spark.createDataFrame([(4, "b", "Fish", "index", "the fish is back")], SECTIONS))
    now.append((4, "b", "Fish", "index", "the fish is back"))
    for text in ("the", '"of the"', "fish or dog"):
        assert got(spark, root, text) == told(now, text), text
    before = {n: sorted(map(str, index.table(spark, root, n).collect())) for n in ("heads", "lines", "words")}
    index.merge(spark, root)
    assert {n: sorted(map(str, index.table(spark, root, n).collect())) for n in before} == before
    assert sorted(r.id for r in index.table(spark, root, "heads").collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_a_failed_writer_leaves_the_index(spark, root):
    bad = spark.createDataFrame([(1, "a", "x", "body", "gone")], SECTIONS).selectExpr("id", "book", "title", "role", "if(id = 1, raise_error('broken'), text) AS text")
    with pytest.raises(Exception, match="broken"):
        index.update(spark, root, bad)
    assert got(spark, root, "the") == told(FIRST, "the")


def test_ranked_sections(spark, root):
    heads = index.table(spark, root, "heads")
    rows = [tuple(r) for r in index.search_library(spark, root, heads, "the and").collect()]
    assert rows == [(1, "École", "a", 5.0, "the cat and the dog and the end"), (3, "the and", "b", 1.0, None)]
    assert [tuple(r) for r in index.search_book(spark, root, heads, "a", "cat").collect()] == [(1, "École", 1.0, 2), (2, "Two", 0.1, 0)]
    assert index.search_library(spark, root, heads.where("false"), "the").count() == 0


def test_a_query_asks_the_scan_for_its_words(spark, root):
    plan = index.hits(spark, root, index.asked("cat -dog"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word, [cat,dog]), IsNotNull(book), EqualTo(book,a)]" in plan or ("In(word, [cat,dog])" in plan and "EqualTo(book,a)" in plan)
    assert "Python" not in plan


def test_words_are_sorted_where_their_lines_lie(spark, root, monkeypatch):
    monkeypatch.setattr(index, "RUN_BYTES", 16, raising=False)
    path = f"{root}-small"
    index.build(spark, path, spark.createDataFrame(FIRST, SECTIONS))
    rows = index.table(spark, path, "words").selectExpr("word", "input_file_name() AS f").collect()
    assert len({r.f for r in rows if r.word == "the"}) > 1
    for f in {r.f for r in rows}:
        assert [r.word for r in rows if r.f == f] == sorted(r.word for r in rows if r.f == f)
    for text in QUERIES:
        assert got(spark, path, text) == told(FIRST, text), text
