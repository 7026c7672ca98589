"""Versions of a library's tables: load, reset, reload; a writer that fails between two tables leaves the old version."""

import pytest
from pyspark.sql import functions as F

from quillstack.sources import versions

NAMES = ("books", "parts", "chapters", "sections", "blocks", "terms", "images", "reports")


def tables(spark, books, mark):
    return {n: spark.createDataFrame([(b, f"{mark}-{n}", i) for b in books for i in range(3)], "book string, text string, n int") for n in NAMES}


def seen(spark, root):
    return {n: sorted((r.book, r.text) for r in versions.read(spark, root, n).select("book", "text").distinct().collect()) for n in versions.manifest(spark, root)}


def test_load_reset_reload(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert versions.manifest(spark, root) == {}
    versions.load(spark, root, tables(spark, ["a"], "one"))
    versions.load(spark, root, tables(spark, ["b"], "two"))
    assert seen(spark, root)["blocks"] == [("a", "one-blocks"), ("b", "two-blocks")]
    before = versions.manifest(spark, root)
    with pytest.raises(ValueError, match="a is loaded"):
        versions.load(spark, root, {"terms": tables(spark, ["a"], "again")["terms"]})
    assert versions.manifest(spark, root) == before
    new = tables(spark, ["a"], "three")
    versions.reload(spark, root, {n: new[n] for n in NAMES[:-1]})
    got = seen(spark, root)
    assert got["blocks"] == [("a", "three-blocks"), ("b", "two-blocks")] and got["reports"] == [("b", "two-reports")]
    held = versions.read(spark, root, "books")
    versions.load(spark, root, {"books": tables(spark, ["c"], "four")["books"]})
    assert held.count() == 6 and versions.read(spark, root, "books").count() == 9
    assert versions.manifest(spark, root)["blocks"] == {**versions.manifest(spark, root)}["blocks"] and {r["table"]: r["rows"] for r in versions.counts(spark, root).collect()}["blocks"] == 6
    versions.clean(spark, root)
    assert versions.read(spark, root, "books").count() == 9
    versions.reset(spark, root, {"books": tables(spark, ["z"], "five")["books"]})
    assert seen(spark, root) == {"books": [("z", "five-books")]}


def test_a_writer_killed_between_two_tables_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}"
    versions.load(spark, root, tables(spark, ["a"], "one"))
    before, rows = versions.manifest(spark, root), seen(spark, root)
    for mode in (versions.load, versions.reload, versions.reset):
        bad = tables(spark, ["b"], "two")
        bad[NAMES[4]] = bad[NAMES[4]].withColumn("n", F.when(F.col("n") < 2, F.col("n")).otherwise(F.raise_error(F.lit("killed")).cast("int")))
        with pytest.raises(Exception, match="killed"):
            mode(spark, root, bad)
        assert versions.manifest(spark, root) == before and seen(spark, root) == rows
    versions.clean(spark, root)
    assert seen(spark, root) == rows


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}"
    versions.load(spark, root, tables(spark, ["a"], "one"))
    old = versions.manifest(spark, root)
    versions.load(spark, root, tables(spark, ["b"], "two"))
    with pytest.raises(RuntimeError, match="another writer"):
        versions.switch(spark, root, old, {"books": "nowhere"})
    assert seen(spark, root)["books"] == [("a", "one-books"), ("b", "two-books")]
