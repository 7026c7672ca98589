"""What keeps a query's work in proportion to its tables."""

from pyspark.sql import functions as F

from quillstack import plans
from quillstack.operators import catalog, ranking

SF = "/root/testdata/sf0.001"


def test_author_lists_are_made_once_a_group(spark):
    books = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "y"), (3, "a", 1, "z"), (4, None, 0, "n")], "book_id int, kind string, third int, author string")
    authors = spark.createDataFrame([("a", 0, "q"), ("a", 0, "p"), ("b", 1, "r"), (None, 0, "s")], "kind string, third int, name string")
    got = {r.book_id: r.author for r in catalog.shared_author_lists(books, authors, ["kind", "third"]).collect()}
    assert got == {1: "p, q", 2: "p, q", 3: "z", 4: "n"}
    plan = plans.queries()["discover"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list" in line and "Aggregate [" in line]
    assert len(lists) == 1 and "book_id" not in lists[0] and "category_id" in lists[0]


def test_books_of_a_list_come_together(spark, tmp_path):
    """A list that is longer than a dictionary's share is written once a partition that has it, not once a book."""
    books = spark.range(3000).select(F.col("id").alias("book_id"), (F.col("id") % 40).cast("string").alias("kind"), F.lit("x").alias("author"))
    authors = spark.range(40 * 300).select((F.col("id") % 40).cast("string").alias("kind"), F.sha2(F.col("id").cast("string"), 512).alias("name"))
    full = catalog.shared_author_lists(books, authors, ["kind"])
    full.write.parquet(f"{tmp_path}/full")
    got = spark.read.parquet(f"{tmp_path}/full").agg(F.count("*").alias("n"), F.sum(F.length("author")).alias("bytes")).first()
    assert got.n == 3000 and got.bytes == 3000 * (300 * 128 + 299 * 2)
    assert sum(f.stat().st_size for f in (tmp_path / "full").iterdir()) < 6 << 20


def test_written_tables_let_go_of_their_shuffles(spark, monkeypatch):
    """After a table is written, the shuffle files behind it go, and joins with it don't trust its compressed size."""
    small = ranking.written(spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit("x" * 50).alias("name")).distinct(), "small")
    plan = spark.range(1000).withColumn("k", F.col("id") % 3).join(small, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
    bound = spark.range(1000).withColumn("k", F.col("id") % 3).join(F.broadcast(small), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in bound
    calls = []
    monkeypatch.setattr(ranking, "free_shuffles", calls.append)
    ranking.written(spark.range(3), "three")
    assert calls == [spark]


def test_walks_carry_no_titles(spark):
    plan = plans.queries()["breadcrumbs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    walk = [line for line in plan.splitlines() if "array_append" in line]
    assert walk and not any("title" in line for line in walk)


def test_postings_move_texts_once(spark):
    plan = plans.queries()["postings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "term" in line]
    assert not dealt
