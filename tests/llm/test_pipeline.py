import __spark_entry__
import corpus_pipeline
from quillstack.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_end_in_pieces(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns
            rows = [r.doc_id for r in out.collect()]
            assert set(rows) <= ids and (k == 3 or len(rows) == len(set(rows)))
            ids = set(rows)
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids
        docs = out
    total = lambda df: df.agg({"length": "sum"}).first()[0]
    assert total(corpus_pipeline.run(spark, SF)) == total(docs)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in __spark_entry__.queries() and set(queries.oracle_sql()) <= set(queries.queries())
