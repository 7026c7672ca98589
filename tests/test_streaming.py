import shutil

from quillstack.streaming.positions import latest_positions

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in/events.parquet")
    stream = latest_positions(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("positions").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(str, spark.sql("select * from positions").collect()))
    assert got == sorted(map(str, latest_positions(batch).collect())) and got
