from pyspark.sql import functions as F

from conftest import SF001
from textprep.functions.text import text_normalize
from textprep.sources.files import scratch_path
from textprep.streaming.clean_stream import run_parquet_stream


def test_stream_equals_batch(spark):
    src = scratch_path(spark, "stream-src")
    spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").write.parquet(src)
    out = run_parquet_stream(spark, src, "doc_id bigint, text string", "doc_id", scratch_path(spark, "stream-out"))
    batch = spark.read.parquet(src).select("doc_id", text_normalize(F.col("text")).alias("clean"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_restart_goes_on_with_new_files(spark):
    src, sink, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("restart-src", "restart-out", "restart-ckpt"))
    for n in (3, 3):  # two runs of the job, new rows before each
        spark.createDataFrame([(i, f"Text {i}") for i in range(n)], "doc_id bigint, text string").write.mode("append").parquet(src)
        out = run_parquet_stream(spark, src, "doc_id bigint, text string", "doc_id", sink, checkpoint=ckpt)
    assert out.count() == 6
