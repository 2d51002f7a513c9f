"""The reference has no streaming operator (§2.15).  The stateless column
functions (cleaning, static-vocabulary encoding) apply to a streaming DataFrame
unchanged; this helper wires one cleaning step into ``readStream`` ->
``writeStream`` with a checkpoint location that the caller names (beside the sink
if not), so that a restarted job goes on where the last one stopped.  No stateful operator, watermark or window is added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.functions.text import text_normalize


def clean_stream(stream: DataFrame, key: str, text_col: str = "text", out: str = "clean") -> DataFrame:
    return stream.select(key, text_normalize(F.col(text_col)).alias(out))


def run_parquet_stream(spark: SparkSession, src_dir: str, schema: str, key: str, sink_path: str,
                       text_col: str = "text", checkpoint: str | None = None):
    """Clean a parquet folder as a stream into a parquet sink (available-now trigger)."""
    src = spark.readStream.schema(schema).parquet(src_dir)
    ckpt = checkpoint or f"{sink_path.rstrip('/')}.checkpoint"
    q = (clean_stream(src, key, text_col).writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_path)
