"""§2.1 scans and sinks: CSV (with encoding fallback), header-less CSV, nested
JSON lines, text lines with a stable line number, split datasets; CSV / text /
JSON / parquet writers.

Scratch output goes under the session's reliable checkpoint folder (a shared
folder on a cluster), never a machine-local temp directory.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.functions.text import PAT, java
from textprep.operators.relational import checked_broadcast
from textprep.session import ensure_checkpoint_dir

CSV_OPTS = {"header": "true", "quote": '"', "escape": '"'}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder once its last reader is done."""
    if not path.startswith(f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/"):
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- scans ---------------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """``multi_line`` is for fields with line breaks; such a file cannot be split."""
    r = (spark.read.options(**CSV_OPTS).option("header", str(header).lower()).option("encoding", encoding)
         .option("multiLine", str(multi_line).lower()))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", "true")
    return r.csv(path)


def read_csv_fallback(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"), text_cols: Sequence[str] | None = None,
                      multi_line: bool = False) -> DataFrame:
    """Try encodings in order; an encoding fails when a decoded string column
    contains U+FFFD (one aggregate per attempt).  Latin-1 never fails, so it is the
    natural last entry."""
    df = None
    for enc in encodings:
        df = read_csv(spark, path, schema, True, enc, multi_line)
        cols = text_cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not cols:
            return df
        bad = F.max(F.greatest(*[F.coalesce(F.instr(F.col(c), "�"), F.lit(0)) for c in cols] + [F.lit(0)]))
        if (df.agg(bad.alias("b")).first()["b"] or 0) == 0:
            return df
    return df


def read_csv_positional(spark: SparkSession, path: str, index: int, encoding: str = "ISO-8859-1",
                        schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Header-less CSV; keep the column at 0-based ``index`` (Spark names it ``_c<index>``)."""
    df = read_csv(spark, path, schema, False, encoding, multi_line)
    return df.select(df.columns[index])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_text_lines(spark: SparkSession, path: str, strip: bool = True, drop_blank: bool = True,
                    underscore_to_space: bool = False) -> DataFrame:
    """Lines with a stable 0-based ``line_no`` per file.

    The lines are not moved: each split's lines are counted, and a line's number is its
    place in the split plus the lines of the file's earlier splits (one row per file and
    split).  A split's place in its file is where it starts."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_scan_pos"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_scan_pos").alias("_first")).select(
        "file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = raw.join(checked_broadcast(splits), ["file", "_split"]).select(
        "file", (F.col("_scan_pos") - F.col("_first") + F.col("_before")).cast("bigint").alias("line_no"), "line")
    if strip:
        out = out.withColumn("line", F.regexp_replace("line", F.lit(java(PAT["strip"])), F.lit("")))
    if underscore_to_space:
        out = out.withColumn("line", F.translate("line", "_", " "))
    if drop_blank:
        out = out.where(F.col("line") != "")
    return out


def read_split_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A directory partitioned by ``split=``; a split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


# --- sinks -----------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", header: bool = True) -> None:
    """Arrays / structs are written as JSON text (CSV has no nested types)."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f.name) for f in df.schema.fields]
    (df.select(*cols).write.mode("overwrite").options(**CSV_OPTS).option("header", str(header).lower())
     .option("encoding", encoding).csv(path))


def write_text_corpus(df: DataFrame, col: str, path: str) -> None:
    df.select(F.coalesce(F.col(col), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_mapping_json(tables: Mapping[str, DataFrame], path: str) -> None:
    """Code tables ``(value, id)`` as JSON lines ``{name, value, id}`` (non-ASCII kept)."""
    parts = [t.select(F.lit(name).alias("name"), F.col("value").cast("string").alias("value"), F.col("id").cast("int").alias("id"))
             for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, gzipped: nested rows repeat every field name, which would be most of the bytes."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_vocab(vocab: DataFrame, path: str, merges: DataFrame | None = None) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if merges is not None:
        merges.write.mode("overwrite").parquet(f"{path}/merges")
