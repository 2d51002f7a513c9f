"""Readers for the parquet tables the queries run on, plus the derived fixtures.

Every fixture is a pure DataFrame expression over a given table, so its work
scales with the table and Catalyst can still prune columns / push filters into
the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.functions.rnd import seeded_uniform

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# tables whose rows carry long texts: per-row work is CPU-bound regex / array code
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores when the scan yields fewer partitions
    than the cluster has task slots (a small file is a single row group).  On large
    inputs the scan already has thousands of splits and this is a no-op."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)


# --- derived fixtures ---------------------------------------------------------

def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_type`` and ``value`` set to null where ``event_id % 7 = 0``."""
    ev = table(spark, sf_dir, "events")
    hole = (F.col("event_id") % 7) == 0
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        F.when(hole, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(hole, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        "props",
    )


def sparse_key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-per-row table: ``lineitem`` with the sentence key only on the first row
    of each order (``l_returnflag`` = tag, ``l_linestatus`` = POS).

    ``pos`` is the row position; the order is the unique four-column key, which we
    keep as separate columns so that ordering never needs a global row number.
    """
    li = table(spark, sf_dir, "lineitem")
    # first row of each order: partial (map-side) min, then an equi-join back
    firsts = li.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("_first")
    )
    is_first = F.struct("l_linenumber", "l_partkey", "l_suppkey") == F.col("_first")
    return li.join(firsts, "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(is_first, F.concat(F.lit("Sentence: "), F.col("l_orderkey").cast("string"))).alias("sentence"),
        F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"),
        F.col("l_linestatus").alias("pos_tag"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_returnflag")).alias("tag"),  # some tags are missing
    )


def age_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 9).cast("string")).alias("age"),
    )


def parallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ``user`` turn joined to the next turn of the same conversation when that
    turn is ``assistant``: (conv_id, turn, src, tgt).  An equi-join on
    ``(conv_id, turn + 1)``, shuffled on the conversation key."""
    conv = table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return u.join(a, ["conv_id", "turn"], "inner")


def syllable_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested spelling fixture: per document all its words as
    ``annotations: array<struct<current_syllable, alternative_syllables>>``."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.col("text"), r"[ \t\n\r]+"), lambda w: w != "")
    ann = F.transform(
        words,
        lambda w, i: F.struct(
            w.alias("current_syllable"),
            F.when(
                seeded_uniform(F.col("doc_id"), i, 7) < 0.1, F.array(F.reverse(w))
            ).otherwise(F.array().cast("array<string>")).alias("alternative_syllables"),
        ),
    )
    return docs.select("doc_id", ann.alias("annotations"))


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "inner")


LANG_IDS = ("en", "fr", "de", "es")  # fixed order: lang -> truth id 0..3


def lang_id(col: Column) -> Column:
    return (
        F.when(col == "en", 0).when(col == "fr", 1).when(col == "de", 2).when(col == "es", 3)
    )


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth = lang id; prediction = truth with seeded prob 0.8, else (truth+1) % 4."""
    docs = table(spark, sf_dir, "documents")
    truth = lang_id(F.col("lang"))
    pred = F.when(seeded_uniform(F.col("doc_id"), F.lit(0), 11) < 0.8, truth).otherwise((truth + 1) % 4)
    return docs.select("doc_id", truth.alias("label"), pred.alias("pred"))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("scores"),
        "label",
    )


def shot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_extendedprice",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
