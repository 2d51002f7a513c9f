"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing
sources to target weights, sharding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that the stage
before it kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.llm import decontamination, jaccard_join, langid, mixing, sharding
from textprep.llm.common import explode_count, pinned, read_table, row_struct
from textprep.llm.queries import N_SHARDS, SOURCE_WEIGHTS, id_remainder

MIN_LANG_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose best language has a probability of
    less than MIN_LANG_SCORE; the model is learned as in op5."""
    model = langid.fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    found = docs.select(row_struct(docs.columns).alias("doc"), langid.language_of(F.col("text"), model, spark).alias("found"))
    return found.where((F.col("found.lang_pred") != langid.UNDETERMINED) & (F.col("found.score") >= MIN_LANG_SCORE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times)."""
    doc = docs.select(row_struct(docs.columns).alias("doc"), "doc_id", "text", "source")
    mixed = mixing.mix(doc, mixing.cyclic_weights(SOURCE_WEIGHTS)).where("copies > 0")
    return explode_count(mixed.select("doc", "copies"), "copies", "copy").select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.rendezvous_shards(docs, "doc_id", [1.0] * N_SHARDS)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pinned(docs, f"stage{k + 1}")
    return docs


ORACLE_SQL = None  # learned models and hashes of several stages have no SQL form; see tests/llm
