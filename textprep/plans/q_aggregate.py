"""§2.4 aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.text import SPACE_CHARS, WORD, WORD_CHARS, java
from textprep.operators import aggregates as A
from textprep.operators.order import running_max_records
from textprep.plans import fixtures_sql as X
from textprep.plans.sql import q
from textprep.plans.catalog import register
from textprep.sources import tables as TB
from textprep.sources.tables import table

CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
WS_PIECE = f"{WORD}+|[^{WORD_CHARS}{SPACE_CHARS}]+"


@register("distinct_first_seen_ids", "SELECT lang AS value, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) "
          "AS id FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _first_seen(spark, sf):
    return A.distinct_first_seen_ids(table(spark, sf, "documents"), "lang", "doc_id")


@register("label_encode_sorted", "SELECT c_mktsegment AS value, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) "
          "AS id FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)")
def _label_sorted(spark, sf):
    return A.label_encode_sorted(table(spark, sf, "customer"), "c_mktsegment")


@register("row_count", "SELECT count(*) AS n_rows FROM documents")
def _row_count(spark, sf):
    return A.row_count(table(spark, sf, "documents"))


@register("null_counts", "SELECT column_name, n_null FROM (SELECT " + ", ".join(
    f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS {c}" for c in
    ("event_id", "ts", "user_id", "event_type", "value", "props")) + f" FROM {X.EVENTS_NULLS}) "
    "UNPIVOT (n_null FOR column_name IN (event_id, ts, user_id, event_type, value, props))")
def _null_counts(spark, sf):
    return A.null_counts(TB.events_with_nulls(spark, sf))


@register("value_histogram", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _hist(spark, sf):
    return A.value_histogram(table(spark, sf, "orders"), "o_orderstatus")


@register("corr_matrix", "SELECT col_a, col_b, round(r, 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM lineitem" for a in CORR_COLS for b in CORR_COLS) + ")")
def _corr(spark, sf):
    return A.corr_matrix(table(spark, sf, "lineitem"), CORR_COLS, digits=6)


@register("word_counts", f"SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, {q(WS_PIECE)}, 0)) "
          "AS token FROM documents) GROUP BY token")
def _word_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return A.word_counts(F.regexp_extract_all(F.col("text"), F.lit(java(WS_PIECE)), 0), docs)


@register("group_collect", "SELECT l_orderkey, array_to_string(list('w' || CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, "
          "l_partkey, l_suppkey), ' ') AS words, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS tags, "
          "list(l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem GROUP BY l_orderkey")
def _group_collect(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("word", F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    g = A.group_collect(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["word", "l_returnflag", "l_linestatus"])
    return g.select(
        "l_orderkey",
        F.array_join(F.col("_rows.word"), " ").alias("words"),
        F.col("_rows.l_returnflag").alias("tags"),
        F.col("_rows.l_linestatus").alias("pos"),
    )


@register("max_nested_size",
          "WITH s AS (SELECT doc_id, CAST(coalesce(list_max(list_transform(annotations, lambda a: len(a.alternative_syllables))), 0) "
          f"AS INTEGER) AS max_size FROM {X.SYLLABLES}) SELECT doc_id, max_size, (max(max_size) OVER (ORDER BY doc_id ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND 1 PRECEDING)) IS NULL OR max_size > max(max_size) OVER (ORDER BY doc_id ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND 1 PRECEDING) AS is_record FROM s")
def _max_nested(spark, sf):
    sizes = A.max_nested_size(TB.syllable_annotations(spark, sf), "annotations", "alternative_syllables", ["doc_id"])
    return running_max_records(sizes, ["doc_id"], "max_size")

