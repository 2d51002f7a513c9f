"""§2.1 scans and sinks: each query writes a table (or a derived fixture) in the
source format to the shared scratch folder and reads it back with the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.rnd import seeded_uniform
from textprep.functions.text import text_normalize
from textprep.operators.aggregates import distinct_first_seen_ids, label_encode_sorted
from textprep.plans import fixtures_sql as X
from textprep.plans import sql as S
from textprep.plans.catalog import register
from textprep.plans.q_sampling import _LEN_IDS_SQL, _len_ids
from textprep.plans.q_vocab import _wordlevel_vocab, wordlevel_vocab_sql
from textprep.sources import files as FS
from textprep.sources import tables as TB
from textprep.sources.tables import table

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLE_SCHEMA = ("doc_id bigint, annotations array<struct<current_syllable:string, "
                   "alternative_syllables:array<string>>>")


@register("scan_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _scan_csv(spark, sf):
    path = FS.scratch_path(spark, "documents-csv")
    FS.write_csv(table(spark, sf, "documents"), path)
    return FS.read_csv(spark, path, DOC_SCHEMA, multi_line=True)


@register("scan_csv_encoding", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _scan_csv_enc(spark, sf):
    path = FS.scratch_path(spark, "documents-latin1")
    FS.write_csv(table(spark, sf, "documents"), path, encoding="ISO-8859-1")
    return FS.read_csv_fallback(spark, path, DOC_SCHEMA, multi_line=True)


@register("scan_csv_positional", "SELECT l_extendedprice AS _c5 FROM lineitem")
def _scan_pos(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice", "l_returnflag")
    path = FS.scratch_path(spark, "lineitem-noheader")
    FS.write_csv(li, path, encoding="ISO-8859-1", header=False)
    schema = "_c0 bigint, _c1 bigint, _c2 bigint, _c3 int, _c4 double, _c5 double, _c6 string"
    return FS.read_csv_positional(spark, path, 5, schema=schema)


@register("scan_jsonl_nested", "SELECT doc_id, CAST(len(annotations) AS BIGINT) AS n_ann, CAST(coalesce(list_sum(list_transform("
          "annotations, lambda a: len(a.alternative_syllables))), 0) AS BIGINT) AS n_alt, list_transform(annotations, lambda a: a.current_syllable) AS words "
          f"FROM {X.SYLLABLES}")
def _scan_jsonl(spark, sf):
    path = FS.scratch_path(spark, "syllables-jsonl")
    FS.write_jsonl(TB.syllable_annotations(spark, sf), path)
    ann = FS.read_jsonl(spark, path, SYLLABLE_SCHEMA)
    return ann.select(
        "doc_id", F.size("annotations").cast("bigint").alias("n_ann"),
        F.aggregate("annotations", F.lit(0).cast("bigint"),
                    lambda acc, a: acc + F.size(a["alternative_syllables"])).alias("n_alt"),
        F.transform("annotations", lambda a: a["current_syllable"]).alias("words"))


@register("scan_text_lines", "SELECT line FROM (SELECT " + S.rx("unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n'))",
                                                              "^[\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}"
                                                              "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|"
                                                              "[\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}"
                                                              "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+\\z", "")
          + " AS line FROM documents) WHERE line <> ''")
def _scan_text(spark, sf):
    path = FS.scratch_path(spark, "documents-text")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.mode("overwrite").text(path)
    return FS.read_text_lines(spark, path).select("line")


def _split_col():
    u = seeded_uniform(F.col("conv_id"), F.lit("split"), 42)
    return F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test")


@register("scan_split_dataset", "SELECT conv_id, turn, role, text, CASE WHEN "
          + "(('0x'||substr(md5(concat_ws('|', CAST(conv_id AS VARCHAR), 'split', '42')),1,8))::BIGINT / 4294967296.0)"
          + " < 0.8 THEN 'train' WHEN (('0x'||substr(md5(concat_ws('|', CAST(conv_id AS VARCHAR), 'split', '42')),1,8))::BIGINT"
          + " / 4294967296.0) < 0.9 THEN 'validation' ELSE 'test' END AS split FROM conversations")
def _scan_split(spark, sf):
    path = FS.scratch_path(spark, "conversations-split")
    conv = table(spark, sf, "conversations").withColumn("split", _split_col())
    conv.write.mode("overwrite").partitionBy("split").parquet(path)
    splits = [FS.read_split_dataset(spark, path, s) for s in ("train", "validation", "test")]
    return splits[0].unionByName(splits[1]).unionByName(splits[2]).select("conv_id", "turn", "role", "text", "split")


@register("sink_csv", f"SELECT doc_id, {_LEN_IDS_SQL} AS ids FROM documents")
def _sink_csv(spark, sf):
    path = FS.scratch_path(spark, "ids-csv")
    d = table(spark, sf, "documents").select("doc_id", _len_ids().alias("ids"))
    FS.write_csv(d, path)
    back = FS.read_csv(spark, path, "doc_id bigint, ids string")
    return back.select("doc_id", F.from_json("ids", "array<int>").alias("ids"))


@register("sink_text_corpus", "SELECT clean AS line FROM (" + S.cte_chain(
    "documents", "doc_id", "coalesce(CAST(text AS VARCHAR), '')", S.chain(None), "clean") + ")")
def _sink_text(spark, sf):
    path = FS.scratch_path(spark, "corpus-text")
    d = table(spark, sf, "documents").select(text_normalize(F.col("text")).alias("clean"))
    FS.write_text_corpus(d, "clean", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("sink_mapping_json",
          "SELECT 'lang2id' AS name, lang AS value, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS id "
          "FROM documents GROUP BY lang UNION ALL SELECT 'segment2id', c_mktsegment, CAST(dense_rank() OVER "
          "(ORDER BY c_mktsegment) - 1 AS INTEGER) FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def _sink_mapping(spark, sf):
    path = FS.scratch_path(spark, "mappings-json")
    FS.write_mapping_json({
        "lang2id": distinct_first_seen_ids(table(spark, sf, "documents"), "lang", "doc_id"),
        "segment2id": label_encode_sorted(table(spark, sf, "customer"), "c_mktsegment"),
    }, path)
    return spark.read.schema("name string, value string, id int").json(path)


@register("sink_vocab", "SELECT token, id FROM " + wordlevel_vocab_sql())
def _sink_vocab(spark, sf):
    path = FS.scratch_path(spark, "vocab-parquet")
    FS.write_vocab(_wordlevel_vocab(spark, sf), path)
    return spark.read.parquet(f"{path}/vocab")
