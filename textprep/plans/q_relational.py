"""§2.2 projections / filters, §2.3 joins, §2.7 set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.operators import relational as R
from textprep.operators.aggregates import distinct_first_seen_ids
from textprep.operators.sampling import pair_within_label, split_fraction
from textprep.plans import fixtures_sql as X
from textprep.plans.catalog import register
from textprep.sources import tables as TB
from textprep.sources.tables import table

# Priority recode of the registered map_values query
PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
NOT_IN_TYPES = ("click", "view")


@register("select_drop", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem")
def _select_drop(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = R.select_drop(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_tax"])
    return R.select_drop(kept, drop=["l_tax"])


@register("dropna_any", f"SELECT * FROM {X.EVENTS_NULLS} WHERE event_type IS NOT NULL AND value IS NOT NULL "
          "AND event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND props IS NOT NULL")
def _dropna_any(spark, sf):
    return R.dropna_any(TB.events_with_nulls(spark, sf))


@register("dropna_column", f"SELECT event_id, value FROM {X.EVENTS_NULLS} WHERE value IS NOT NULL")
def _dropna_column(spark, sf):
    return R.dropna_column(TB.events_with_nulls(spark, sf).select("event_id", "value"), "value")


@register("fillna_const", f"SELECT event_id, event_type, coalesce(value, 0.0) AS value FROM {X.EVENTS_NULLS}")
def _fillna_const(spark, sf):
    return R.fillna_const(TB.events_with_nulls(spark, sf).select("event_id", "event_type", "value"), 0.0, ["value"])


@register("derive_sum", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "coalesce(l_quantity, 0) + coalesce(l_tax, 0) AS qty_plus_tax FROM lineitem")
def _derive_sum(spark, sf):
    li = R.fillna_const(table(spark, sf, "lineitem"), 0, ["l_quantity", "l_tax"])
    out = R.derive_sum(li, "qty_plus_tax", "l_quantity", "l_tax")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty_plus_tax")


@register("filter_not_in", f"SELECT event_id, event_type FROM {X.EVENTS_NULLS} "
          "WHERE coalesce(event_type NOT IN ('click', 'view'), true)")
def _filter_not_in(spark, sf):
    return R.filter_not_in(TB.events_with_nulls(spark, sf).select("event_id", "event_type"), "event_type", NOT_IN_TYPES)


@register("filter_eq", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def _filter_eq(spark, sf):
    return R.filter_eq(table(spark, sf, "labels"), "quality", 1)


@register("cast_text", f"SELECT event_id, coalesce(CAST(value AS VARCHAR), 'nan') AS value_text, "
          f"TRY_CAST(CAST(user_id AS VARCHAR) AS INTEGER) AS user_int FROM {X.EVENTS_NULLS}")
def _cast_text(spark, sf):
    ev = TB.events_with_nulls(spark, sf)
    return ev.select("event_id", R.cast_text(F.col("value")).alias("value_text"),
                     R.cast_int(F.col("user_id").cast("string")).alias("user_int"))


@register("map_values", "SELECT o_orderkey, CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in PRIORITY_CODES.items()) + " END AS priority_code FROM orders")
def _map_values(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", R.map_values(F.col("o_orderpriority"), PRIORITY_CODES).alias("priority_code"))


_TRAIN_LANG_IDS = (
    "(SELECT lang AS value, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS id FROM "
    "(SELECT *, row_number() OVER (ORDER BY " + X.bits("doc_id", "0", 42) + ", doc_id) AS rk, count(*) OVER () AS n "
    "FROM documents) WHERE rk > ceil(n * 0.2) GROUP BY lang)"
)
_TEST_DOCS = (
    "(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY " + X.bits("doc_id", "0", 42) + ", doc_id) AS rk, "
    "count(*) OVER () AS n FROM documents) WHERE rk <= ceil(n * 0.2))"
)


@register("map_values_strict", f"SELECT t.doc_id, t.lang, c.id AS lang_id FROM {_TEST_DOCS} t "
          f"LEFT JOIN {_TRAIN_LANG_IDS} c ON c.value = t.lang")
def _map_values_strict(spark, sf):
    docs = split_fraction(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 0.2, 42)
    codes = distinct_first_seen_ids(docs.where(F.col("part") == "train"), "lang", "doc_id")
    test = docs.where(F.col("part") == "test").drop("part")
    return R.map_values_strict(test, "lang", codes, out="lang_id").select("doc_id", "lang", "lang_id")


@register("minmax_affine", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "round(2 * (l_quantity - (-224)) / 448.0 - 1, 9) AS x1, round(2 * (l_discount - (-224)) / 448.0 - 1, 9) AS x2, "
          "round(2 * (l_extendedprice - 0) / 79.0 - 1, 9) AS x3, l_tax AS x4 FROM lineitem")
def _minmax_affine(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(R.minmax_affine(F.col("l_quantity"), -224, 224), 9).alias("x1"),
        F.round(R.minmax_affine(F.col("l_discount"), -224, 224), 9).alias("x2"),
        F.round(R.minmax_affine(F.col("l_extendedprice"), 0, 79), 9).alias("x3"),
        F.col("l_tax").alias("x4"),  # left raw, as the reference leaves one feature
    )


@register("pick_first_or_else", "SELECT doc_id, list_transform(annotations, lambda a: "
          f"coalesce(a.alternative_syllables[1], a.current_syllable)) AS right_words FROM {X.SYLLABLES}")
def _pick_first(spark, sf):
    ann = TB.syllable_annotations(spark, sf)
    return ann.select("doc_id", F.transform("annotations", lambda a: R.pick_first_or_else(
        a["alternative_syllables"], a["current_syllable"])).alias("right_words"))


# --- joins ----------------------------------------------------------------------

_FIRST_SEEN_LANG = ("(SELECT lang AS value, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS id "
                    "FROM documents GROUP BY lang)")


@register("lookup_join", f"SELECT d.doc_id, d.lang, c.id AS lang_id FROM documents d LEFT JOIN {_FIRST_SEEN_LANG} c "
          "ON c.value = d.lang")
def _lookup_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    codes = distinct_first_seen_ids(docs, "lang", "doc_id").withColumnRenamed("value", "lang").withColumnRenamed("id", "lang_id")
    return R.lookup_join(docs, codes, "lang")


def _side_sql(role, col):
    # every 29th line or so holds a tab alone: blank, as any white space is
    line = "CASE WHEN (conv_id * 7 + turn) % 29 = 0 THEN chr(9) ELSE text END"
    return (f"(SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, line AS {col} FROM (SELECT conv_id, turn, {line} AS line "
            f"FROM conversations WHERE role = '{role}') WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')")


@register("zip_align", f"SELECT s.idx, s.src, t.tgt FROM {_side_sql('user', 'src')} s JOIN {_side_sql('assistant', 'tgt')} t "
          "ON s.idx = t.idx")
def _zip_align(spark, sf):
    conv = table(spark, sf, "conversations").withColumn(
        "text", F.when((F.col("conv_id") * 7 + F.col("turn")) % 29 == 0, "\t").otherwise(F.col("text")))
    src = conv.where(F.col("role") == "user").select("conv_id", "turn", "text")
    tgt = conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return R.zip_align(src, tgt, ["conv_id", "turn"])


def pair_within_label_sql(n_aug=1, seed=42):
    h = X.bits("doc_id", "0", seed)
    local = (f"(SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY {h}, doc_id) - 1 AS i, "
             f"count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)")
    dkey = "concat_ws(':', CAST(lang AS VARCHAR), CAST(draw_id AS VARCHAR))"
    ua = f"(('0x'||substr(md5(concat_ws('|', {dkey}, 'a', '{seed}')),1,8))::BIGINT / 4294967296.0)"
    ub = f"(('0x'||substr(md5(concat_ws('|', {dkey}, 'b', '{seed}')),1,8))::BIGINT / 4294967296.0)"
    draws = (f"(SELECT lang, draw_id, n, CAST(floor({ua} * n) AS BIGINT) AS a, CAST(floor({ub} * (n - 1)) AS BIGINT) AS b0 "
             f"FROM (SELECT lang, n, i * {n_aug} + m AS draw_id FROM {local}, range({n_aug}) r(m) WHERE n >= 2))")
    return (f"WITH loc AS {local}, dr AS (SELECT lang, draw_id, a, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END AS b FROM {draws}) "
            "SELECT dr.lang, dr.draw_id, la.text AS text_a, lb.text AS text_b FROM dr "
            "JOIN loc la ON la.lang = dr.lang AND la.i = dr.a JOIN loc lb ON lb.lang = dr.lang AND lb.i = dr.b")


@register("pair_within_label", pair_within_label_sql())
def _pair_within_label(spark, sf):
    return pair_within_label(table(spark, sf, "documents"), "lang", "doc_id", "text", 1, 42)


# --- set operations -------------------------------------------------------------

@register("union_all", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 "
          "UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1")
def _union_all(spark, sf):
    lab = table(spark, sf, "labels")
    return R.union_all(lab.where(F.col("quality") == 1), lab.where(F.col("toxic") == 1))


@register("union_missing_cols", "SELECT doc_id, text, lang FROM documents UNION ALL "
          "SELECT NULL::BIGINT AS doc_id, text, 'en' AS lang FROM benchmark")
def _union_missing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    extra = table(spark, sf, "benchmark").select("text", F.lit("en").alias("lang"))
    return R.union_missing_cols(docs, extra)

