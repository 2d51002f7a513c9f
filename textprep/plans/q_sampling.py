"""§2.5 ordered operators, §2.6 limits / top-k, §2.7 rebalance, §2.10 sampling and
augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.arrays import one_hot, pad_truncate
from textprep.functions.text import PAT, java, split_whitespace
from textprep.operators import sampling as SM
from textprep.operators.order import ffill
from textprep.plans import fixtures_sql as X
from textprep.plans.catalog import register
from textprep.plans.q_aggregate import WS_PIECE
from textprep.plans.q_relational import pair_within_label_sql
from textprep.plans.sql import q
from textprep.sources import tables as TB
from textprep.sources.tables import table

SPLIT_WS_SQL = f"list_filter(regexp_split_to_array(text, {q(PAT['spaces'])}), lambda x: x <> '')"
SLICE_N = 8000  # reference: first 8,000 rows train, the rest validation
BATCH = 64
CAP_ROWS = 300  # rows kept of the capped class in the registered rebalance query


def _rank(order: str, extra: str = "") -> str:
    return f"row_number() OVER ({extra} ORDER BY {order})"


@register("ffill", "SELECT event_id, ts, user_id, last_value(event_type IGNORE NULLS) OVER w AS event_type, "
          f"last_value(value IGNORE NULLS) OVER w AS value, props FROM {X.EVENTS_NULLS} "
          "WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _ffill(spark, sf):
    return ffill(TB.events_with_nulls(spark, sf), ["event_id"])


@register("seeded_shuffle", f"SELECT doc_id, {_rank(X.bits('doc_id', '0', 42) + ', doc_id')} - 1 AS idx FROM documents")
def _shuffle(spark, sf):
    return SM.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@register("slice_by_position", f"SELECT event_id, CASE WHEN {_rank('event_id')} <= {SLICE_N} THEN 'head' ELSE 'tail' END "
          "AS part FROM events")
def _slice(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    head = SM.slice_by_position(ev, "event_id", SLICE_N, "head").withColumn("part", F.lit("head"))
    tail = SM.slice_by_position(ev, "event_id", SLICE_N, "tail").withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


@register("split_ordered", f"SELECT doc_id, CASE WHEN {_rank('doc_id')} <= floor(0.9 * count(*) OVER ()) THEN 'train' "
          "ELSE 'validation' END AS part FROM documents")
def _split_ordered(spark, sf):
    return SM.split_ordered(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.9)


@register("batch_assign", f"SELECT event_id, batch_id FROM (SELECT event_id, ({_rank('event_id')} - 1) // {BATCH} AS batch_id, "
          f"count(*) OVER () AS n FROM events) WHERE batch_id < n // {BATCH}")
def _batch_assign(spark, sf):
    return SM.batch_assign(table(spark, sf, "events").select("event_id"), ["event_id"], BATCH, drop_last=True)


_LEN_IDS_SQL = f"list_transform({SPLIT_WS_SQL}, lambda w: CAST(length(w) AS INTEGER))"


def _len_ids(col="text"):
    return F.transform(split_whitespace(F.col(col)), lambda w: F.length(w))


@register("batch_pad_to_max",
          f"WITH b AS (SELECT doc_id, {_LEN_IDS_SQL} AS ids, ({_rank('doc_id')} - 1) // 16 AS batch_id FROM documents) "
          "SELECT doc_id, batch_id, list_concat(ids, list_transform(range(max(len(ids)) OVER (PARTITION BY batch_id) - len(ids)), "
          "lambda x: 0)) AS padded FROM b")
def _batch_pad(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", _len_ids().alias("ids"))
    b = SM.batch_assign(docs, ["doc_id"], 16)
    return SM.batch_pad_to_max(b, "ids", "batch_id").select("doc_id", "batch_id", "padded")


@register("head_n", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def _head(spark, sf):
    return SM.head_n(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], 5)


@register("error_samples", f"SELECT p.doc_id, p.label, p.pred, d.text FROM {X.PREDICTIONS} p JOIN documents d USING (doc_id) "
          "WHERE p.pred <> p.label ORDER BY p.doc_id LIMIT 10")
def _errors(spark, sf):
    # the ids first: only ten rows meet the texts
    few = SM.error_samples(TB.prediction_table(spark, sf), "pred", "label", "doc_id", 10)
    return table(spark, sf, "documents").select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "label", "pred", "text")


@register("vocab_top_k", f"SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, {q(WS_PIECE)}, 0)) "
          "AS token FROM documents) GROUP BY token ORDER BY count DESC, token LIMIT 50")
def _top_k(spark, sf):
    from textprep.operators.aggregates import word_counts

    wc = word_counts(F.regexp_extract_all(F.col("text"), F.lit(java(WS_PIECE)), 0), table(spark, sf, "documents"))
    return SM.vocab_top_k(wc, 50)


@register("class_cap_rebalance",
          "WITH kept AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rk "
          f"FROM documents WHERE lang = 'en') WHERE rk <= {CAP_ROWS} UNION ALL SELECT doc_id, lang FROM documents "
          "WHERE lang <> 'en' OR lang IS NULL) SELECT doc_id, lang, "
          f"{_rank(X.bits('doc_id', '0', 42) + ', doc_id')} - 1 AS idx FROM kept")
def _rebalance(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return SM.class_cap_rebalance(docs, "lang", "en", CAP_ROWS, "doc_id", 42)


def split_sql(frac=0.2, seed=42, src="documents", key="doc_id"):
    return (f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY {X.bits(key, '0', seed)}, {key}) <= ceil(count(*) OVER () * {frac}) "
            f"THEN 'test' ELSE 'train' END AS part FROM {src})")


@register("split_fraction", f"SELECT doc_id, part FROM {split_sql()}")
def _split_fraction(spark, sf):
    return SM.split_fraction(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2, 42)


@register("split_three_way",
          f"WITH a AS {split_sql(0.4, 42)}, h AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {X.bits('doc_id', '0', 43)}, "
          "doc_id) <= ceil(count(*) OVER () * 0.5) THEN 'test' ELSE 'validation' END AS part FROM a WHERE part = 'test') "
          "SELECT doc_id, 'train' AS part FROM a WHERE part = 'train' UNION ALL SELECT doc_id, part FROM h")
def _split3(spark, sf):
    return SM.split_three_way(table(spark, sf, "documents").select("doc_id"), "doc_id", 42).select("doc_id", "part")


def mask_sql(src="documents", prob=0.3, seed=42):
    return (
        f"WITH t AS (SELECT doc_id, text, {SPLIT_WS_SQL} AS toks FROM {src}), "
        "u AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i, len(toks) AS n FROM t), "
        f"r AS (SELECT doc_id, tok, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY {X.bits('doc_id', 'i - 1', seed)}, i) "
        "AS rk FROM u), "
        f"m AS (SELECT doc_id, array_to_string(list(CASE WHEN rk <= greatest(1, floor(n * {prob})) THEN '[MASK]' ELSE tok END "
        "ORDER BY i), ' ') AS masked FROM r GROUP BY doc_id) "
        "SELECT t.doc_id, CASE WHEN len(t.toks) = 0 THEN t.text ELSE m.masked END AS masked FROM t LEFT JOIN m USING (doc_id)"
    )


@register("mask_tokens", mask_sql())
def _mask(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return SM.mask_tokens(d, "text", "doc_id", "masked", 0.3, 42).select("doc_id", "masked")


def cutmix_sql_expr(t1, t2, key, seed=42):
    def toks(t):
        return f"list_filter(regexp_split_to_array({t}, {q(PAT['spaces'])}), lambda x: x <> '')"

    def randint(slot, n):
        lo = f"greatest(1, CAST(floor({n} * 0.2) AS INTEGER))"
        hi = f"greatest({lo}, greatest(1, CAST(floor({n} * 0.8) AS INTEGER)))"
        u = f"(('0x'||substr(md5(concat_ws('|', {key}, '{slot}', '{seed}')),1,8))::BIGINT / 4294967296.0)"
        return f"CAST({lo} + floor({u} * ({hi} - {lo} + 1)) AS INTEGER)"

    a, b = toks(t1), toks(t2)
    na, nb = f"len({a})", f"len({b})"
    return (f"CASE WHEN {na} = 0 OR {nb} = 0 THEN '' ELSE array_to_string(list_concat({a}[1:{randint(1, na)}], "
            f"{b}[{randint(2, nb)} + 1:]), ' ') END")


@register("cut_mix_pair", "SELECT conv_id, turn, " + cutmix_sql_expr("src", "tgt", "concat_ws(':', conv_id, turn)")
          + f" AS mixed FROM {X.PARALLEL_PAIRS}")
def _cut_mix(spark, sf):
    pairs = TB.parallel_pairs(spark, sf)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return pairs.select("conv_id", "turn", SM.cut_mix_pair(F.col("src"), F.col("tgt"), key, 42).alias("mixed"))


@register("augment_cutmix",
          "SELECT doc_id, text, lang FROM documents UNION ALL SELECT NULL::BIGINT AS doc_id, mixed AS text, lang FROM ("
          "SELECT lang, " + cutmix_sql_expr("text_a", "text_b", "concat_ws(':', lang, CAST(draw_id AS VARCHAR))")
          + " AS mixed FROM (" + pair_within_label_sql() + ")) WHERE mixed <> ''")
def _augment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return SM.augment_cutmix(docs, "lang", "doc_id", "text", 1, 42)


SWAP_L = 64


def _swap_input(spark, sf):
    d = TB.labelled_texts(spark, sf)
    return d.select("doc_id", pad_truncate(_len_ids(), SWAP_L).alias("ids"),
                    F.transform(one_hot(F.col("quality"), 2), lambda x: x.cast("double")).alias("y"))


_SWAP_SQL = (
    "WITH base AS (SELECT d.doc_id, list_concat(" + _LEN_IDS_SQL.replace("text", "d.text") + f"[1:{SWAP_L}], "
    f"list_transform(range(greatest(0, {SWAP_L} - len(" + _LEN_IDS_SQL.replace("text", "d.text") + f"[1:{SWAP_L}]))), "
    "lambda x: 0)) AS ids, list_transform(range(2), lambda i: CAST(CASE WHEN i = l.quality THEN 1 ELSE 0 END AS DOUBLE)) AS y "
    "FROM documents d JOIN labels l USING (doc_id)), "
    "a AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM base), "
    f"p AS (SELECT doc_id AS partner_key, ids AS pids, y AS py, row_number() OVER (ORDER BY {X.bits('doc_id', '0', 42)}, doc_id) "
    "AS pos FROM base), "
    "j AS (SELECT a.doc_id, p.partner_key, a.ids, p.pids, a.y, p.py, list_transform(a.ids, lambda x, i: "
    f"{X.bits('a.doc_id', 'i - 1', 42)} / 4294967296.0 < 0.1) AS mask FROM a JOIN p USING (pos)), "
    "k AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN mask[i] THEN pids[i] ELSE x END) AS mixed_ids, "
    "len(list_filter(mask, lambda m: m)) / len(ids) AS swap_frac FROM j) "
    "SELECT doc_id, partner_key, mixed_ids, round(swap_frac, 6) AS swap_frac, "
    "list_transform(y, lambda v, i: round((1 - swap_frac) * v + swap_frac * py[i], 6)) AS mixed_labels FROM k"
)


@register("token_swap_mix", _SWAP_SQL)
def _swap(spark, sf):
    out = SM.token_swap_mix(_swap_input(spark, sf), "doc_id", "ids", "y", 0.1, 42)
    return out.select("doc_id", "partner_key", "mixed_ids", F.round("swap_frac", 6).alias("swap_frac"),
                      F.transform("mixed_labels", lambda v: F.round(v, 6)).alias("mixed_labels"))


@register("bernoulli_gate",
          f"WITH s AS {split_sql()}, m AS ({mask_sql()}) SELECT s.doc_id, s.part, CASE WHEN s.part = 'train' AND "
          "(('0x'||substr(md5(concat_ws('|', CAST(s.doc_id AS VARCHAR), 'gate', '42')),1,8))::BIGINT / 4294967296.0) < 0.5 "
          "THEN m.masked ELSE s.text END AS text FROM s JOIN m USING (doc_id)")
def _gate(spark, sf):
    d = SM.split_fraction(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 0.2, 42)
    d = SM.mask_tokens(d, "text", "doc_id", "_masked", 0.3, 42)
    out = SM.bernoulli_gate(F.col("doc_id"), F.col("_masked"), F.col("text"), 0.5, 42, is_train=F.col("part") == "train")
    return d.select("doc_id", "part", out.alias("text"))
