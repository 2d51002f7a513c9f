"""§2.13 metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.arrays import pad_labels
from textprep.functions.rnd import seeded_uniform, sql_uniform
from textprep.operators import metrics as M
from textprep.operators.order import running_max_records
from textprep.operators.sampling import batch_assign, mask_tokens
from textprep.plans import fixtures_sql as X
from textprep.plans.catalog import register
from textprep.plans.q_sampling import mask_sql
from textprep.sources import tables as TB
from textprep.sources.tables import table

LABELS_0_3 = (0, 1, 2, 3)
EPOCH_BATCH = 64


@register("accuracy_micro", f"SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM {X.PREDICTIONS}")
def _acc(spark, sf):
    return M.accuracy_micro(TB.prediction_table(spark, sf), "pred", "label").select(F.round("accuracy", 9).alias("accuracy"))


@register("accuracy_macro", "SELECT round(avg(r), 9) AS accuracy_macro FROM (SELECT label, avg(CASE WHEN pred = label THEN 1.0 "
          f"ELSE 0.0 END) AS r FROM {X.PREDICTIONS} GROUP BY label)")
def _acc_macro(spark, sf):
    out = M.accuracy_macro(TB.prediction_table(spark, sf), "pred", "label")
    return out.select(F.round("accuracy_macro", 9).alias("accuracy_macro"))


_BIN_SCORE = "(value - 250.0) / 100.0"


@register("accuracy_binary", "SELECT round(avg(CASE WHEN (CASE WHEN s.lo < 0 OR s.hi > 1 THEN 1 / (1 + exp(-x)) ELSE x END > 0.5) "
          "= (event_type IN ('purchase', 'signup')) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM (SELECT "
          f"{_BIN_SCORE} AS x, event_type FROM events) e, (SELECT min({_BIN_SCORE}) AS lo, max({_BIN_SCORE}) AS hi FROM events) s")
def _acc_bin(spark, sf):
    ev = table(spark, sf, "events").select(
        ((F.col("value") - 250.0) / 100.0).alias("score"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("target"))
    return M.accuracy_binary(ev, "score", "target").select(F.round("accuracy", 9).alias("accuracy"))


@register("cross_entropy", "SELECT round(avg(list_max(scores) + ln(list_sum(list_transform(scores, lambda x: exp(x - list_max(scores))))) "
          f"- scores[label + 1]), 9) AS cross_entropy FROM {X.SCORES}")
def _ce(spark, sf):
    out = M.cross_entropy(TB.score_table(spark, sf), "scores", "label")
    return out.select(F.round("cross_entropy", 9).alias("cross_entropy"))


@register("cross_entropy_ignore", "SELECT round(avg(list_max(scores) + ln(list_sum(list_transform(scores, lambda x: exp(x - list_max(scores))))) "
          f"- scores[label + 1]), 9) AS cross_entropy FROM {X.SCORES} WHERE label <> 3")
def _ce_ignore(spark, sf):
    out = M.cross_entropy(TB.score_table(spark, sf), "scores", "label", ignore_index=3)
    return out.select(F.round("cross_entropy", 9).alias("cross_entropy"))


@register("cross_entropy_binary", "SELECT round(avg(greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))), 9) AS bce FROM (SELECT "
          f"{_BIN_SCORE} AS x, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 ELSE 0.0 END AS y FROM events)")
def _bce(spark, sf):
    ev = table(spark, sf, "events").select(
        ((F.col("value") - 250.0) / 100.0).alias("score"), F.col("event_type").isin("purchase", "signup").cast("int").alias("target"))
    return M.binary_cross_entropy_logits(ev, "score", "target").select(F.round("bce", 9).alias("bce"))


TOKEN_L, TOKEN_PAD = 4, 37  # orders longer than four lines are cut, shorter ones padded with the ignored id


@register("accuracy_tokens", "WITH t AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, "
          "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem) "
          f"SELECT round(avg(CASE WHEN {sql_uniform('l_orderkey', 'i', 13)} < 0.8 THEN 1.0 ELSE 0.0 END), 9) AS accuracy "
          f"FROM t WHERE i < {TOKEN_L}")
def _acc_tokens(spark, sf):
    codes = F.create_map(F.lit("A"), F.lit(0), F.lit("N"), F.lit(1), F.lit("R"), F.lit(2))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    tags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select(
        "l_orderkey", pad_labels(F.transform("r", lambda x: codes[x["l_returnflag"]]), TOKEN_L).alias("label"))
    guess = F.transform("label", lambda x, i: F.when(seeded_uniform(F.col("l_orderkey"), i, 13) < 0.8, x).otherwise((x + 1) % 3))
    return M.token_accuracy(tags.withColumn("pred", guess), "pred", "label", TOKEN_PAD).select(F.round("accuracy", 9).alias("accuracy"))


@register("bleu_smoothed")
def _bleu_smoothed(spark, sf):
    return M.bleu_corpus(_bleu_input(spark, sf), "pair_id", "hyp", "tgt", smooth=True)


@register("confusion_matrix", "SELECT g.label, g.pred, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT a.label, b.pred FROM "
          "range(4) a(label), range(4) b(pred)) g LEFT JOIN (SELECT label, pred, count(*) AS n FROM "
          f"{X.PREDICTIONS} GROUP BY label, pred) c ON c.label = g.label AND c.pred = g.pred")
def _cm(spark, sf):
    out = M.confusion_matrix(TB.prediction_table(spark, sf), "pred", "label", LABELS_0_3)
    return out.select(F.col("label").cast("long"), F.col("pred").cast("long"), "n")


@register("f1_micro", "SELECT round(2.0 * sum(CASE WHEN pred = label THEN 1 ELSE 0 END) / (2.0 * sum(CASE WHEN pred = label "
          f"THEN 1 ELSE 0 END) + 2 * sum(CASE WHEN pred <> label THEN 1 ELSE 0 END)), 9) AS f1_micro FROM {X.PREDICTIONS}")
def _f1(spark, sf):
    return M.f1_micro(TB.prediction_table(spark, sf), "pred", "label").select(F.round("f1_micro", 9).alias("f1_micro"))


def _bleu_input(spark, sf):
    pairs = TB.parallel_pairs(spark, sf).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), "tgt")
    # hypothesis = the reference with 20 % of its tokens masked (seeded)
    return mask_tokens(pairs, "tgt", "pair_id", "hyp", 0.2, 42)


def _bleu_sql():
    pairs = f"(SELECT concat_ws(':', conv_id, turn) AS doc_id, tgt AS text FROM {X.PARALLEL_PAIRS})"
    hyp = mask_sql(src=pairs.replace("doc_id", "doc_id"), prob=0.2, seed=42)
    toks = ("list_filter(regexp_split_to_array({c}, '[\\t\\n\\x{{0B}}\\x{{0C}}\\r\\x{{1C}}-\\x{{1F}} \\x{{85}}\\x{{A0}}\\x{{1680}}"
            "\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')")
    return (
        f"WITH hyp AS ({hyp}), p AS (SELECT pr.doc_id, {toks.format(c='h.masked')} AS h, {toks.format(c='pr.text')} AS r "
        f"FROM {pairs} pr JOIN hyp h USING (doc_id)), "
        "ns AS (SELECT unnest([1, 2, 3, 4]) AS n), "
        "hg AS (SELECT doc_id, n, array_to_string(h[i:i + n - 1], ' ') AS g, count(*) AS c FROM p, ns, "
        "generate_series(1, len(h) - n + 1) t(i) GROUP BY ALL), "
        "rg AS (SELECT doc_id, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c FROM p, ns, "
        "generate_series(1, len(r) - n + 1) t(i) GROUP BY ALL), "
        "num AS (SELECT hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS num FROM hg LEFT JOIN rg USING (doc_id, n, g) GROUP BY hg.n), "
        "den AS (SELECT n, sum(greatest(len(h) - n + 1, 0)) AS den FROM p, ns GROUP BY n), "
        "lens AS (SELECT sum(len(h)) AS c, sum(len(r)) AS r FROM p), "
        "agg AS (SELECT min(coalesce(num.num, 0)) AS min_num, avg(ln(coalesce(num.num, 0) / den.den)) AS ml FROM den "
        "LEFT JOIN num USING (n)) "
        "SELECT round(CASE WHEN min_num = 0 OR c = 0 THEN 0.0 ELSE (CASE WHEN c < r THEN exp(1 - r / c) ELSE 1.0 END) * exp(ml) END, 9) "
        "AS bleu FROM agg, lens"
    )


@register("bleu_corpus", _bleu_sql())
def _bleu(spark, sf):
    return M.bleu_corpus(_bleu_input(spark, sf), "pair_id", "hyp", "tgt").select(F.round("bleu", 9).alias("bleu"))


def _epochs(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return batch_assign(ev, ["event_id"], EPOCH_BATCH)


_EPOCH_SQL = f"(SELECT (row_number() OVER (ORDER BY event_id) - 1) // {EPOCH_BATCH} AS batch_id, value FROM events)"


@register("epoch_mean", "SELECT round(sum(m * n) / sum(n), 9) AS weighted_mean, round(avg(m), 9) AS plain_mean FROM "
          f"(SELECT batch_id, avg(value) AS m, count(*) AS n FROM {_EPOCH_SQL} GROUP BY batch_id)")
def _epoch_mean(spark, sf):
    out = M.epoch_mean(_epochs(spark, sf), "batch_id", "value")
    return out.select(F.round("weighted_mean", 9).alias("weighted_mean"), F.round("plain_mean", 9).alias("plain_mean"))


@register("best_so_far",
          f"WITH e AS (SELECT batch_id, round(avg(value), 9) AS metric FROM {_EPOCH_SQL} GROUP BY batch_id), "
          "r AS (SELECT batch_id, metric, max(metric) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev "
          "FROM e), t AS (SELECT batch_id FROM e ORDER BY metric DESC, batch_id LIMIT 3) "
          "SELECT r.batch_id, r.metric, t.batch_id IS NOT NULL AS top3 FROM r LEFT JOIN t USING (batch_id) "
          "WHERE r.prev IS NULL OR r.metric > r.prev")
def _best(spark, sf):
    per = _epochs(spark, sf).groupBy("batch_id").agg(F.round(F.avg("value"), 9).alias("metric"))
    rec = running_max_records(per, ["batch_id"], "metric").where("is_record").drop("is_record")
    top = per.orderBy(F.col("metric").desc(), "batch_id").limit(3).select("batch_id", F.lit(True).alias("top3"))
    return rec.join(F.broadcast(top), "batch_id", "left").select(
        "batch_id", "metric", F.coalesce("top3", F.lit(False)).alias("top3"))
