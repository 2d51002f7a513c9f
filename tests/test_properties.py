"""Invariants of the randomised, ordered and encoding operators."""

import math

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF001
from textprep.operators import models as MO
from textprep.operators import order as O
from textprep.operators import sampling as SM
from textprep.operators import vocab as V
from textprep.sources import tables as TB
from textprep.sources.tables import table


def test_dense_index_is_a_permutation(spark):
    ev = table(spark, SF001, "events").select("event_id")
    ix = O.dense_index(ev, ["event_id"]).toPandas().sort_values("event_id")
    assert list(ix["idx"]) == list(range(len(ix)))


def test_ffill_matches_pandas(spark):
    ev = TB.events_with_nulls(spark, SF001)
    got = O.ffill(ev, ["event_id"]).toPandas().sort_values("event_id").reset_index(drop=True)
    exp = ev.toPandas().sort_values("event_id").reset_index(drop=True).ffill()
    pd.testing.assert_series_equal(got["event_type"], exp["event_type"])
    pd.testing.assert_series_equal(got["value"], exp["value"])


def test_kth_cut_exact(spark):
    docs = table(spark, SF001, "documents").select("doc_id")
    n = docs.count()
    for k in (0, 1, 7, n // 2, n, n + 5):
        got = docs.where(O.kth_cut(docs, F.col("doc_id"), F.col("doc_id"), k)).count()
        assert got == min(max(k, 0), n)


def test_splits_disjoint_complete_exact(spark):
    docs = table(spark, SF001, "documents").select("doc_id")
    n = docs.count()
    s = SM.split_fraction(docs, "doc_id", 0.2, 42).toPandas()
    assert len(s) == n and s["doc_id"].is_unique
    assert (s["part"] == "test").sum() == math.ceil(n * 0.2)
    t = SM.split_three_way(docs, "doc_id", 42).toPandas()
    assert set(t["part"]) == {"train", "validation", "test"} and len(t) == n
    hold = math.ceil(n * 0.4)
    assert (t["part"] == "test").sum() == math.ceil(hold * 0.5)


def test_mask_count(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    m = SM.mask_tokens(docs, "text", "doc_id", "masked", 0.3, 42).toPandas()
    for text, masked in zip(docs.toPandas().sort_values("doc_id")["text"], m.sort_values("doc_id")["masked"]):
        n = len(text.split())
        if n:
            assert masked.split().count("[MASK]") == max(1, int(n * 0.3)) or "[MASK]" in text


def test_results_invariant_to_partitioning(spark):
    from textprep.plans.catalog import QUERIES, load_all

    load_all()
    for key in ("seeded_shuffle", "split_fraction", "pair_within_label", "ffill", "batch_assign"):
        outs = []
        for parts in (1, 5):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = QUERIES[key](spark, SF001)
            outs.append(sorted(map(tuple, df.collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert outs[0] == outs[1], key


def test_encode_decode_roundtrip(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    vocab = V.wordlevel_train(V.word_table(docs, "text"), 10**6)
    toks = docs.select("doc_id", V.pretokenize_words(F.col("text")).alias("t"))
    enc = V.encode_tokens(toks, "doc_id", "t", vocab)
    dec = V.decode_ids(enc, "doc_id", "ids", vocab).toPandas().set_index("doc_id")["text"]
    exp = toks.toPandas().set_index("doc_id")["t"].map(lambda x: " ".join(x))
    assert (dec.sort_index() == exp.sort_index()).all()


def test_padding_constant_length(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    vocab = V.wordlevel_train(V.word_table(docs, "text"), 500)
    enc = V.wordlevel_encode(docs, "doc_id", "text", vocab, 64).toPandas()
    assert enc["ids"].map(len).eq(64).all() and enc["mask"].map(len).eq(64).all()


def test_token_swap_label_mix(spark):
    from textprep.plans.q_sampling import _swap_input

    out = SM.token_swap_mix(_swap_input(spark, SF001), "doc_id", "ids", "y", 0.1, 42).toPandas()
    for lab, f in zip(out["mixed_labels"], out["swap_frac"]):
        assert abs(sum(lab) - 1.0) < 1e-9 and 0.0 <= f <= 1.0


def test_cutmix_parents_share_label(spark):
    docs = table(spark, SF001, "documents")
    pairs = SM.pair_within_label(docs, "lang", "doc_id", "text", 2, 42).toPandas()
    lang = docs.select("text", "lang").toPandas().drop_duplicates("text").set_index("text")["lang"]
    assert (pairs["text_a"].map(lang) == pairs["lang"]).all()
    assert (pairs["text_b"].map(lang) == pairs["lang"]).all()


def test_kth_cut_with_tied_values(spark):
    # user_id repeats: the cut must break ties by the tie key and stay exact
    ev = table(spark, SF001, "events").select("event_id", "user_id")
    pdf = ev.toPandas().sort_values(["user_id", "event_id"])
    for k in (1, 5, 37, len(pdf) // 3):
        got = ev.where(O.kth_cut(ev, F.col("user_id"), F.col("event_id"), k)).toPandas()
        assert sorted(got["event_id"]) == sorted(pdf.head(k)["event_id"])


def test_kth_cut_of_wide_and_negative_keys_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(O, "FEW_ROWS", 50)
    values = [(i - 3000) * (1 << 40) for i in range(6000)] + [-(1 << 63), (1 << 63) - 1, 7, 7, 7] + [5] * 300
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, 10_000)], "v bigint, k bigint")
    order = sorted((v, i) for i, v in enumerate(values))
    for k in (1, 2, 2999, 3100, 3310, 6000, len(values) - 1, len(values)):
        got = df.where(O.kth_cut(df, F.col("v"), F.col("k"), k)).collect()
        assert sorted(map(tuple, got)) == order[:k]


def test_rows_without_a_position_are_in_the_tail(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "p bigint")
    assert SM.slice_by_position(df, "p", 2, "head").count() == 2
    assert sorted(r.p or 0 for r in SM.slice_by_position(df, "p", 2, "tail").collect()) == [0, 3]


def test_swap_of_rows_without_tokens(spark):
    df = spark.createDataFrame([(1, [], [1.0, 0.0]), (2, [4, 5], [0.0, 1.0])], "k bigint, ids array<int>, y array<double>")
    got = {r.k: r for r in SM.token_swap_mix(df, "k", "ids", "y").collect()}
    assert got[1].swap_frac == 0.0 and got[1].mixed_labels == [1.0, 0.0]


def test_blank_lines_of_any_white_space_shift_the_pairs(spark):
    from textprep.operators.relational import zip_align

    a = spark.createDataFrame([(0, "a0"), (1, "\t"), (2, "\u3000 "), (3, "a3")], "n bigint, text string")
    b = spark.createDataFrame([(0, "b0"), (1, "b1")], "n bigint, text string")
    assert sorted((r.src, r.tgt) for r in zip_align(a, b, "n").collect()) == [("a0", "b0"), ("a3", "b1")]


def test_text_lines_are_numbered_per_file_without_a_shuffle_of_lines(spark):
    from textprep.sources.files import read_text_lines, scratch_path

    path = scratch_path(spark, "numbered")
    spark.createDataFrame([(i, f"line {i}") for i in range(2000)], "i int, t string").coalesce(1).select("t").write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_text_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3  # the file is read in several splits
        assert sorted((r.line_no, r.line) for r in lines.collect()) == [(i, f"line {i}") for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_smoothed_bleu(spark):
    from textprep.operators.metrics import bleu_corpus

    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c d", "x b y d")], "k int, h string, r string")
    assert abs(bleu_corpus(df.where("k = 1"), "k", "h", "r", smooth=True).first()["bleu"] - 100.0) < 1e-9
    # matches 2 of 4, 0 of 3, 0 of 2, 0 of 1: the empty orders count 1/2, 1/4, 1/8
    want = 100 * (2 / 4 * (0.5 / 3) * (0.25 / 2) * (0.125 / 1)) ** 0.25
    assert abs(bleu_corpus(df.where("k = 2"), "k", "h", "r", smooth=True).first()["bleu"] - want) < 1e-9
    assert bleu_corpus(df.where("k = 2"), "k", "h", "r").first()["bleu"] == 0.0


def test_boosted_trees_learn_every_class(spark, monkeypatch):
    """All rows of the table and all ten classes, with few and shallow rounds (the given labels do not follow the vectors)."""
    from textprep.plans import q_models

    real = q_models.MO.boosted_trees
    monkeypatch.setattr(q_models.MO, "boosted_trees", lambda a, b, y: real(a, b, y, max_iter=2, max_depth=3))
    got = q_models._gbt(spark, SF001).collect()
    labels = [r.label for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("label").collect()]
    assert len(got) == -(-len(labels) // 5)
    assert {r.y for r in got} == {float(x) for x in labels} and len({r.prediction for r in got}) > 2
    apart = MO.assemble(spark.range(120).selectExpr("CAST(id % 4 AS DOUBLE) AS y", "id % 4 AS a", "id % 7 AS b"), ["a", "b"])
    assert all(r.y == r.prediction for r in real(apart, apart, "y", max_iter=2, max_depth=3).collect())


def test_tabular_prep_has_a_boosted_model(spark, monkeypatch):
    from textprep.plans import q_flows

    boosted, forest = q_flows.boosted_trees, q_flows.random_forest
    monkeypatch.setattr(q_flows, "boosted_trees", lambda a, b, y: boosted(a, b, y, max_iter=2, max_depth=3))
    monkeypatch.setattr(q_flows, "random_forest", lambda a, b, y, **k: forest(a, b, y, num_trees=2, max_depth=3))
    got = {r.model: r.accuracy for r in q_flows.tabular_prep(spark, SF001).collect()}
    assert set(got) == {"logreg", "tree", "forest", "boosted"} and got["boosted"] > 0.5
