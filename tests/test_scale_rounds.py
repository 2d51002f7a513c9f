"""Operators that stay small in a task: BLEU, map-side look-up, JSON lines, masking, the words that are encoded."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textprep.operators import metrics, vocab as V
from textprep.operators.sampling import mask_tokens
from textprep.sources import files as FS


def _grams(words, n):
    return [None, None] if words is None else [tuple(words[i: i + n]) for i in range(len(words) - n + 1)]


def _bleu(groups):
    num, den, c, r = [0] * 4, [0] * 4, 0, 0
    for pairs in groups:
        for n in range(1, 5):
            h, f = (Counter(g for p in pairs for g in _grams(p[side], n)) for side in (0, 1))
            num[n - 1] += sum(min(k, f[g]) for g, k in h.items())
            den[n - 1] += sum(h.values())
        c, r = c + sum(len(p[0] or ()) for p in pairs), r + sum(len(p[1] or ()) for p in pairs)
    return (math.exp(1 - r / c) if c < r else 1.0) * math.exp(sum(math.log(a / b) for a, b in zip(num, den)) / 4)


def test_bleu_equals_brute_force_with_repeated_and_null_keys(spark):
    rows = [(i % 7 if i % 11 else None, "a b c d e f " * (i % 4) + f"w{i % 3}", "a b c d e x " * (i % 3) + f"w{i % 5}") for i in range(60)]
    rows += [(100, None, None), (101, "", "a b"), (102, "a b\tc", "a b c"), (None, None, "z")]
    groups = {}
    for k, h, r in rows:
        groups.setdefault(k, []).append((h if h is None else h.split(), r if r is None else r.split()))
    df = spark.createDataFrame(rows, "k int, h string, r string").repartition(5)
    assert metrics.bleu_corpus(df, "k", "h", "r").first()["bleu"] == pytest.approx(_bleu(groups.values()), abs=1e-12)
    assert metrics.bleu_corpus(df.where("k > 1000"), "k", "h", "r").first()["bleu"] == 0.0


def test_bleu_keeps_no_table_of_ngrams(spark):
    df = spark.createDataFrame([(1, "a b", "a b")], "k int, h string, r string")
    plan = metrics.bleu_corpus(df, "k", "h", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_look_up_takes_a_batch_in_slices_of_entries():
    lists = [[1] * 5, None, [], [2] * 30, [3], [4, 5], [6] * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], ["k", "l"])
    parts = list(V._entry_slices(batch, 10))
    assert [x for p in parts for x in p.column(1).to_pylist()] == lists
    assert all(p.num_rows == 1 or sum(len(x or ()) for x in p.column(1).to_pylist()) <= 10 for p in parts)
    assert list(V._entry_slices(batch.slice(0, 0), 10)) == []


def test_decode_gives_the_same_for_any_slice(spark, monkeypatch):
    vocab = spark.createDataFrame([("[PAD]", 0), ("a", 4), ("b", 5)], "token string, id int")
    df = spark.createDataFrame([(1, [4, 5, 0, 4]), (2, None), (3, []), (4, [0, 0]), (5, [9, 5])], "k int, ids array<int>").coalesce(1)
    want = {1: "a b a", 2: "", 3: "", 4: "", 5: "b"}
    for entries in (1, 2, 100):
        monkeypatch.setattr(V, "LOOK_UP_ENTRIES", entries)
        got = {r["k"]: r["text"] for r in V.decode_ids(df, "k", "ids", vocab).collect()}
        assert {k: v or "" for k, v in got.items()} == want


def test_json_lines_are_gzipped(spark):
    df = spark.createDataFrame([(i, [("word", ["other"])] * 200) for i in range(50)], "i int, a array<struct<current_syllable:string, alternative_syllables:array<string>>>")
    path = FS.scratch_path(spark, "rows-jsonl")
    FS.write_jsonl(df.coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    assert files and all(r["path"].endswith(".gz") for r in files) and sum(r["length"] for r in files) < 50_000
    assert sorted(FS.read_jsonl(spark, path, df.schema).collect()) == sorted(df.collect())


def test_first_words_hold_the_first_pieces(spark):
    texts = ["", None, "   ", "[SOS] one two![EOS] three", "x" * 50 + " !? y", "\n a.b,c  d　e", "![SOS]a [PAD][UNK]b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for specials in ((), V.DEFAULT_SPECIALS):
        for n in (1, 2, 3, 64):
            cut = F.slice(V.pretokenize_words(V.first_words(F.col("t"), n, specials), specials), 1, n)
            whole = F.slice(V.pretokenize_words(F.col("t"), specials), 1, n)
            assert df.where(~cut.eqNullSafe(whole)).count() == 0
    long = spark.createDataFrame([("one two " * 50_000,)], "t string")
    assert long.select(F.length(V.first_words(F.col("t"), 64))).first()[0] < 300


def test_masked_places_are_those_with_the_smallest_draws(spark):
    import hashlib

    rows = [(k, " ".join(f"w{i}" for i in range(k * 3))) for k in range(0, 40)] + [(99, None)]
    got = {r["k"]: r["m"] for r in mask_tokens(spark.createDataFrame(rows, "k int, t string"), "t", "k", "m", 0.3, 5).collect()}
    for k, text in rows:
        words = (text or "").split()
        draw = {i: (int(hashlib.md5(f"{k}|{i}|5".encode()).hexdigest()[:8], 16), i) for i in range(len(words))}
        first = sorted(draw, key=draw.get)[: max(1, int(len(words) * 0.3))]
        assert got[k] == (text if not words else " ".join("[MASK]" if i in first else w for i, w in enumerate(words)))
