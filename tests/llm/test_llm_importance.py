"""Importance resampling (op 13) against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textprep.llm import importance, queries

DOCS = "doc_id bigint, text string, `n_words` string, `a.b` int, `row` string, weight int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, orders):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i: i + k]).encode()) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, orders=1, buckets=10_000, percent=10, least=20):
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text, orders):
                held[f % buckets] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for d in docs:
        f = features(d[1], orders)
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in f)
        out.append([d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(d[1]))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def some_docs():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["über", "Straße", "ÉTÉ", "日本", "a", "ab", "abc", "b"]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))), "x", 1, "y", 2) for i in range(120)]
    docs += [(500, "A-b_c\x00d\x7fe\tF.G 9:z{y", "x", 1, "y", 2), (501, None, "x", 1, "y", 2), (502, "", None, None, None, None), (503, "?!", "x", 1, "y", 2)]
    docs += [(None, " ".join(["w1"] * 30), "x", 1, "y", 2)] * 2 + [(7, docs[7][1], "x", 1, "y", 2)] * 3  # repeated rows
    docs += [(600 + i, "same words here again " * 6, "x", 1, "y", 2) for i in range(5)]
    docs += [(700, " ".join(f"long{i % 999}" for i in range(60_000)) + " " + "x" * 300_000 + " end", "x", 1, "y", 2)]
    return docs


TARGET = ["w1 w2 w3 über straße", "w1 w5 ab ABC b 日本", None, "", "new words of the target only w1 w1"]


@pytest.mark.parametrize("orders, buckets, hot", [(1, 10_000, 1 << 16), (2, 97, 40), (3, 100_000, 0)])
def test_equals_plain_python(spark, orders, buckets, hot):
    docs = some_docs()
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(spark.createDataFrame(docs, DOCS).repartition(3), target, "doc_id", ["doc_id", "a.b", "row", "n_words"], orders=orders, buckets=buckets, dictionary_words=hot)
    rows = got.select("row.doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(brute(docs, TARGET, orders, buckets), key=key)


def test_joined_crc_is_the_crc_of_joined_bytes():
    rng = np.random.default_rng(1)
    pairs = [(rng.bytes(int(rng.integers(0, 9))), rng.bytes(int(n))) for n in [0, 1, 2, 3, 255, 256, 70_000, *rng.integers(0, 400, 60)]]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = importance.joined_crc(crc([a for a, _ in pairs]), crc([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_payloads_do_not_depend_on_the_dictionary():
    texts = pa.array([d[1] or "" for d in some_docs()])
    all_words = sorted({w.encode() for d in some_docs() for w in words_of(d[1])})
    want = [zlib.crc32(w.encode()) for d in some_docs() for w in words_of(d[1])]
    for hot in ([], all_words[::3], all_words):
        automaton = importance._automaton(f"test{len(hot)}", hot)
        crc, length, of = importance.payloads(texts, automaton, np.array([zlib.crc32(w) for w in hot], np.uint32), np.array([len(w) for w in hot], np.int64))
        assert crc.tolist() == want and len(length) == len(of) == len(want)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(some_docs(), DOCS), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none, "doc_id", ["doc_id"]).collect() == []
    got = importance.resample(docs, none, "doc_id", ["doc_id"]).select("row.doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(brute(some_docs(), []), key=key)


def test_query_draws_a_tenth(spark):
    from conftest import SF001

    got = queries.op13_importance(spark, SF001)
    ranks = [r["rank"] for r in got.where(F.col("rank").isNotNull()).orderBy("rank").collect()]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert ranks == list(range(1, sum(len(words_of(d.text)) >= 20 for d in docs) // 10 + 1)) and got.count() == len(docs)
