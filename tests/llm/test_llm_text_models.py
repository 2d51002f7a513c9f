"""Language ID (op 5), token counts (op 8), Brown class LM (op 3), Kneser-Ney quality (op 10)."""

import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from textprep.llm import brown, langid, quality_kn, queries, token_counts
from textprep.llm.common import byte_table, ngram_hashes, text_slices, word_hashes


# --- hashing -----------------------------------------------------------------------------

def test_word_hashes_follow_the_words(monkeypatch):
    texts = ["a b a", "", "  ", "B\ta", "é x\n", "x" * 50 + " a", "a", "b"]
    for block in (1 << 21, 8):  # also with blocks far smaller than the texts
        monkeypatch.setattr("textprep.llm.common.BLOCK_BYTES", block)
        h, ptr = word_hashes(pa.array(texts), byte_table())
        assert list(np.diff(ptr)) == [len(t.split()) for t in texts]
        seen = dict(zip([w for t in texts for w in t.split()], h))
        assert [seen[w] for t in texts for w in t.split()] == list(h) and len(set(seen.values())) == len(seen)
    lower, _ = word_hashes(pa.array(["B. a"]), byte_table(lower=True, split_punctuation=True))
    plain, _ = word_hashes(pa.array(["b a"]), byte_table())
    assert list(lower) == list(plain)
    assert len(ngram_hashes(plain, 3)) == 0 and len(ngram_hashes(plain, 2)) == 1


def test_slices_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr("textprep.llm.common.SLICE_BYTES", 10)
    texts = ["aaaa", "é" * 3, "", "b" * 40, "", "c", "d", "e", "f"]
    whole = pa.record_batch([pa.array(range(-1, len(texts))), pa.array(["before", *texts])], ["k", "t"]).slice(1)
    parts = [(part.column(0).to_pylist(), got.to_pylist()) for part, got in text_slices(whole, whole.column(1), 3)]
    assert [t for _, got in parts for t in got] == texts and [k for ks, _ in parts for k in ks] == list(range(len(texts)))
    assert all(len(got) <= 3 and (len(got) == 1 or sum(len(t.encode()) for t in got) <= 10) for _, got in parts)
    assert list(text_slices(whole.slice(0, 0), whole.column(1).slice(0, 0))) == []


# --- language ID -------------------------------------------------------------------------

LANGS = {"xx": "abra kadabra simsala bim ", "yy": "quod erat demonstrandum ergo ", "zz": "жили были дед и баба "}


@pytest.fixture(scope="module")
def langs(spark):
    rows = [(f"{w * 3}{i}", k, "clash", 0.0) for k, w in LANGS.items() for i in range(20)]
    rows += [(None, "xx", "c", 0.0), ("", "yy", "c", 0.0), ("12 !?", "zz", "c", 0.0), ("abra", None, "c", 0.0)]
    return spark.createDataFrame(rows, "text string, lang string, lang_pred string, score double")


def test_langid_matches_brute_force(spark, langs, monkeypatch):
    model = langid.fit(langs, orders=2, bits=20)

    def grams(text):
        t = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower())
        return [t[i - k: i + 1] for i in range(len(t)) for k in (0, 1) if i - k >= 0 and t[i] != " "]

    train = [(r.text, r.lang) for r in langs.collect() if r.lang is not None]
    counts = {k: collections.Counter() for k in LANGS}
    for t, k in train:
        counts[k].update(grams(t))
    prior = collections.Counter(k for _, k in train)
    got = {(r.text, r.lang): r for r in langid.predict(langs, model).collect()}
    for (text, lang), r in got.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = {k: math.log(prior[k] / len(train)) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * (1 << 20))) for g in grams(text)) for k, c in counts.items()}
        best = max(z, key=z.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z.values()), abs=1e-3)
    texts = pa.array([t * 3 for t in LANGS.values()])
    whole = langid.log_scores(model, texts)
    for chars in (1, 2, 7, 16):  # texts in many pieces lose and repeat no n-gram
        monkeypatch.setattr(langid, "SEGMENT_CHARS", chars)
        assert langid.log_scores(model, texts) == pytest.approx(whole)


def test_langid_without_training_rows(spark, langs):
    model = langid.fit(langs.limit(0))
    assert {r.lang_pred for r in langid.predict(langs, model).collect()} == {"und"}
    assert langid.predict(langs.limit(0), langid.fit(langs)).count() == 0


def test_op5_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op5_langid(spark, SF01).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.98 * len(held)


# --- token counts ------------------------------------------------------------------------

def greedy(word, pieces, mark):
    out, at = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (mark if at else "") + word[at:end] in pieces:
                break
        else:
            return 1, 1
        out, at = out + 1, end
    return out, 0


def test_automaton_is_greedy_longest_match():
    rng = np.random.default_rng(5)
    for mark in ("##", ""):
        for _ in range(60):
            pieces = {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(12)}
            if mark:
                pieces = {p if rng.random() < 0.4 else mark + p for p in pieces}
            a = token_counts.build(sorted(pieces), mark)
            for _ in range(60):
                w = "".join(rng.choice(list("abcd"), rng.integers(1, 12), p=[0.32, 0.32, 0.32, 0.04]))
                n = a.count(w)
                assert (n & (token_counts.UNKNOWN - 1), n >> 32) == greedy(w, pieces, mark), (w, pieces)


def test_words_of_a_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 8)
    for text in ("ab a b", "abababababababab abab x", " lead and trail  ", "12345678 2345678", "1234567 2"):
        assert [w for words in token_counts._blocks(text) for w in words] == text.split()


def test_token_counts_rows(spark):
    pieces = {"▁", "a", "b", "ab", "▁ab", "▁a"}
    a = token_counts.build(pieces, "", "▁")
    texts = [None, "", " \t", "ab a b", "abababababababab abab x", "zz ab", "ab a b"]
    df = spark.createDataFrame([(t, 9, "r") for t in texts], "text string, n_tokens int, row string")
    got = token_counts.token_counts(df, a).collect()
    assert len(got) == len(texts)
    for r in got:
        want = [greedy("▁" + w, pieces, "") for w in (r.text or "").split()]
        assert (r.n_words, r.n_tokens, r.n_unknown, r.row) == (len(want), sum(x for x, _ in want), sum(u for _, u in want), "r")
    assert [r.n_unknown for r in token_counts.token_counts(df, token_counts.build([])).where("text = 'ab a b'").collect()] == [3, 3]
    clash = df.selectExpr("*", "1 AS _pad", "2 AS `a.b`")
    again = token_counts.token_counts(clash, a)
    assert {(r._pad, r["a.b"]) for r in again.collect()} == {(1, 2)}


def test_op8_against_brute_force(spark):
    pieces = set(token_counts.sentencepiece_pieces(queries.VOCABULARY))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op8_token_counts(spark, SF001).collect()
    assert len(got) == len(docs)
    memo = {}
    for r in got[:60]:
        want = [memo.setdefault(w, greedy("▁" + w, pieces, "")) for w in docs[r.doc_id].split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(want), sum(x for x, _ in want), sum(u for _, u in want))


# --- Brown class bigrams -----------------------------------------------------------------

@pytest.fixture(scope="module")
def two_tongues(spark):
    rng = np.random.default_rng(11)
    words = {k: [f"{k}{i}" for i in range(40)] for k in "uv"}
    rows = []
    for i in range(300):
        k = "uv"[i % 2]
        rows.append((i, " ".join(rng.choice(words[k], 30, p=np.arange(40, 0, -1) / 820)), "x", 1))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (None, "U1 new word", "x", 1), (3, rows[3][1], "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, n int").cache()


def test_class_model_is_a_distribution_and_beats_unigrams(spark, two_tongues):
    train = two_tongues.where("doc_id % 5 <> 0 and doc_id < 900")
    model = brown.fit(train, frequent=50, hot=30, n_classes=4)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    counts = {r.word: (r.ending, r.n) for r in model.counts.collect()}
    of_class = collections.defaultdict(list)
    for word, (ending, n) in counts.items():
        if word != 0:
            u = model.units.of(np.array([word]).astype(np.int64).view(np.uint64), np.array([ending]))[0]
            of_class[int(model.classes[u])].append(n)
    for c, ns in of_class.items():  # known words and one unknown share each class's probability
        total = (sum(ns) + brown.WORD_PRIOR * (len(ns) + 1)) / 10 ** model.class_norm[c]
        assert total == pytest.approx(1)
    got = brown.score(two_tongues, model, ["doc_id"]).collect()
    assert len(got) == two_tongues.count()
    held = [r for r in got if r.row.doc_id is not None and r.row.doc_id % 5 == 0 and r.row.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.unigram_score for r in held)


def test_exchange_raises_the_likelihood(spark, two_tongues):
    seen = []
    real = brown.exchange

    def spy(*a, **k):
        out = real(*a, **k)
        seen.append(out[2])
        return out

    brown.exchange = spy
    try:
        brown.fit(two_tongues, frequent=100, hot=100, n_classes=4)
    finally:
        brown.exchange = real
    assert seen[0] == sorted(seen[0]) and seen[0][-1] > seen[0][0]


def test_moves_of_a_packed_row_take_bounded_memory_and_skip_the_other_half():
    """A packed row may hold 65,536 units: judging them at once took units x classes several times over."""
    rng = np.random.default_rng(5)
    k, n = 65, 1 << 16
    cols = [np.arange(n), np.ones(n), rng.integers(0, n, n), rng.integers(1, 9, n)]
    packed = pa.RecordBatch.from_arrays(
        [pa.array([c.astype(kind).tobytes()], pa.binary()) for c, kind in zip(cols, brown._PACKED.values())], list(brown._PACKED))
    shared = type("Shared", (), {"value": (rng.integers(0, k - 1, n).astype(np.uint8), rng.random((k, k)) * 100)})
    tracemalloc.start()
    try:
        moves = [pa.Table.from_batches(brown._best_moves(shared, k, half)(iter([packed]))) for half in (0, 1)]
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert [m["unit"].to_pylist() for m in moves] == [list(range(half, n, 2)) for half in (0, 1)]


def test_exchange_leaves_the_arrow_setting_and_sends_few_packed_rows_at_once(spark, two_tongues, monkeypatch):
    seen, real = [], brown.arrow_rows
    monkeypatch.setattr(brown, "arrow_rows", lambda s, rows: seen.append(rows) or real(s, rows))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    brown.fit(two_tongues, frequent=20, hot=20, n_classes=3, rounds=1)
    assert seen and max(seen) <= 4 and spark.conf.get(key, None) == before


@pytest.mark.parametrize("ranges", [1, 7])
def test_packed_bigrams_equal_counted_pairs_and_keep_a_unit_together(monkeypatch, ranges):
    """However few pairs a task holds and however few rows are packed into one."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in rng.integers(0, 40, 60)]
    known, _ = word_hashes(pa.array([f"w{x}" for x in range(20)]), byte_table(lower=True))
    units = brown.Units(np.sort(known))
    counted = collections.Counter()
    for t in texts:
        words, ptr, endings = brown.words_with_endings(pa.array([t]), byte_table(lower=True))
        u = [units.end, *units.of(words, endings).tolist(), units.end]
        for x, y in zip(u, u[1:]):
            counted[x, 1, y] += 1
            counted[y, 0, x] += 1
    shared = type("Shared", (), {"value": units})
    classes = np.arange(units.end + 1) % 4
    seen = []
    for pairs, size in ((1, 1), (50, 7), (1 << 21, 1 << 16)):
        monkeypatch.setattr(brown, "TASK_PAIRS", pairs)
        monkeypatch.setattr(brown, "FOLD_PAIRS", pairs)
        monkeypatch.setattr(brown, "PACK_ROWS", size)
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[a: a + 7])], ["text"]) for a in range(0, len(texts), 7)]
        dealt = pa.Table.from_batches(brown._count_bigrams(shared, ranges)(batches)).sort_by("part")
        packed = list(brown._merge(shared)(dealt.to_batches(max_chunksize=3)))
        rows = [r for cols in brown._unpacked(packed) for r in zip(*(c.tolist() for c in cols))]
        assert {(u, int(f), o): n for u, f, o, n in rows} == counted and len(rows) == len(counted)
        moves = brown._best_moves(type("Shared", (), {"value": (classes, np.ones((5, 5)))}), 5)(iter(packed))
        seen.append(pa.Table.from_batches(moves).sort_by("unit").to_pydict())
        assert len(set(seen[-1]["unit"])) == len(seen[-1]["unit"])
    for other in seen[1:]:
        assert all(other[c] == seen[0][c] for c in ("unit", "best", "mass")) and other["gain"] == pytest.approx(seen[0]["gain"])


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_scores_by_brute_force(spark, two_tongues, hot):
    """Any share of counts may come by the join: the scores are the same sums."""
    train = two_tongues.where("doc_id < 100")
    model = brown.fit(train, frequent=20, hot=max(hot, 20), n_classes=3, rounds=2)
    if hot < 20:  # the mapping keeps its 20 words, the broadcast counts shrink
        model.hot, model.hot_count = model.hot[:hot], model.hot_count[:hot]
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(w for r in train.collect() for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)

    def unit(word):
        if word is None:
            return model.units.end
        h, ptr = word_hashes(pa.array([word.decode()]), byte_table(lower=True))
        ending = word[-1] + (word[-2] << 8 if len(word) > 1 else 0)
        return int(model.units.of(h, np.array([ending]))[0])

    for r in brown.score(two_tongues, model, ["doc_id", "text"]).collect():
        words = tokens(r.row.text)
        assert (r.n_tokens, r.n_known) == (len(words), sum(c[w] > 0 for w in words))
        assert r.unigram_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        classes = [int(model.classes[unit(w)]) for w in [None, *words]]
        want = sum(model.transition[a, b] for a, b in zip(classes, classes[1:]))
        want += sum(math.log10(c[w] + brown.WORD_PRIOR) - model.class_norm[k] for w, k in zip(words[:-1], classes[1:]))
        assert r.score == pytest.approx(want)


def test_every_word_above_a_small_count_is_a_unit(spark):
    """Also words far outside the most frequent ones and with one ending are told apart by their neighbours."""
    n_words, text = 9000, []
    for i in range(n_words):  # equal endings, two kinds of neighbours; more words than were units before
        text.append(" ".join([("a", "b")[i % 2], f"{i}xx", ("c", "d")[i % 2]] * 5))
    docs = spark.createDataFrame([(t,) for t in text] + [("once seen",)], "text string")
    model = brown.fit(docs, n_classes=8)
    assert len(model.units.frequent) == n_words + 4
    h, _ = word_hashes(pa.array([f"{i}xx" for i in range(n_words)]), byte_table(lower=True))
    units = model.units.of(h, np.full(n_words, ord("x") * 257))
    assert len(set(units.tolist())) == n_words and units.max() < len(model.units.frequent)
    classes = model.classes[units]
    assert not set(classes[::2].tolist()) & set(classes[1::2].tolist())
    rare, _ = word_hashes(pa.array(["once"]), byte_table(lower=True))
    assert model.units.of(rare, np.array([7]))[0] == len(model.units.frequent) + 7


def test_class_model_without_training_text(spark, two_tongues):
    model = brown.fit(two_tongues.limit(0))
    got = brown.score(two_tongues, model, ["doc_id"]).collect()
    assert len(got) == two_tongues.count() and all(r.n_known == 0 and math.isfinite(r.score) and r.unigram_score == 0 for r in got)
    assert brown.score(two_tongues.limit(0), model, ["doc_id"]).count() == 0


# --- Kneser-Ney --------------------------------------------------------------------------

def kneser_ney(texts):
    """Plain interpolated modified Kneser-Ney trigrams; returns log10 p of a token list."""
    seqs = [["<", *t.encode().lower().split(), ">"] for t in texts]
    raw = {n: collections.Counter(tuple(s[i: i + n]) for s in seqs for i in range(len(s) - n + 1)) for n in (1, 2, 3)}
    adj = {3: raw[3]}
    for n in (2, 1):
        before = collections.Counter(g[1:] for g in raw[n + 1])
        adj[n] = {g: (c if g[0] == "<" else before.get(g, c)) for g, c in raw[n].items() if g != ("<",)}
    disc = {}
    for n in (1, 2, 3):
        k = collections.Counter(adj[n].values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        d = [1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        disc[n] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
    context = {}
    for n in (1, 2, 3):
        for g, a in adj[n].items():
            s = context.setdefault((n, g[:-1]), [0, 0.0])
            s[0] += a
            s[1] += disc[n][min(a, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(adj[1]) + 1)
        if (n, g[:-1]) not in context:
            return p(g[1:])
        total, freed = context[(n, g[:-1])]
        a = adj[n].get(g, 0)
        return ((a - disc[n][min(a, 3) - 1]) if a else 0) / total + freed / total * p(g[1:])

    def score(text):
        s = ["<", *text.encode().lower().split(), ">"]
        return sum(math.log10(p(tuple(s[max(0, i - 2): i + 1]))) for i in range(1, len(s))), len(s) - 1

    return score


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_kneser_ney_by_brute_force(spark, hot):
    rng = np.random.default_rng(2)
    make = lambda: " ".join(rng.choice([f"w{i}" for i in range(12)], rng.integers(1, 25), p=np.arange(12, 0, -1) / 78))
    train = [make() for _ in range(60)]
    want = kneser_ney(train)
    model = quality_kn.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    texts = [make() for _ in range(30)] + ["", "unseen words only", "w1 unseen W2 w3", *train[:5]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id int, text string")
    got = {r.row.doc_id: r for r in quality_kn.score(docs, model, ["doc_id"], hot=hot, bloom_bits=1 << 14).collect()}
    for i, t in enumerate(texts):
        s, n = want(t)
        assert got[i].n_tokens == n and got[i].log10_prob == pytest.approx(s, abs=1e-6)
    assert got[99].log10_prob == pytest.approx(want("")[0])


def test_quality_keeps_clean_and_drops_junk(spark):
    got = {r.doc_id: r for r in queries.op10_quality_kn(spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    good = [got[r.doc_id].keep for r in labels if r.quality == 1]
    junk = [got[r.doc_id].keep for r in labels if r.quality == 0]
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.2


def test_training_sample_holds_what_the_bounds_allow(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 400).alias("text"))
    ids = quality_kn.training_ids(docs, spark.range(3000), "doc_id", "text", quality_kn.MAX_TRAIN_DOCS, quality_kn.MAX_TRAIN_WORDS)
    assert ids.distinct().count() == 3000


def test_quality_without_trusted_text(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "en"), (None, "c", "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_kn.classify(docs, labels, ["doc_id"]).collect()
    assert len(got) == 3 and all(r.keep and r.threshold is None for r in got)
    assert quality_kn.classify(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_quality_learns_from_all_trusted_texts(spark, monkeypatch):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('w', id % 50, ' x') AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    learned, fit = [], quality_kn.fit
    monkeypatch.setattr(quality_kn, "fit", lambda texts, col: learned.append(texts.count()) or fit(texts, col))
    assert quality_kn.classify(docs, labels, ["doc_id"]).count() == 6000
    assert learned == [quality_kn.trusted_ids(labels).where("not judge").count()] and learned[0] > quality_kn.MAX_TRAIN_DOCS
