"""Vocabulary trainers against the `tokenizers` package on a toy corpus."""

import pytest

from conftest import SF001
from textprep.operators import vocab as V

tokenizers = pytest.importorskip("tokenizers")

CORPUS = ["low lower lowest newer newest wider widest", "the lower wall was newer than the low wall",
          "hug hugs pug pugs pun bun buns", "a aa aaa aaaa b bb abab"] * 3


def _counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "i int, text string")
    return V.word_table(df, "text")


def test_bpe_matches_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    specials = ["[PAD]", "[UNK]", "[SOS]", "[EOS]"]
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(CORPUS, trainers.BpeTrainer(vocab_size=60, special_tokens=specials, show_progress=False))
    expected = tok.get_vocab()
    vocab, merges = V.bpe_train(_counts(spark), 60, specials, candidates=8)
    got = {r["token"]: r["id"] for r in vocab.collect()}
    assert got == expected


def test_wordpiece_token_set_matches_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    specials = ["[PAD]", "[UNK]", "[SOS]", "[EOS]"]
    tok = Tokenizer(models.WordPiece(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(CORPUS, trainers.WordPieceTrainer(vocab_size=70, special_tokens=specials, show_progress=False))
    vocab, _ = V.wordpiece_train(_counts(spark), 70, specials)
    ours = {r["token"] for r in vocab.collect()}
    theirs = set(tok.get_vocab())
    # the library numbers '##' symbols in hash-map order, so equal-count merges are
    # tie-broken arbitrarily there; the alphabet and the size are deterministic
    alpha = lambda s: {t for t in s if len(t) == 1 or (t.startswith("##") and len(t) == 3)}
    assert alpha(ours) == alpha(theirs)
    assert len(ours) == len(theirs)


def test_wordlevel_order(spark):
    vocab = {r["token"]: r["id"] for r in V.wordlevel_train(_counts(spark), 10).collect()}
    assert vocab["[PAD]"] == 0 and vocab["[UNK]"] == 1
    assert len(vocab) == 10


def test_unigram_invariants(spark):
    counts = _counts(spark)
    vocab = V.unigram_train(counts, 40)
    toks = {r["token"] for r in vocab.collect()}
    chars = {c for line in CORPUS for c in line if not c.isspace()}
    assert chars <= toks and len(toks) == 40
    df = spark.createDataFrame([(0, "lowest newer")], "i int, text string")
    enc = V.subword_encode(df, "i", "text", vocab, "unigram").collect()[0]["ids"]
    assert enc and 1 not in enc


def test_subword_bpe_encode_roundtrip(spark):
    vocab, merges = V.bpe_train(_counts(spark), 60)
    df = spark.createDataFrame([(0, "lowest newer wall")], "i int, text string")
    ids = V.subword_encode(df, "i", "text", vocab, "bpe", merges).collect()[0]["ids"]
    inv = {r["id"]: r["token"] for r in vocab.collect()}
    assert "".join(inv[i] for i in ids) == "lowestnewerwall"


def test_markers_stay_whole_and_bracket_pieces_are_kept(spark):
    df = spark.createDataFrame([(0, "[SOS] lowest newer [EOS]"), (1, "[[ low"), (2, "")], "i int, text string")
    counts = _counts(spark).unionByName(spark.createDataFrame([("[[", 50)], "word string, count bigint"))
    vocab, merges = V.bpe_train(counts, 80)
    got = {r["i"]: r["ids"] for r in V.subword_encode(df, "i", "text", vocab, "bpe", merges).collect()}
    inv = {r["id"]: r["token"] for r in vocab.collect()}
    assert got[0][0] == 2 and got[0][-1] == 3 and "".join(inv[i] for i in got[0][1:-1]) == "lowestnewer" and got[2] == []
    uni = V.unigram_train(counts, 60)
    inv = {r["id"]: r["token"] for r in uni.collect()}
    got = {r["i"]: r["ids"] for r in V.subword_encode(df, "i", "text", uni, "unigram").collect()}
    assert inv[got[1][0]] == "[[" and got[0][0] == 2 and got[0][-1] == 3


def test_sentencepiece_form_round_trips(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS[:4])], "i int, text string")
    vocab, merges = V.bpe_train(V.sentencepiece_words(df, "text"), 60, ["[PAD]", "[UNK]", "[SOS]", "[EOS]"])
    inv = {r["id"]: r["token"] for r in vocab.collect()}
    for r in V.subword_encode(df, "i", "text", vocab, "bpe", merges, word_mark="\u2581").collect():
        assert "".join(inv[x] for x in r["ids"]).replace("\u2581", " ").strip() == CORPUS[r["i"]]


def test_merges_from_the_left():
    import numpy as np

    from textprep.operators.bpe import apply_merge

    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(0, 3, 30).astype(np.int32)
        a, b = rng.integers(0, 3, 2)
        want, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                want.append(9)
                i += 2
            else:
                want.append(int(s[i]))
                i += 1
        assert apply_merge(s, a, b, 9).tolist() == want


def test_translation_prep_trains_at_the_references_size(spark, monkeypatch):
    from textprep.plans import q_flows

    sizes, real = [], q_flows.bpe_train

    def small(words, size, specials):
        sizes.append(size)
        return real(words, 300, specials)

    monkeypatch.setattr(q_flows, "bpe_train", small)
    q_flows.translation_prep(spark, SF001)
    assert sizes == [5000, 5000]


def test_map_side_lookup_equals_join(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [(1, ["b", "a", "é", "zz", None]), (2, []), (3, None), (4, ["日本", "a", "a"]), (5, ["zz"])]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("é", 7), ("日本", 6), ("[UNK]", 1)], "token string, id int")
    results = []
    for most in (V.MAP_SIDE_ROWS, 0):
        monkeypatch.setattr(V, "MAP_SIDE_ROWS", most)
        enc = V.encode_tokens(df, "k", "t", vocab)
        dec = V.decode_ids(enc, "k", "ids", vocab)
        results.append((sorted(map(tuple, enc.collect())), sorted(map(tuple, dec.collect()))))
    assert results[0] == results[1]
    assert results[0][0] == [(1, [5, 4, 7, 1, 1]), (2, []), (3, []), (4, [6, 4, 4]), (5, [1])]
    assert results[0][1] == [(1, "b a é"), (2, ""), (3, ""), (4, "日本 a a"), (5, "")]
    empty = V.encode_tokens(df.where(F.col("k") < 0), "k", "t", vocab.where("id < 0"))
    assert empty.count() == 0


def test_word_encoders_need_no_exchange(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, text string")
    vocab = spark.createDataFrame([("a", 4)], "token string, id int")
    enc = V.wordlevel_encode(df, "k", "text", vocab, 3)
    assert "Exchange" not in enc._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, enc.collect())) == [(1, [4, 1, 0], [1, 1, 0]), (2, [0, 0, 0], [0, 0, 0])]
