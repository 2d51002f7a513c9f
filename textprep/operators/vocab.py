"""§2.11 vocabulary learning and encoding as Spark jobs.

The corpus is reduced once to a distinct-word table ``(word, count)`` by a
partial + final hash aggregate; every trainer then works on that table, which
stays distributed.  The driver only holds what the model itself is: the
vocabulary (bounded by ``vocab_size``) and, per BPE round, a bounded list of the
best candidate pairs.

BPE / WordPiece are trained in ``textprep.operators.bpe``, Unigram in
``textprep.operators.unigram``.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.functions.arrays import attention_mask, pad_truncate
from textprep.functions.text import SPACE_CHARS, WORD, WORD_CHARS, java, split_whitespace
from textprep.operators import bpe, unigram
from textprep.operators.relational import checked_broadcast, measured
from textprep.session import ensure_checkpoint_dir

WHITESPACE_PIECE = f"{WORD}+|[^{WORD_CHARS}{SPACE_CHARS}]+"
MAX_PIECE = 16  # characters of a Unigram piece
MAP_SIDE_ROWS, MAP_SIDE_BYTES = 500_000, 32 << 20  # a vocabulary that every task may hold
LOOK_UP_ENTRIES = 1 << 18  # list entries that a task looks up at a time
DEFAULT_SPECIALS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]")


def pretokenize_words(text: Column, specials: Sequence[str] = ()) -> Column:
    """The ``Whitespace`` pre-tokenizer: word runs or runs of other non-space chars.
    ``specials`` are matched first and kept whole (added special tokens)."""
    return F.regexp_extract_all(text, F.lit(java(piece_pattern(specials))), 0)


def piece_pattern(specials: Sequence[str] = ()) -> str:
    return "".join(re.escape(s) + "|" for s in specials) + WHITESPACE_PIECE


def first_words(text: Column, n: int, specials: Sequence[str] = ()) -> Column:
    """The start of the text up to its ``n``-th piece, so that the rest is not cut into pieces for nothing."""
    piece = "".join(re.escape(s) + "|" for s in specials) + f"{WORD}++|[^{WORD_CHARS}{SPACE_CHARS}]++"
    return F.regexp_extract(text, java(f"^(?:[{SPACE_CHARS}]*+(?:{piece})){{0,{n}}}+"), 0)


def word_table(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct words with corpus counts (``word``, ``count``)."""
    words = df.select(F.explode(pretokenize_words(F.col(text_col))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


# --- word level ---------------------------------------------------------------

def wordlevel_train(counts: DataFrame, vocab_size: int, specials: Sequence[str] = DEFAULT_SPECIALS,
                    min_frequency: int = 0) -> DataFrame:
    """Specials first, then words by count desc, token asc, up to ``vocab_size``.
    The top-k is a ``TakeOrderedAndProject`` (bounded by ``vocab_size``)."""
    spark = counts.sparkSession
    k = max(vocab_size - len(specials), 0)
    body = counts.where(~F.col("word").isin(list(specials)))
    if min_frequency > 0:
        body = body.where(F.col("count") >= min_frequency)
    top = body.orderBy(F.col("count").desc(), F.col("word").asc()).limit(k)
    # k rows at most: numbering them with one window is bounded by vocab_size
    ranked = top.select(
        F.col("word").alias("token"),
        (F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("word").asc())) - 1 + len(specials)).cast("int").alias("id"),
    )
    sp = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, id int")
    return sp.unionByName(ranked)


class _Dictionary:
    """A bounded two-column table, sorted by one of them, held in the task.  Each list's entries are looked up by
    binary search, once per distinct entry of a batch, straight on the Arrow buffers."""

    def __init__(self, table: pa.Table, by: str, give: str):
        self.by, self.give = table.column(by).combine_chunks(), table.column(give).combine_chunks()
        self.sorted = np.asarray(self.by.cast(pa.binary()).to_pylist(), dtype=object) if pa.types.is_string(self.by.type) else self.by.to_numpy()

    def find(self, flat: pa.Array) -> pa.Array:
        """The given column's value of each entry; null where the dictionary has none."""
        if not len(self.by) or not len(flat):
            return pa.nulls(len(flat), self.give.type)
        coded = flat.dictionary_encode()
        words = coded.dictionary
        probe = np.asarray(words.cast(pa.binary()).to_pylist(), dtype=object) if pa.types.is_string(words.type) else words.to_numpy()
        at = np.minimum(np.searchsorted(self.sorted, probe), len(self.by) - 1)
        rows = pa.array(at, mask=self.sorted[at] != probe)
        return self.give.take(rows.take(coded.indices))


def _entry_slices(batch: pa.RecordBatch, entries: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists (column 1) hold at most ``entries`` entries; a longer list is alone."""
    n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    ends, at = np.cumsum(n), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + entries, "right")))
        yield batch.slice(at, to - at)
        at = to


def _look_up(df: DataFrame, key: str, lists: str, table: pa.Table, by: str, give: str, out: str, out_type: str,
             default: int | None = None, skip: Sequence[int] = ()) -> DataFrame:
    """Rows (key, list of the entries' values) without an exchange; entries in ``skip`` go."""
    sent = df.sparkSession.sparkContext.broadcast(table.sort_by(by))  # within MAP_SIDE_ROWS and MAP_SIDE_BYTES
    rows = df.select(F.col(key), F.col(lists).alias("_list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Dictionary(sent.value, by, give)
        for batch in (part for whole in batches for part in _entry_slices(whole, LOOK_UP_ENTRIES)):
            col = batch.column(1)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
            flat = col.flatten()
            ends = np.cumsum(n)
            if skip:
                kept = pc.invert(pc.is_in(flat, pa.array(list(skip), flat.type)))
                ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[ends]
                flat = flat.filter(kept)
            found = known.find(flat)
            if default is not None:
                found = pc.fill_null(found, default)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, found)], [key, out])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField(out, T._parse_datatype_string(out_type))]))


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, unk_id: int = 1, out: str = "ids",
                  length: int | None = None) -> DataFrame:
    """Token arrays -> id arrays (unknown or null -> ``unk_id``), order kept; with ``length`` only
    the first tokens are looked up, as only they are kept later.  A null array gives an empty one.

    A vocabulary within the broadcast bounds is looked up in the map task; a larger one is joined
    (posexplode, join by token, ordered regroup by the row key: one group = one row's tokens)."""
    toks = F.col(tokens) if length is None else F.slice(F.col(tokens), 1, length)
    vocab, fits = measured(vocab.select("token", "id"), MAP_SIDE_ROWS, MAP_SIDE_BYTES)
    if fits:
        rows = df.select(F.col(key), toks.alias("_t"))
        return _look_up(rows, key, "_t", vocab.toArrow(), "token", "id", out, "array<int>", default=unk_id)
    # Hash-partition the token *arrays* by row key first: explode keeps that partitioning, and
    # posexplode_outer keeps rows without tokens (one null entry, skipped below).
    ex = df.select(key, toks.alias("_t")).repartition(key).select(key, F.posexplode_outer("_t").alias("pos", "token"))
    joined = ex.join(vocab, "token", "left")
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unk_id)).alias("id")))
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    return grouped.select(key, F.col("_p.id").cast("array<int>").alias(out))


def wordlevel_encode(df: DataFrame, key: str, text_col: str, vocab: DataFrame, length: int,
                     unk_id: int = 1, specials: Sequence[str] = ()) -> DataFrame:
    """Whitespace pre-tokenize, look up ids, truncate / pad to ``length`` + mask."""
    toks = df.select(key, pretokenize_words(F.col(text_col), specials).alias("_toks"))
    enc = encode_tokens(toks, key, "_toks", vocab, unk_id, "_raw", length)
    return enc.select(key, pad_truncate(F.col("_raw"), length).alias("ids"),
                      attention_mask(F.col("_raw"), length).alias("mask"))


def decode_ids(df: DataFrame, key: str, ids: str, vocab: DataFrame, skip_ids: Sequence[int] = (0, 1, 2, 3),
               continuation: str | None = None, out: str = "text") -> DataFrame:
    """Ids -> text joined by spaces; special ids skipped; ``continuation`` (e.g.
    ``##``) pieces are glued to the previous piece."""
    vocab, fits = measured(vocab.select("id", "token"), MAP_SIDE_ROWS, MAP_SIDE_BYTES)
    if fits:
        pieces = _look_up(df, key, ids, vocab.toArrow(), "id", "token", "_p", "array<string>", skip=skip_ids)
        words = F.col("_p")
    else:
        ex = df.repartition(key).select(key, F.posexplode_outer(F.col(ids)).alias("pos", "id"))
        ex = ex.withColumn("pos", F.when(~F.col("id").isin(list(skip_ids)), F.col("pos")))  # a row of skipped ids stays
        joined = ex.join(vocab, "id", "left")
        entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "token"))
        pieces = joined.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
        words = F.col("_p.token")
    text = F.array_join(words, " ")
    if continuation:
        text = F.regexp_replace(text, F.lit(" " + re.escape(continuation)), F.lit(""))
    return pieces.select(key, text.alias(out))


# --- BPE / WordPiece ----------------------------------------------------------------

def bpe_train(counts: DataFrame, vocab_size: int, specials: Sequence[str] = DEFAULT_SPECIALS, **kw):
    """Train BPE merges to ``vocab_size`` (``textprep.operators.bpe``)."""
    return bpe.bpe_train(counts, vocab_size, specials, **kw)


def sentencepiece_words(df: DataFrame, text_col: str, mark: str = "\u2581") -> DataFrame:
    """Distinct white-space words with the word mark in front: training on them gives the
    SentencePiece form, whose pieces say where a word begins."""
    words = df.select(F.explode(split_whitespace(F.col(text_col))).alias("w"))
    return words.groupBy(F.concat(F.lit(mark), "w").alias("word")).agg(F.count(F.lit(1)).alias("count"))


def wordpiece_train(counts: DataFrame, vocab_size: int, specials: Sequence[str] = DEFAULT_SPECIALS, **kw):
    return bpe_train(counts, vocab_size, specials, continuing_prefix="##", **kw)


# --- Unigram ---------------------------------------------------------------------------

def _viterbi(word: str, scores: dict[str, float], max_len: int, unk_score: float) -> list[str]:
    n = len(word)
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - max_len), end):
            piece = word[start:end]
            s = scores.get(piece)
            if s is None:
                if end - start != 1:
                    continue
                s = unk_score
            v = best[start] + s
            if v > best[end]:
                best[end] = v
                back[end] = start
    out = []
    end = n
    while end > 0:
        start = back[end]
        out.append(word[start:end])
        end = start
    return out[::-1]


def unigram_train(counts: DataFrame, vocab_size: int, specials: Sequence[str] = ("[PAD]", "[UNK]", "[SOS]", "[EOS]", "[MASK]"),
                  max_piece_length: int = MAX_PIECE, **kw) -> DataFrame:
    """Train a Unigram model to ``vocab_size`` (``textprep.operators.unigram``).  Returns
    ``vocab_df(token, id, score)``: specials, then pieces by falling score.  Every character of
    the corpus is a piece, so any seen word encodes."""
    pieces = unigram.train(counts, vocab_size, specials, max_piece_length, **kw)
    rows = [(s, i, 0.0) for i, s in enumerate(specials)]
    rows += [(p, len(specials) + i, float(s)) for i, (p, s) in enumerate(pieces)]
    return counts.sparkSession.createDataFrame(rows, "token string, id int, score double")


# --- subword encoding ---------------------------------------------------------------------

def _bpe_apply(word: str, ranks: dict[tuple[str, str], int], prefix: str | None) -> list[str]:
    """Merge the pair of lowest rank, leftmost first, until none is left: a heap of the pairs over linked
    symbols, so a word of n characters takes n log n steps."""
    syms: list[str | None] = [c if i == 0 or not prefix else prefix + c for i, c in enumerate(word)]
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or syms[i] != a or syms[j] != b:  # one of the two was merged since
            continue
        syms[i] = a + (b[len(prefix):] if prefix and b.startswith(prefix) else b)
        syms[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get((syms[left], syms[right]))) is not None:
                heapq.heappush(heap, (r, left, syms[left], syms[right]))
    return [s for s in syms if s is not None]


def _wordpiece_apply(word: str, vocab: set[str], longest: int, prefix: str = "##", unk: str = "[UNK]") -> list[str]:
    """Longest match from the left; no match is tried beyond the ``longest`` piece's length."""
    out, start = [], 0
    while start < len(word):
        for end in range(min(len(word), start + longest), start, -1):
            piece = word[start:end] if start == 0 else prefix + word[start:end]
            if piece in vocab:
                break
        else:
            return [unk]
        out.append(piece)
        start = end
    return out


def subword_encode(df: DataFrame, key: str, text_col: str, vocab: DataFrame, model: str = "bpe",
                   merges: DataFrame | None = None, length: int | None = None, unk_id: int = 1,
                   specials: Sequence[str] = DEFAULT_SPECIALS, word_mark: str | None = None) -> DataFrame:
    """Encode text with a learned subword model.  ``specials`` are markers that stay whole
    in the text (and never enter a model's pieces); ``word_mark`` is put before every
    white-space word (the SentencePiece form).  With ``length`` only the first ``length``
    words are looked at, as each gives one id at least.

    Each **distinct word** is segmented once (``mapInPandas`` over the word table
    with the model broadcast; the model is bounded by its vocabulary size), the
    pieces are mapped to ids by a join, and documents are rebuilt by posexplode +
    join on the word + ordered regroup."""
    spark: SparkSession = df.sparkSession
    if word_mark:
        tokens = F.transform(split_whitespace(F.col(text_col)), lambda w: F.when(w.isin(list(specials)), w).otherwise(F.concat(F.lit(word_mark), w)))
    else:
        text = F.col(text_col) if length is None else first_words(F.col(text_col), length, specials)
        tokens = pretokenize_words(text, specials)
    tokens = tokens if length is None else F.slice(tokens, 1, length)
    words = df.select(key, F.posexplode(tokens).alias("pos", "word"))
    distinct = words.select("word").distinct()
    special = frozenset(specials)
    if model == "bpe" or model == "wordpiece_bpe":
        ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}  # bounded by vocab size
        prefix = "##" if model == "wordpiece_bpe" else None
        payload = spark.sparkContext.broadcast((ranks, prefix))

        def seg(batches, _p=payload):
            rk, pf = _p.value
            for pdf in batches:
                yield pd.DataFrame({"word": pdf["word"], "pieces": [[w] if w in special else _bpe_apply(w, rk, pf) for w in pdf["word"]]})
    elif model == "wordpiece":
        vset = {r["token"] for r in vocab.select("token").collect()}
        payload = spark.sparkContext.broadcast((vset, max(map(len, vset), default=0)))

        def seg(batches, _p=payload):
            vs, longest = _p.value
            for pdf in batches:
                yield pd.DataFrame({"word": pdf["word"], "pieces": [[w] if w in special else _wordpiece_apply(w, vs, longest) for w in pdf["word"]]})
    elif model == "unigram":
        sc = {r["token"]: r["score"] for r in vocab.where(F.col("id") >= 0).collect() if r["token"] not in special}
        payload = spark.sparkContext.broadcast(sc)

        def seg(batches, _p=payload):
            s = _p.value
            unk = min(s.values()) - 10.0 if s else -10.0
            longest = max(map(len, s), default=1)
            for pdf in batches:
                yield pd.DataFrame({"word": pdf["word"], "pieces": [[w] if w in special else _viterbi(w, s, longest, unk) for w in pdf["word"]]})
    else:
        raise ValueError(model)
    seg_schema = "word string, pieces array<string>"
    segmented = distinct.mapInPandas(seg, seg_schema)
    piece_ids = segmented.select("word", F.posexplode("pieces").alias("ppos", "token")).join(
        checked_broadcast(vocab.select("token", "id")), "token", "left"
    ).select("word", "ppos", F.coalesce("id", F.lit(unk_id)).alias("id"))
    word_ids = piece_ids.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ppos", "id"))).alias("_w")).select(
        "word", F.col("_w.id").alias("wids"))
    # hot words are the skewed keys here: broadcast a small word table, else
    # leave the sort-merge join to AQE's skew-join splitting
    joined = words.join(checked_broadcast(word_ids, 200_000), "word", "left")
    doc = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "wids"))).alias("_d")).select(
        key, F.flatten(F.col("_d.wids")).alias("_raw"))
    doc = df.select(key).join(doc, key, "left").select(key, F.coalesce("_raw", F.array().cast("array<int>")).alias("_raw"))
    if length is None:
        return doc.withColumnRenamed("_raw", "ids")
    return doc.select(key, pad_truncate(F.col("_raw"), length).alias("ids"), attention_mask(F.col("_raw"), length).alias("mask"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))
