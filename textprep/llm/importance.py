"""Importance resampling of documents towards a target text distribution.

Features are runs of 1 to ``orders`` consecutive words, hashed into ``buckets`` by CRC-32.  A
bucket's gain is the log ratio of its smoothed shares in the target and in all documents;
a document's weight is the sum of its features' gains, and the documents with the largest
weight plus Gumbel noise (fixed by their id) are drawn.

Hashing goes by a dictionary.  The distinct words of all texts are counted in Spark; each
carries as payload its CRC and length.  The most frequent ones (DICTIONARY_WORDS of at most
LONGEST bytes) make an Aho-Corasick automaton over words between delimiters, which is
broadcast.  A scan of a text emits the payload of each word found; words that are not in
the dictionary lie in the gaps between and get the same payload from their bytes, so
nothing depends on its size.  The CRC of a run is composed from its words' payloads
alone: crc(ab) = shift(crc(a), length b) xor crc(b).

Each text is scanned once; its features' buckets are kept as packed numbers and read
again for counting and for scoring.

Cases: null and empty texts have no features and weight 0; a null id is empty in the noise's key and
last among ties; rows equal in score and id are drawn in any order, each a row of its own;
an empty table gives no rows; an empty target has all counts 0; words of any length are
whole; other columns are ignored unless in ``keep``, whatever their names.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import most_frequent, pinned, row_struct, schema_of, string_buffers, text_slices
from textprep.operators.order import dense_index

DICTIONARY_WORDS, LONGEST = 1 << 16, 64  # at most 4 MB of words
FLUSH_WORDS = 200_000
_SPACE = 0x20


def _byte_table() -> np.ndarray:
    """Byte -> itself, A-Z lower-cased, a space for every other ASCII byte but digits and a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for lo, hi in ((0, 48), (58, 65), (91, 97), (123, 128)):
        table[lo:hi] = _SPACE
    return table


_TABLE = _byte_table()


def _delimited(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of the texts with a space before, between and behind them; where each text begins."""
    raw, off = string_buffers(texts)
    out = np.full(len(raw) + len(texts) + 1, _SPACE, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(texts) + 1), np.diff(off))] = _TABLE[raw]
    return out, off + np.arange(len(off))


# --- CRC of joined strings -----------------------------------------------------------

@cache
def _shift_tables(k: int) -> np.ndarray:
    """CRC register after 2**k zero bytes, as four tables by byte of the register."""
    if k == 0:
        crc = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
        low = np.arange(256, dtype=np.uint32)
        return np.stack([crc, low, low << 8, low << 16])
    half = _shift_tables(k - 1)
    return _through(half, half.reshape(-1)).reshape(4, 256)


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of each pair of joined strings, from their CRCs and the second's length."""
    out = first.astype(np.uint32)
    for k in range(int(second_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero((second_bytes >> k) & 1)
        out[at] = _through(_shift_tables(k), out[at])
    return out ^ second.astype(np.uint32)


# --- dictionary ----------------------------------------------------------------------

def distinct_words(texts: DataFrame) -> DataFrame:
    """(word, n, crc, length) of all words of the one column of ``texts``, counted in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for _, part in (x for batch in batches for x in text_slices(batch, batch.column(0))):
            held.update(_delimited(part)[0].tobytes().split())
            if len(held) > FLUSH_WORDS:
                yield flush()
        yield flush()

    words = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.select("word", "n", F.crc32("word").alias("crc"), F.octet_length("word").alias("length"))


def dictionary(texts: DataFrame, bound: int = DICTIONARY_WORDS) -> Broadcast:
    """Broadcast of the ``bound`` most frequent words at most, with their payloads (crc, length)."""
    words = pinned(distinct_words(texts).where(F.col("length") <= LONGEST), "distinct-words")
    hot = most_frequent(words, "n", bound).select("word", "crc", "length").toArrow()
    return texts.sparkSession.sparkContext.broadcast((
        uuid.uuid4().hex, hot.column("word").to_pylist(), hot.column("crc").to_numpy().astype(np.uint32), hot.column("length").to_numpy().astype(np.int64)))


_automata: dict[str, ahocorasick.Automaton] = {}  # of this Python worker: the last dictionary's, by its name


def _automaton(key: str, words: list[bytes]) -> ahocorasick.Automaton:
    if key not in _automata:
        made = ahocorasick.Automaton()
        for k, word in enumerate(words):
            made.add_word(f" {word.decode('latin-1')} ", k)  # bytes as characters
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def payloads(texts: pa.Array, automaton: ahocorasick.Automaton, crcs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC, length and text index of each word of the texts, in order."""
    norm, begin = _delimited(texts)
    word = np.diff((norm != _SPACE).astype(np.int8))
    starts, ends = np.flatnonzero(word == 1) + 1, np.flatnonzero(word == -1) + 1
    held = norm.tobytes()
    crc, known = np.zeros(len(starts), np.uint32), np.zeros(len(starts), bool)
    if len(automaton):
        hits = np.fromiter(chain.from_iterable(automaton.iter(held.decode("latin-1"))), np.int64).reshape(-1, 2)
        which = np.searchsorted(starts, hits[:, 0] - lengths[hits[:, 1]])  # a hit ends on the delimiter behind its word
        crc[which], known[which] = crcs[hits[:, 1]], True
    for k in np.flatnonzero(~known).tolist():
        crc[k] = zlib.crc32(held[starts[k]: ends[k]])
    return crc, ends - starts, np.searchsorted(begin, starts, "right") - 1


def run_buckets(crc: np.ndarray, length: np.ndarray, text: np.ndarray, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of all runs of 1 to ``orders`` words inside a text, by text."""
    run, found, of = crc, [crc], [text]
    space = np.uint32(zlib.crc32(b" "))
    for k in range(1, orders):
        n = len(crc) - k
        if n <= 0:
            break
        one = np.ones(n, np.int64)
        run = joined_crc(joined_crc(run[:n], np.full(n, space), one), crc[k:], length[k:])
        inside = text[k:] == text[:n]
        found.append(run[inside])
        of.append(text[:n][inside])
    which = np.concatenate(of)
    order = np.argsort(which, kind="stable") if len(of) > 1 else slice(None)
    return (np.concatenate(found) % np.uint32(buckets))[order], which[order]


def scanned(rows: DataFrame, text: Column, keep: list[str], words: Broadcast, orders: int, buckets: int) -> DataFrame:
    """(row struct of ``keep``, n_words, features): the buckets of a text's features as packed numbers."""
    row = row_struct(keep) if keep else F.lit(None).cast("boolean")
    packed = rows.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hot, crcs, lengths = words.value
        automaton = _automaton(name, hot)
        for batch, texts in (x for batch in batches for x in text_slices(batch, batch.column(1))):
            n = batch.num_rows
            crc, length, of = payloads(texts, automaton, crcs, lengths)
            bucket, which = run_buckets(crc, length, of, orders, buckets)
            off = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))]) * kind().itemsize
            features = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(bucket.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(of, minlength=n), pa.int64()), features], ["row", "n_words", "features"])

    return packed.mapInArrow(run, schema_of({"row": packed.schema["row"].dataType}, "n_words bigint, features binary"))


def bucket_counts(scan: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket, counted in each task first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            held += np.bincount(string_buffers(batch.column(0))[0].view(kind), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    out = [0] * buckets
    for r in scan.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: list[int], corpus: list[int]) -> np.ndarray:
    """floor(1000 ln) of the ratio of the buckets' smoothed shares."""
    t_all, s_all = float(sum(target) + len(target)), float(sum(corpus) + len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in zip(target, corpus)], np.int64)


def weights(scan: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, n_words, n_features, weight)."""
    shared = scan.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = string_buffers(batch.column(2))
            off = off // kind().itemsize
            total = np.concatenate([[0], np.cumsum(shared.value[data.view(kind)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off), pa.int64()), pa.array(total[off[1:]] - total[off[:-1]], pa.int64())],
                                             ["row", "n_words", "n_features", "weight"])

    return scan.mapInArrow(run, schema_of({"row": scan.schema["row"].dataType}, "n_words bigint, n_features bigint, weight bigint"))


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 x standard Gumbel noise), fixed by seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str, keep: list[str], text_col: str = "text", target_text_col: str = "text", orders: int = 1,
             buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(row struct of ``keep``, n_words, n_features, weight, score, rank); ``rank`` of the drawn
    ``percent`` of the documents with ``least_words`` words, else null."""
    keep = list(dict.fromkeys([*keep, id_col]))
    words = dictionary(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), dictionary_words)
    scan = pinned(scanned(docs, F.col(text_col), keep, words, orders, buckets), "importance-features")
    goal = scanned(target.select(F.col(target_text_col).alias("text")), F.col("text"), [], words, orders, buckets)
    scored = pinned(weights(scan, gains(bucket_counts(goal, buckets), bucket_counts(scan, buckets))), "importance-weights")
    key = F.col("row").getField(id_col)
    scored = scored.withColumn("score", F.col("weight") + gumbel(key, seed)).withColumn("_may", F.col("n_words") >= least_words)
    drawn = scored.where("_may").count() * percent // 100
    order = [F.col("_may").desc(), F.col("score").desc(), key.asc_nulls_last(), F.col("_tie")]
    ranked = dense_index(scored.withColumn("_tie", F.monotonically_increasing_id()), order, "_at")
    return ranked.select("row", "n_words", "n_features", "weight", "score", F.when(F.col("_may") & (F.col("_at") < drawn), F.col("_at") + 1).alias("rank"))
