"""Quality rules: word and line counts of each text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed runs of 1 to ``orders`` words: that of the
trusted texts (those whose labels all say good and not toxic) and that of the whole raw
corpus, both counted over all their texts, per task first, and smoothed.  A bucket's weight is
a fixed-point logarithm, so a text's sum is the same in any order; divided by its number of
features it is the text's score.

A quarter of the trusted texts, chosen by id hash, is not learned from and sets the
thresholds: the ``quantile`` of its scores per language less ``margin``; a text's score is
given ``short / sqrt(features)`` first, there and in the decision, as the mean of few
features is less certain; languages with fewer than ``least_trusted`` such texts use the
threshold of all.  Every text that passes the base rules is kept if it reaches its threshold.

Cases: a null text is empty, has all counts 0 and fails the base rules; a null language is a
language; without trusted texts the base rules decide alone; a document labelled more than once is
trusted if all its labels say so; repeated rows are counted and judged as rows; null labels
are not trusted; equal lines are compared byte for byte; texts are taken whole, in steps
bounded by bytes (a longer text is a step alone); empty tables give no rows; other columns
are ignored unless in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import byte_table, mix64, ngram_hashes, pinned, row_struct, schema_of, string_buffers, text_slices, word_hashes
from textprep.llm.quality_kn import trusted_ids

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
ORDERS, BITS, ALPHA = 2, 16, 0.5
UNIT = 1_000_000  # a weight of 1 in natural logarithms
QUANTILE, MARGIN, SHORT, LEAST_TRUSTED = 0.005, 0.02, 0.5, 20
GRID = 10_000  # scores are binned to 1 / GRID for exact, repeatable quantiles
MAX_BROADCAST_IDS = 1_000_000
_EXACT, _LOWER = byte_table(), byte_table(lower=True)
_SPACES = " \t\n\x0b\x0c\r"


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set places of each text."""
    out = np.zeros(len(off) - 1, np.int64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(mask, off[:-1][some], dtype=np.int64)
    return out


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line not in seen:
            seen.add(line)
        elif line.strip(_SPACES):
            n += 1
    return n


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text: words, code points in words, symbols, repeated lines, and words in a
    run of WINDOW words that the text holds twice or more."""
    raw, off = string_buffers(texts)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    words, ptr = word_hashes(texts, _EXACT)
    text = np.repeat(np.arange(len(texts)), np.diff(ptr))
    runs = ngram_hashes(words, WINDOW)
    at = np.flatnonzero(text[: len(runs)] == text[len(text) - len(runs):])
    _, which, times = np.unique(mix64(runs[at] ^ mix64(text[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    again = np.zeros(len(words), bool)
    for k in range(WINDOW):
        again[at + k] = True
    return {
        "n_words": np.diff(ptr).astype(np.int64), "word_chars": _per_text((_EXACT[raw] != 0x20) & ((raw & 0xC0) != 0x80), off), "n_symbols": _per_text(symbol[raw], off),
        "n_dup_lines": np.array([repeated_lines(x.as_py()) for x in texts], np.int64), "n_repeat_words": _per_text(again, ptr)}


def _features(texts: pa.Array, orders: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of all runs of 1 to ``orders`` lower-cased words inside a text."""
    words, ptr = word_hashes(texts, _LOWER)
    text = np.repeat(np.arange(len(texts)), np.diff(ptr))
    bucket, of = [], []
    for k in range(1, orders + 1):
        runs = mix64(ngram_hashes(words, k) + np.uint64(k))
        at = np.flatnonzero(text[: len(runs)] == text[len(text) - len(runs):])
        bucket.append((runs[at] >> np.uint64(64 - bits)).astype(np.int64))
        of.append(text[at])
    return np.concatenate(bucket), np.concatenate(of)


def fit(texts: DataFrame, orders: int = ORDERS, bits: int = BITS, alpha: float = ALPHA) -> np.ndarray | None:
    """Weight of each bucket from all of ``texts`` (text, trusted); None without trusted texts."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, size), np.int64)
        for part, texts in (x for batch in batches for x in text_slices(batch, batch.column(0))):
            bucket, of = _features(texts, orders, bits)
            held[0] += np.bincount(bucket, minlength=size)
            held[1] += np.bincount(bucket[part.column(1).to_numpy(zero_copy_only=False)[of]], minlength=size)
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0][at]), pa.array(held[1][at])], ["bucket", "raw", "goal"])

    summed = texts.mapInArrow(count, "bucket bigint, raw bigint, goal bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("goal").alias("goal"))
    raw, goal = np.zeros(size), np.zeros(size)
    for r in summed.collect():  # at most 2**bits rows
        raw[r["bucket"]], goal[r["bucket"]] = r["raw"], r["goal"]
    if not goal.sum():
        return None
    ratio = np.log((goal + alpha) / (goal.sum() + alpha * size)) - np.log((raw + alpha) / (raw.sum() + alpha * size))
    return np.floor(ratio * UNIT).astype(np.int64)


def judged(docs: DataFrame, weights: np.ndarray | None, keep: list[str], text_col: str, orders: int, bits: int) -> DataFrame:
    """(row struct of ``keep``, base counts, n_features, total): ``total`` is the features' summed weight."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers
    packed = docs.select(row_struct(keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in text_slices(batch, batch.column(1))):
            base, n = base_counts(texts), part.num_rows
            bucket, of = _features(texts, orders, bits)
            total = np.zeros(n, np.int64)
            if shared.value is not None:
                np.add.at(total, of, shared.value[bucket])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(base[c], pa.int64()) for c in names), pa.array(np.bincount(of, minlength=n), pa.int64()), pa.array(total)],
                ["row", *names, "n_features", "total"])

    return packed.mapInArrow(run, schema_of({"row": packed.schema["row"].dataType}, ", ".join(f"{c} bigint" for c in [*names, "n_features", "total"])))


def thresholds(trusted: DataFrame, quantile: float, margin: float, least_trusted: int) -> tuple[list[tuple[str | None, float]], float | None]:
    """(language, threshold) and the threshold of all, from (lang, judged_by) of trusted texts."""
    hist: dict[str | None, dict[int, int]] = {}
    every: dict[int, int] = {}
    for r in trusted.groupBy("lang", F.floor(F.col("judged_by") * GRID).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():  # languages x bins of a bounded range
        hist.setdefault(r["lang"], {})[r["bin"]] = r["n"]
        every[r["bin"]] = every.get(r["bin"], 0) + r["n"]

    def cut(h: dict[int, int]) -> float:
        allowed, run = quantile * sum(h.values()), 0
        for b in sorted(h):
            run += h[b]
            if run > allowed:
                break
        return b / GRID - margin

    common = cut(every) if every else None
    return [(lang, cut(h) if sum(h.values()) >= least_trusted else common) for lang, h in hist.items()], common


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", orders: int = ORDERS,
             bits: int = BITS, quantile: float = QUANTILE, margin: float = MARGIN, short: float = SHORT, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """(row struct of ``keep``, lang, base counts, base_failed, score, threshold, kept) of every document."""
    trusted = pinned(trusted_ids(labels, id_col), "trusted")
    learned = trusted.where("not judge").select(F.col("id").alias("_id"))
    few = learned.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS  # beyond it the join is a shuffle
    flagged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(learned) if few else learned, F.col("id") == F.col("_id"), "left")
    weights = fit(flagged.select("text", F.col("_id").isNotNull().alias("trusted")), orders, bits)
    rows = docs.select(row_struct(keep).alias("row"), F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    score = F.when(F.col("n_features") > 0, F.col("total") / F.col("n_features") / UNIT)
    scored = judged(rows, weights, ["row", "id", "lang"], "text", orders, bits).withColumn("score", score).withColumn("judged_by", score + short / F.sqrt("n_features"))
    scored = pinned(scored.select("row.row", "row.id", "row.lang", *scored.columns[1:6], "score", "judged_by"), "quality-rules")
    table, common = thresholds(scored.where("score IS NOT NULL").join(trusted.where("judge").select("id"), "id", "left_semi"), quantile, margin, least_trusted) if weights is not None else ([], None)
    own = docs.sparkSession.createDataFrame(table, "_lang string, own double")
    limit = F.coalesce("own", F.lit(common).cast("double"))
    out = scored.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # one row a language
    return out.select("row", "lang", *scored.columns[3:8], base_failed().alias("base_failed"), "score", limit.alias("threshold"),
                      (~base_failed() & F.coalesce(F.col("judged_by") >= limit, F.lit(True))).alias("kept"))
