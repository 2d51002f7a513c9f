"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every whole training text (per task first, then summed by
(language, feature)); the log-probability matrix, languages x features whatever the
input, is broadcast and batches are scored in numpy through their n-grams' columns.

An n-gram is 1 to ``orders`` consecutive characters of the lower-cased text that end in a
non-space, ASCII non-letters counting as a space.  Prior: share of training rows.

Cases: null text, or text without a letter, gives ``und`` with score 0; so does every text
if no row could be learned from; rows without a label are not learned from; equal scores
go to the language first by code point; other columns are kept, except that
``lang_pred`` and ``score`` are replaced; repeated rows count and predict as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.llm.common import row_struct, text_slices

UNDETERMINED = "und"
MAX_LANGS = 1000
SEGMENT_CHARS = 1 << 17
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass
class LangModel:
    langs: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (languages, features) float32
    orders: int
    bits: int


def _features(cps: np.ndarray, doc: np.ndarray, fresh: int, orders: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (feature, text index) of the n-grams that stay inside one text and end
    at or behind ``fresh`` (what is before it gives context only)."""
    space = cps == 0x20
    space[:fresh] = True
    h = np.zeros(len(cps), np.uint64)
    for k in range(min(orders, len(cps))):
        if k:
            h = h[1:] + cps[: len(cps) - k] * _FACTORS[k]
        else:
            h = cps * _FACTORS[0]
        ok = ~space[k:] & (doc[k:] == doc[: len(doc) - k])
        g = h[ok] + np.uint64(k + 1)
        g ^= g >> np.uint64(29)
        g *= _FACTORS[4]
        yield (g >> np.uint64(64 - bits)).astype(np.int64), doc[k:][ok]


def _segments(texts: pa.Array, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Normalised code points, text index and number of context characters, in segments of
    about SEGMENT_CHARS; a long text is cut, and a segment that goes on with a text begins
    with that text's last characters as context, so no n-gram is lost or repeated."""
    low = pc.utf8_lower(texts)
    table = np.arange(128, dtype=np.uint64)
    table[:97] = 0x20
    table[123:] = 0x20
    parts, docs, held, context = [], [], 0, 0
    for i, value in enumerate(low):
        s = value.as_py()
        for a in range(0, len(s), SEGMENT_CHARS):
            if a:  # the piece before filled its segment, so this one begins the next
                context = min(orders - 1, a)
            piece = s[a - min(orders - 1, a): a + SEGMENT_CHARS]
            c = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            parts.append(np.where(c < 128, table[np.minimum(c, 127)], c))
            docs.append(i)
            held += len(c)
            if held >= SEGMENT_CHARS:
                yield np.concatenate(parts), np.repeat(docs, [len(p) for p in parts]), context
                parts, docs, held, context = [], [], 0, 0
    if parts:
        yield np.concatenate(parts), np.repeat(docs, [len(p) for p in parts]), context


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", orders: int = 3, bits: int = 16,
        alpha: float = 0.5) -> LangModel:
    """Learn from every row of ``rows`` whose label is not null."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        n_rows: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({  # feature -1: the rows of the language
                    "lang": pa.array([lang] * (len(at) + 1), pa.string()),
                    "feature": pa.array(np.append(at, -1), pa.int32()),
                    "n": pa.array(np.append(counts[at], n_rows[lang]), pa.int64())})
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            code = {x: k for k, x in enumerate(names)}
            of = np.array([code[x] for x in langs], np.int64)
            for k, x in enumerate(names):
                held.setdefault(x, np.zeros(size, np.int64))
                n_rows[x] = n_rows.get(x, 0) + int((of == k).sum())
            for cps, doc, context in _segments(batch.column(1), orders):
                for feat, d in _features(cps, doc, context, orders, bits):
                    lang = of[d]
                    for k in np.flatnonzero(np.bincount(lang, minlength=len(names))):
                        held[names[k]] += np.bincount(feat[lang == k], minlength=size)
            if len(held) > 32:
                yield from flush()
                n_rows.clear()
        yield from flush()

    train = rows.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    summed = train.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # at most MAX_LANGS x (features + 1) rows; one row per language holds its features
    got = summed.groupBy("lang").agg(F.collect_list("feature").alias("f"), F.collect_list("n").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(got) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    got.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(got), size))
    prior = np.zeros(len(got))
    for k, r in enumerate(got):
        f, n = np.array(r["f"], np.int64), np.array(r["n"], np.float64)
        prior[k] = n[f < 0].sum()
        counts[k, f[f >= 0]] = n[f >= 0]
    prob = (counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * size)
    with np.errstate(divide="ignore"):
        return LangModel([r["lang"] for r in got], np.log(prior / max(prior.sum(), 1)), np.log(prob).astype(np.float32), orders, bits)


def log_scores(model: LangModel, texts: pa.Array) -> np.ndarray:
    """Log prior + log likelihood, (texts, languages)."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for cps, doc, context in _segments(texts, model.orders):
        first, n = int(doc[0]), int(doc[-1]) - int(doc[0]) + 1
        for feat, d in _features(cps, doc, context, model.orders, model.bits):
            for k in range(len(model.langs)):
                total[first: first + n, k] += np.bincount(d - first, weights=model.log_prob[k][feat], minlength=n)
    return total


def language_of(text: Column, model: LangModel, spark: SparkSession) -> Column:
    """(lang_pred, score) of a text column.  Only the text goes to Python; the rest of the row stays
    in the JVM.  Marked as not deterministic so that a filter on it does not make it run twice."""
    if not model.langs:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # MAX_LANGS x 2**bits floats at most
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            found = [pa.array([], kind)]
            for _, part in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), texts):
                z = log_scores(m, part)
                post = 1.0 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
                found.append(pa.StructArray.from_arrays([pa.array([m.langs[b] for b in z.argmax(axis=1)], pa.string()), pa.array(post)], fields=list(kind)))
            yield pa.concat_arrays(found)

    got = best.asNondeterministic()(F.coalesce(text, F.lit("")))
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), got).otherwise(none)


def predict(docs: DataFrame, model: LangModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score``, the posterior
    probability of the predicted language."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    found = docs.select(row_struct(keep).alias("row"), language_of(F.col(text_col), model, docs.sparkSession).alias("found"))
    return found.select("row.*", "found.lang_pred", "found.score")
