"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of
trusted text, thresholded by language-specific quantiles.

The trusted documents are split by id hash: three quarters may be learned from, one quarter
sets the thresholds.  The model is fitted on all of the former as joins and aggregations of n-gram count
tables, sharded by n-gram hash; a caller may bound it (``max_train_docs``, ``max_train_words``; smallest id hashes first).  Its probabilities are kept as one additive weight per
n-gram: with g(h) the back-off weight of a context,

    log p(w | h) = log p_unknown + sum over the n-grams that end in w or are its context of weight(n-gram)
    weight(h w)  = log p(w | h) - log g(h) - log p(w | shorter h)  +  log g(h w as a context)

so a document's score is a sum over its n-grams, each found by one key: the ``hot`` most
frequent weights are broadcast; a Bloom filter of fixed size drops n-grams the model does
not hold; what is left is joined with the sharded weights.  No n-gram is lost by either.

The threshold of a language is the ``quantile`` of log-perplexity over the whole last
quarter of its trusted documents plus ``margin``; short texts, whose mean is less certain, are
given ``short / sqrt(tokens)`` first, there and in the decision; languages with fewer than
``least_trusted`` of them use that of all languages.

Cases: null text is empty, its one token is the end; a null language is a language; a
document labelled more than once is trusted if all its labels say so; without trusted text
every document is kept with a null threshold; repeated rows are scored as rows; ties at
a bounded sample's border go by id; empty tables give no rows; texts are taken whole, in steps
bounded by bytes; other columns are ignored unless in ``keep``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textprep.llm.common import (
    bounded_sample, byte_table, discard, hash53, mix64, most_frequent, ngram_hashes, pinned, row_struct, schema_of, text_slices, word_count, word_hashes)

ORDER = 3
MAX_TRAIN_DOCS, MAX_TRAIN_WORDS = 4000, 3_000_000  # for a caller that bounds the training texts; by default all are taken
HOT, BLOOM_BITS = 1 << 19, 1 << 26  # 8 MB of weights, 8 MB of bits
QUANTILE, MARGIN, SHORT, LEAST_TRUSTED = 0.99, 0.1, 1.5, 20
GRID = 10_000  # log10 perplexities are binned to 1 / GRID for exact, repeatable quantiles
_TABLE = byte_table(lower=True)
_BEGIN, _END = mix64(np.array([101, 102], np.uint64))
_TEXTS = 2000


@dataclass
class KneserNey:
    weights: DataFrame  # key, weight, n: one row per n-gram
    unknown: float  # log10 p_unknown
    keys: int


def _padded(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end marks around each text; the new offsets."""
    out = np.insert(words, np.repeat(ptr[:-1], 1), _BEGIN)
    new = ptr + np.arange(len(ptr))
    out = np.insert(out, new[1:], _END)
    return out, new + np.arange(len(ptr))


def _ngrams(words: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, key) of the n-grams that stay inside one padded text."""
    keys = ngram_hashes(words, n)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    ok = np.flatnonzero(doc[: len(keys)] == doc[n - 1:][: len(keys)])
    return ok, mix64(keys[ok] + np.uint64(n))  # orders differ in their keys


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (n, key, context key, suffix key, marked, count); ``marked``: begins with the begin mark."""
    for texts in (part for batch in batches for _, part in text_slices(batch, batch.column(0))):
        words, ptr = _padded(*word_hashes(texts, _TABLE))
        by_order = {n: dict(zip(("at", "key"), _ngrams(words, ptr, n))) for n in range(1, ORDER + 1)}
        for n, got in by_order.items():
            key, first, count = np.unique(got["key"], return_index=True, return_counts=True)
            at = got["at"][first]
            if n > 1:
                lower = np.zeros(len(words), np.uint64)
                lower[by_order[n - 1]["at"]] = by_order[n - 1]["key"]
                context, suffix = lower[at], lower[at + 1]
            else:
                context = suffix = np.zeros(len(at), np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)),
                pa.array(suffix.view(np.int64)), pa.array(words[at] == _BEGIN), pa.array(count.astype(np.int64))],
                ["n", "key", "context", "suffix", "marked", "c"])


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, judge): ids whose labels all say quality 1 and toxic 0; ``judge``: those that set thresholds."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good.cast("int")).alias("good")).where("good = 1").select(
        "id", (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(4)) == 0).alias("judge"))


def training_ids(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, max_docs: int, max_words: int) -> DataFrame:
    """The bounded training sample: trusted ids by hash, as long as both bounds hold."""
    one = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("words")).join(trusted, "id", "left_semi").groupBy("id").agg(F.max("words").alias("words"))
    one = pinned(one.where(F.col("words") <= max_words), "trainable")
    rows = sorted(bounded_sample(one.withColumn("h", hash53("id")), F.col("id"), one.count(), max_docs).collect(), key=lambda r: (r["h"], r["id"]))
    total, ids = 0, []
    for r in rows:
        total += r["words"]
        if total > max_words:
            break
        ids.append((r["id"],))
    return docs.sparkSession.createDataFrame(ids, f"id {one.schema['id'].dataType.simpleString()}")


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of adjusted counts 1, 2 and 3 or more."""
    n = dict(table.where("a <= 4").groupBy("a").agg(F.count(F.lit(1))).collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])


def fit(texts: DataFrame, text_col: str = "text") -> KneserNey:
    """Kneser-Ney weights of the whole given texts."""
    counted = pinned(
        texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
            _count, "n int, key bigint, context bigint, suffix bigint, marked boolean, c bigint")
        .groupBy("n", "key").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.first("marked").alias("marked"), F.sum("c").alias("c")),
        "ngrams")
    begin = int(mix64(np.array([_BEGIN]) + np.uint64(1)).view(np.int64)[0])
    adjusted = []
    for n in range(1, ORDER + 1):
        own = counted.where(F.col("n") == n)
        if n < ORDER:  # words seen before it; the n-grams at the begin mark have none and keep their counts
            before = counted.where(F.col("n") == n + 1).groupBy("suffix").agg(F.count(F.lit(1)).alias("b")).withColumnRenamed("suffix", "_s")
            own = own.join(before, F.col("key") == F.col("_s"), "left").withColumn("a", F.when(F.col("marked"), F.col("c")).otherwise(F.coalesce("b", "c"))).drop("_s", "b")
        else:
            own = own.withColumn("a", F.col("c"))
        if n == 1:
            own = own.where(F.col("key") != begin)
        adjusted.append(pinned(own.select("key", *(["context", "suffix"] if n > 1 else []), F.col("c").cast("int"), F.col("a").cast("int")), f"adjusted{n}"))
    discard(counted)
    lower: DataFrame | None = None  # key, p (log10) of the order below
    unknown = 0.0
    parts = []
    for n, own in enumerate(adjusted, 1):
        d = _discounts(own)
        freed = F.sum(_discount(d))
        if n == 1:
            total, left, types = own.agg(F.sum("a"), freed, F.count(F.lit(1))).first()
            total, left = float(total or 1), float(left or 1)
            unknown = math.log10(left / total / (types + 1))
            now = own.select("key", "c", F.log10((F.col("a") - _discount(d)) / total + left / total / (types + 1)).alias("p")).withColumn("w", F.col("p") - unknown)
        else:
            context = pinned(own.groupBy("context").agg(F.sum("a").alias("s"), freed.alias("f")), f"contexts{n}")
            below = lower.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
            g = F.log10(F.col("f") / F.col("s"))
            now = own.join(context, "context").join(below, "suffix").select(
                "key", "c", F.log10((F.col("a") - _discount(d)) / F.col("s") + F.col("f") / F.col("s") * F.pow(F.lit(10.0), "q")).alias("p"), "q", g.alias("g"))
            now = now.select("key", "c", "p", (F.col("p") - F.col("g") - F.col("q")).alias("w"))
            parts.append((context, context.select(F.col("context").alias("key"), F.lit(0).alias("n"), g.alias("weight"))))
        lower = pinned(now if n < ORDER else now.drop("p"), f"order{n}")
        discard(own)
        parts.append((lower, lower.select("key", F.col("c").alias("n"), F.col("w").alias("weight"))))
    weights = pinned(reduce(DataFrame.unionByName, [p for _, p in parts]).groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")), "weights")
    discard(*(table for table, _ in parts))
    return KneserNey(weights, unknown, weights.count())


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    more = mix64(keys)
    return (keys >> np.uint64(8)) % np.uint64(bits), more % np.uint64(bits), (more >> np.uint64(32)) % np.uint64(bits)


def _bloom(weights: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the keys; four tasks each send one table of ``bits`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                table[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["t"])

    out = np.zeros(bits // 8, np.uint8)
    for r in weights.select("key").coalesce(4).mapInArrow(run, "t binary").toLocalIterator():
        out |= np.frombuffer(r["t"], np.uint8)
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text) -> for each text a row (rid, row, n_tokens, score) and, for each of its keys that
        is still to be joined, a row (rid, key, times).  A text's rows all come from one attempt of a task."""
        hot, hot_weight, bloom, bits, unknown = shared.value
        rid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch, texts in text_slices(whole, whole.column(1), _TEXTS):
                n = batch.num_rows
                words, ptr = _padded(*word_hashes(texts, _TABLE))
                doc = np.repeat(np.arange(n), np.diff(ptr))
                tokens = np.diff(ptr) - 1  # the begin mark is not predicted
                score = tokens * unknown
                keys, docs = [], []
                for k in range(1, ORDER + 1):
                    at, key = _ngrams(words, ptr, k)
                    place = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
                    found = hot[place] == key if len(hot) else np.zeros(len(key), bool)
                    score = score + np.bincount(doc[at[found]], hot_weight[place[found]], n)
                    rest = np.flatnonzero(~found)
                    maybe = np.ones(len(rest), bool)
                    for bit in _probes(key[rest], bits):
                        maybe &= (bloom[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1
                    rest = rest[maybe]
                    keys.append(key[rest])
                    docs.append(doc[at[rest]])
                key, who = np.concatenate(keys).view(np.int64), np.concatenate(docs)
                order = np.lexsort((key, who))
                key, who = key[order], who[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(who) != 0)])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(key)))
                ids = rid + np.arange(n)
                rid += n
                names = ["rid", "row", "n_tokens", "score", "key", "times"]
                none = lambda kind, size: pa.nulls(size, kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), batch.column(0), pa.array(tokens.astype(np.int64)), pa.array(score), none(pa.int64(), n), none(pa.int32(), n)], names)
                for a in range(0, len(new), 1 << 16):
                    at = new[a: a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[who[at]]), none(batch.column(0).type, len(at)), none(pa.int64(), len(at)), none(pa.float64(), len(at)),
                        pa.array(key[at]), pa.array(times[a: a + (1 << 16)].astype(np.int32))], names)
    return run


def score(docs: DataFrame, model: KneserNey, keep: list[str], text_col: str = "text", hot: int = HOT, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(row struct of ``keep``, n_tokens, log10_prob) of every row's whole text."""
    sc = docs.sparkSession.sparkContext
    top = model.weights if model.keys <= hot else most_frequent(model.weights.where("n > 0"), "n", hot)
    got = top.select("key", "weight").toPandas().sort_values("key", key=lambda s: s.to_numpy(np.int64).view(np.uint64))  # at most `hot` rows
    rest = model.weights if model.keys > hot else model.weights.limit(0)
    shared = sc.broadcast((got["key"].to_numpy(np.int64).view(np.uint64), got["weight"].to_numpy(np.float64), _bloom(rest, bloom_bits), bloom_bits, model.unknown))
    packed = docs.select(row_struct(keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = packed.mapInArrow(_score(shared), schema_of(
        {"rid": LongType(), "row": packed.schema["row"].dataType}, "n_tokens bigint, score double, key bigint, times int"))
    # the texts' own rows are dealt by their number, which is not looked at
    found = found.withColumn("_k", F.coalesce("key", "rid")).join(model.weights.select(F.col("key").alias("_k"), "weight"), "_k", "left")
    part = F.when(F.col("key").isNull(), F.col("score")).otherwise(F.coalesce(F.col("times") * F.col("weight"), F.lit(0.0)))
    return found.groupBy("rid").agg(F.first("row", ignorenulls=True).alias("row"), F.max("n_tokens").alias("n_tokens"), F.sum(part).alias("log10_prob")).drop("rid")


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             max_train_docs: int | None = None, max_train_words: int | None = None, quantile: float = QUANTILE,
             margin: float = MARGIN, short: float = SHORT, least_trusted: int = LEAST_TRUSTED, hot: int = HOT) -> DataFrame:
    """(row struct of ``keep``, lang, n_tokens, log10_prob, log10_perplexity, threshold, keep)."""
    spark = docs.sparkSession
    trusted = pinned(trusted_ids(labels, id_col), "trusted")
    learned = trusted.where("not judge")
    if max_train_docs is not None or max_train_words is not None:
        learned = F.broadcast(training_ids(  # max_train_docs ids
            docs, learned, id_col, text_col, MAX_TRAIN_DOCS if max_train_docs is None else max_train_docs, MAX_TRAIN_WORDS if max_train_words is None else max_train_words))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(texts.join(learned, "id", "left_semi"), "text")
    rows = docs.select(row_struct(keep).alias("row"), F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    perplexity = F.round(-F.col("log10_prob") / F.col("n_tokens"), 6)
    scored = pinned(score(rows, model, ["row", "id", "lang"], "text", hot).select(
        "row.row", "row.id", "row.lang", "n_tokens", "log10_prob", perplexity.alias("log10_perplexity")), "perplexity")
    judged = scored.join(trusted.where("judge"), "id", "left_semi")
    judged_by = F.col("log10_perplexity") - short / F.sqrt("n_tokens")
    bins = judged.groupBy("lang", F.ceil(judged_by * GRID).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    hist: dict = {}
    for r in bins.collect():  # languages x the bins of a bounded range
        for lang in ((r["lang"],), "all"):
            hist.setdefault(lang, {}).setdefault(r["bin"], 0)
            hist[lang][r["bin"]] += r["c"]

    def cut(h: dict) -> float:
        need, run = quantile * sum(h.values()), 0
        for b in sorted(h):
            run += h[b]
            if run >= need:
                return b / GRID + margin
        raise ValueError("empty histogram")

    common = cut(hist["all"]) if hist else None
    table = spark.createDataFrame(
        [(k[0], cut(h) if sum(h.values()) >= least_trusted else common) for k, h in hist.items() if k != "all"], "_lang string, own double")
    limit = F.coalesce("own", F.lit(common).cast("double"))
    return scored.join(F.broadcast(table), F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "row", "lang", "n_tokens", "log10_prob", "log10_perplexity", limit.alias("threshold"),
        F.coalesce(judged_by <= limit, F.lit(True)).alias("keep"))
