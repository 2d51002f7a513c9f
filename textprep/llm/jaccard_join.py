"""N-gram Jaccard self-join with Bayesian candidate pruning (BayesLSH) and exact verification.

Shingles are runs of five words; two texts are linked when the Jaccard similarity of their
shingle sets is at least the threshold.

1. Equal texts are one text (copies are members, never pairs).
2. MinHash signatures; texts that agree in one of BANDS bands share a bucket.
3. Buckets are compared in blocks inside tasks: the signatures are read STEP values at a
   time and a pair is dropped once the posterior probability (uniform prior) that its
   similarity reaches the threshold is below ``tolerance``.  A pair is looked at only in
   the first band it shares.  A bucket of m texts is dealt over about m / 512 block pairs,
   in sqrt(m / 256) chunks, so no task gets a whole hot bucket and no pair becomes a row.
4. What is left is verified on the whole shingle sets.
5. Links are summed per text, and connected texts form a class.

A pair of similarity 0.8 is missed with a probability of about 5e-5 by the bands
(1 - 0.8**5)**25 and 5 x ``tolerance`` by the pruning; what is reported is exact.

Cases: a null text is a class of its own without links; equal texts (empty ones too) are
one class; a text of fewer than five words has one shingle, all its words; a blank text
has none and links to its copies only; null ids are allowed (a class is named by its
smallest id); repeated rows are copies; an empty table gives an empty result; other
columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import bounded_broadcast, byte_table, key_groups, mix64, ngram_hashes, pinned, row_struct, text_slices, word_hashes
from textprep.llm.components import connected_components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, BAND_VALUES, STEP = 25, 5, 25
K = BANDS * BAND_VALUES
CHUNK_TEXTS = 256
SLAB_PAIRS = 60_000
MINHASH_BLOCK = 1 << 16
BROADCAST_TEXTS = 100_000
SLICE_ROWS = 2000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)


def shingles(hashes: np.ndarray, ptr: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch of texts and their offsets."""
    words = np.diff(ptr)
    counts = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(counts)])
    grams = ngram_hashes(hashes, n)
    long = np.flatnonzero(words >= n)
    out = np.zeros(off[-1], np.uint64)
    if len(long):
        c = counts[long]
        within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        out[np.repeat(off[long], c) + within] = grams[np.repeat(ptr[long], c) + within]
    for i in np.flatnonzero((words > 0) & (words < n)):
        k = int(words[i])
        out[off[i]] = mix64(ngram_hashes(hashes[ptr[i]: ptr[i + 1]], k) + np.uint64(k))[0]
    return out, off


def minhash(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, K) uint32 signatures; texts must have a shingle."""
    n = len(off) - 1
    sig = np.empty((n, K), np.uint32)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + MINHASH_BLOCK, "right")) - 1)
        b = min(b, n)
        part, at = x[off[a]: off[b]], off[a:b] - off[a]
        for k in range(K):
            sig[a:b, k] = np.minimum.reduceat(part * _A[k] + _B[k], at)
        a = b
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) uint64: a hash of the band's number and values."""
    h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(BAND_VALUES):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::BAND_VALUES].astype(np.uint64) + np.uint64(1))
    return h


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n values for which P(similarity >= threshold) >= tolerance:
    with a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches)."""
    p = 0.0
    for m in range(n + 1):
        p += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n


def _matrix(column, kind) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    wide = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, wide)[arr.offset: arr.offset + len(arr) + 1]
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]].view(kind)


def _binary(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    size = flat.dtype.itemsize
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * size).astype(np.int32)), pa.py_buffer(flat)])


def distinct_counts(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of different shingles of each text."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=len(off) - 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) -> (id, key, n_shingles, sig); ``n_shingles`` counts different ones
    (the size of the set that is compared), sig is empty without shingles."""
    table = byte_table()
    for batch in batches:
        for part, texts in text_slices(batch, batch.column(2), SLICE_ROWS):
            sh, off = shingles(*word_hashes(texts, table))
            n = distinct_counts(sh, off)
            some = np.flatnonzero(n)
            sig = minhash(sh, np.append(off[some], off[-1])) if len(some) else np.zeros((0, K), np.uint32)
            size = np.where(n > 0, K, 0)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(n, pa.int64()),
                _binary(sig.ravel(), np.concatenate([[0], np.cumsum(size)]))], ["id", "key", "n_shingles", "sig"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, sig) -> (rid, band, bucket), BANDS rows per text."""
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(1), np.uint32).reshape(-1, K))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
                pa.array(keys.ravel().view(np.int64))], ["rid", "band", "bucket"])


def _prune(threshold: float, tolerance: float, slab_pairs: int):
    least = {n: least_matches(n, threshold, tolerance) for n in range(STEP, K + 1, STEP)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (block, band, crossed, side, rid, n_shingles, sig) sorted by block -> units of pairs (unit, a, b)."""
        for group in key_groups(batches, "block"):
            if group.num_rows < 2:
                continue
            rid, size = group.column("rid").to_numpy(), group.column("n_shingles").to_numpy()
            sig = _matrix(group.column("sig"), np.uint32).reshape(-1, K)
            keys, band = band_keys(sig), group.column("band")[0].as_py()
            side = group.column("side").to_numpy(zero_copy_only=False)
            if group.column("crossed")[0].as_py():
                left, right = np.flatnonzero(~side), np.flatnonzero(side)
            else:
                left = right = np.arange(len(rid))
            if not len(right):
                continue
            block = np.uint64(group.column("block")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
            rows = max(1, slab_pairs // len(right))
            for k, r0 in enumerate(range(0, len(left), rows)):
                part = left[r0: r0 + rows]
                a, b = np.repeat(part, len(right)), np.tile(right, len(part))
                ok = rid[a] < rid[b] if left is right else rid[a] != rid[b]
                ok &= np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
                a, b = a[ok], b[ok]
                ok = keys[a, band] == keys[b, band]
                if band:
                    ok &= ~(keys[a, :band] == keys[b, :band]).any(axis=1)
                a, b = a[ok], b[ok]
                same = np.zeros(len(a), np.int64)
                for n in range(STEP, K + 1, STEP):
                    same += (sig[a, n - STEP: n] == sig[b, n - STEP: n]).sum(axis=1)
                    ok = same >= least[n]
                    a, b, same = a[ok], b[ok], same[ok]
                if len(a):
                    unit = mix64(np.array([block + np.uint64(k)]))[0]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(unit.view(np.int64))], pa.int64()),
                        pa.array([rid[a]], pa.list_(pa.int64())), pa.array([rid[b]], pa.list_(pa.int64()))], ["unit", "a", "b"])
    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, shingles): sorted distinct hashes; equal texts of a task once."""
    table, seen = byte_table(), set()
    for batch in batches:
        fresh = []
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        first = batch.take(pa.array(fresh, pa.int64())) if len(fresh) < batch.num_rows else batch
        for part, texts in text_slices(first, first.column(1), SLICE_ROWS):
            sh, off = shingles(*word_hashes(texts, table))
            sets = [np.unique(sh[s:e]) for s, e in zip(off[:-1], off[1:])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), _binary(np.concatenate(sets), ends)], ["key", "shingles"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units, each a row of pairs and rows of shingle sets, sorted by unit ->
        (rid, links to rows, links to texts, root) of the texts that have a verified link."""
        for group in key_groups(batches, "unit"):
            rid = group.column("rid").to_numpy(zero_copy_only=False)
            is_text = np.flatnonzero(~np.isnan(rid)) if rid.dtype.kind == "f" else np.arange(len(rid))
            texts = group.take(pa.array(is_text))
            at = next(i for i in range(group.num_rows) if group.column("a")[i].is_valid)
            rid, copies = texts.column("rid").to_numpy().astype(np.int64), texts.column("copies").to_numpy().astype(np.int64)
            order = np.argsort(rid)
            ra, rb = (np.array(group.column(c)[at].as_py(), np.int64) for c in ("a", "b"))
            a, b = (order[np.searchsorted(rid[order], x)] for x in (ra, rb))
            flat = _matrix(texts.column("shingles"), np.uint64)
            size = pc.binary_length(texts.column("shingles")).to_numpy().astype(np.int64) // 8
            off = np.concatenate([[0], np.cumsum(size)])
            vocabulary, ids = np.unique(flat, return_inverse=True)
            shared = np.zeros(len(a), np.int64)
            by_a = np.argsort(a, kind="stable")
            for run_ in np.split(by_a, np.flatnonzero(np.diff(a[by_a])) + 1):
                one = a[run_[0]]
                flag = np.zeros(len(vocabulary), np.int32)
                flag[ids[off[one]: off[one + 1]]] = 1
                if len(run_) < 8:
                    for p in run_:
                        shared[p] = flag[ids[off[b[p]]: off[b[p] + 1]]].sum()
                else:
                    shared[run_] = np.add.reduceat(flag[ids], off[:-1])[b[run_]]
            linked = shared / (size[a] + size[b] - shared) >= threshold
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            root = rid.copy()
            while True:
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                if (new == root).all():
                    break
                root = new
            rows = np.bincount(a, copies[b], len(rid)) + np.bincount(b, copies[a], len(rid))
            n = np.bincount(a, minlength=len(rid)) + np.bincount(b, minlength=len(rid))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(rid[has]), pa.array(rows[has].astype(np.int64)), pa.array(n[has].astype(np.int64)), pa.array(root[has])],
                ["rid", "row_links", "text_links", "root"])
    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: (id, key, class_id, class_key, copies, n_links).

    ``key`` is the text's md5, ``class_id`` the smallest id of the class, ``class_key`` the
    smallest md5 among the texts that have it, ``copies`` the rows with an equal text
    (itself included) and ``n_links`` the other documents it is linked to, copies included."""
    source = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    signed = pinned(source.where("text is not null").mapInArrow(
        _signed, f"id {id_type}, key binary, n_shingles bigint, sig binary"), "signed")
    texts = pinned(signed.groupBy("key").agg(
        F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
    ).withColumn("rid", F.monotonically_increasing_id()), "texts")  # numbered once, as written
    with_sig = texts.where("n_shingles > 0")

    buckets = with_sig.select("rid", "sig").mapInArrow(_buckets, "rid bigint, band int, bucket bigint")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    chunks = F.ceil(F.sqrt(F.col("m") / CHUNK_TEXTS)).cast("int")
    members = (
        buckets.join(shared, "bucket")
        .withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("rid"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("rid", "band", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"),
                (F.col("mine") != F.col("other")).alias("crossed"), (F.col("mine") > F.col("other")).alias("side")))
    blocks = members.join(with_sig.select("rid", "n_shingles", "sig"), "rid").select("block", "band", "crossed", "side", "rid", "n_shingles", "sig")
    units = pinned(blocks.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(
        _prune(threshold, tolerance, SLAB_PAIRS), "unit bigint, a array<bigint>, b array<bigint>"), "units")

    in_unit = units.select("unit", F.explode(F.array_distinct(F.concat("a", "b"))).alias("rid"))
    needed = pinned(texts.join(in_unit.select("rid").distinct(), "rid").select("rid", "key", "copies"), "needed")
    sets = (
        source.select("key", "text").join(bounded_broadcast(needed.select("key"), BROADCAST_TEXTS), "key")
        .mapInArrow(_shingle_sets, "key binary, shingles binary").dropDuplicates(["key"]))
    sets = needed.join(sets, "key").select("rid", "copies", "shingles")
    rows = in_unit.join(sets, "rid").select(
        "unit", F.lit(None).cast("array<bigint>").alias("a"), F.lit(None).cast("array<bigint>").alias("b"), "rid", "copies", "shingles")
    pairs = units.select("unit", "a", "b", F.lit(None).cast("bigint").alias("rid"), F.lit(None).cast("bigint").alias("copies"),
                         F.lit(None).cast("binary").alias("shingles"))
    links = pinned(rows.unionByName(pairs).repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(
        _verify(threshold), "rid bigint, row_links bigint, text_links bigint, root bigint"), "links")

    roots = connected_components(links, "rid", "root")
    per_text = links.groupBy("rid").agg(F.sum("row_links").alias("row_links"))
    named = pinned(
        texts.select("rid", "key", "min_id", "copies")
        .join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").join(per_text, "rid", "left")
        .select("key", "min_id", "copies", F.coalesce("root", "rid").alias("root"), F.coalesce("row_links", F.lit(0)).alias("row_links")), "named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("min_id").isNull(), "min_id", "key")).alias("first"))
    classes = named.join(first, "root").select(
        "key", F.col("first.min_id").alias("class_id"), F.col("first.key").alias("class_key"), "copies",
        (F.col("copies") - 1 + F.col("row_links")).cast("bigint").alias("n_links"))
    with_text = signed.select("id", "key").join(classes, "key").select("id", "key", "class_id", "class_key", "copies", "n_links")
    without = docs.where(F.col(text_col).isNull()).select(
        F.col(id_col).alias("id"), F.lit(None).cast("binary").alias("key"), F.col(id_col).alias("class_id"), F.lit(None).cast("binary").alias("class_key"),
        F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("n_links"))
    return with_text.unionByName(without)


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with one row of each class: the class's smallest id, of its smallest text
    among those with that id.  Rows equal in both are one row."""
    classes = pinned(jaccard_classes(docs, id_col, text_col, threshold, tolerance).where("key is not null"), "classes")
    first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    losers = pinned(classes.where(~first).select("id", "key").distinct(), "losers")
    repeated = pinned(classes.where(first).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    packed = docs.select(row_struct(docs.columns).alias("doc"), F.col(id_col).alias("_id"), F.unhex(F.md5(text_col)).alias("_key"))
    lost = bounded_broadcast(losers, 3 * BROADCAST_TEXTS)
    kept = packed.join(lost, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")), "left_anti")
    if not repeated.isEmpty():  # only representatives that occur in several equal rows are moved
        again = kept.join(repeated, F.col("_key") == F.col("key"), "left_semi").dropDuplicates(["_key"])
        kept = kept.join(repeated, F.col("_key") == F.col("key"), "left_anti").unionByName(again)
    return kept.select("doc.*")
