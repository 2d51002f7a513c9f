"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without punctuation, hashed.  Every run of ``min_match``
tokens of a benchmark item is a seed; a document's runs come from one running Karp-Rabin
pass and are joined with the seeds in the map task.  Where the seeds could cover enough of
an item, the pair is tiled: the longest match of unmarked tokens is marked as a tile, again
and again, until none of ``min_match`` tokens is left.  Tiles do not overlap and may lie in
any order, so passages that were reordered or interrupted still add up.  A pair whose
tiles cover at least ``coverage`` of the item's tokens is reported.

The benchmark's tokens are broadcast in blocks of at most MAX_BLOCK_TOKENS, one pass over
the documents per block; nothing is shuffled, and hot passages stay in their documents.

Cases: null and empty texts match nothing; items of fewer than ``min_match`` tokens have no
seed and are never reported; equal items are reported each; equal match lengths are taken
in order of item, then document position; repeated rows are reported as rows; a null id is
reported as null; an empty table on either side gives no rows; of the other columns only
``keep`` is carried, as a struct, whatever its names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textprep.llm.common import byte_table, ngram_hashes, row_struct, schema_of, text_slices, word_count, word_hashes

MIN_MATCH, COVERAGE = 5, 0.5
MAX_BLOCK_TOKENS = 2_000_000
SLICE_ROWS = 500
_TABLE = byte_table(lower=True, split_punctuation=True)


def tile(runs: list[tuple[int, int, int]], doc_len: int, item_len: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of (length, item position, document position) runs of equal
    tokens: the tiles, in the order they were marked."""
    heap = [(-n, j, i) for n, j, i in runs]
    heapq.heapify(heap)
    item_marked = np.zeros(item_len, bool)
    doc_marked: dict[int, bool] = {}
    tiles, free = [], item_len
    while heap and free >= min_match:
        n, j, i = heapq.heappop(heap)
        n = -n
        open_ = [not item_marked[j + k] and (i + k) not in doc_marked for k in range(n)]
        if all(open_):
            item_marked[j: j + n] = True
            doc_marked.update(dict.fromkeys(range(i, i + n), True))
            tiles.append((n, j, i))
            free -= n
            continue
        start = None
        for k, ok in enumerate([*open_, False]):  # the parts still unmarked compete again
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_match:
                    heapq.heappush(heap, (start - k, j + start, i + start))
                start = None
    return tiles


class Seeds:
    """The seeds of a block of benchmark items, sorted by hash."""

    def __init__(self, items: list[np.ndarray], min_match: int):
        grams = [ngram_hashes(t, min_match) for t in items]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.lengths = [len(t) for t in items]
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]
        self.pos = (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64))[order]
        self.hash = h[order]
        self.min_match = min_match

    def matches(self, hashes: np.ndarray, ptr: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list]]:
        """(text, item, tiles) of the pairs that reach ``coverage``."""
        n = self.min_match
        grams = ngram_hashes(hashes, n)
        lo = np.searchsorted(self.hash, grams, "left")
        at = np.flatnonzero((lo < len(self.hash)) & (self.hash[np.minimum(lo, max(len(self.hash) - 1, 0))] == grams)) if len(self.hash) else []
        if not len(at):
            return
        doc = np.searchsorted(ptr, at, "right") - 1
        inside = at + n <= ptr[doc + 1]
        at, doc = at[inside], doc[inside]
        first = lo[at]
        many = np.searchsorted(self.hash, grams[at], "right") - first
        which = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc, at = np.repeat(doc, many), np.repeat(at, many)
        item, j = self.item[which], self.pos[which]
        i = at - ptr[doc]
        order = np.lexsort((i, i - j, item, doc))  # runs along diagonals of a (text, item) pair
        doc, item, i, j = doc[order], item[order], i[order], j[order]
        edges = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(doc)]):
            length = self.lengths[item[a]]
            need = math.ceil(coverage * length - 1e-9)
            covered = np.zeros(length + 1, np.int64)
            jj = np.unique(j[a:b])
            np.add.at(covered, jj, 1)
            np.add.at(covered, np.minimum(jj + n, length), -1)
            if (np.cumsum(covered[:length]) > 0).sum() < need:
                continue
            ii, jj = i[a:b], j[a:b]
            cut = np.flatnonzero((np.diff(ii) != 1) | (np.diff(jj) != 1)) + 1
            runs = [(int(e - s + n - 1), int(jj[s]), int(ii[s])) for s, e in zip([0, *cut], [*cut, len(ii)])]
            tiles = tile(runs, int(ptr[doc[a] + 1] - ptr[doc[a]]), length, n)
            if sum(t[0] for t in tiles) >= need:
                yield int(doc[a]), int(item[a]), tiles


def _seed_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int) -> Iterator:
    """Broadcasts of (item ids, Seeds), each of about MAX_BLOCK_TOKENS tokens at most."""
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / MAX_BLOCK_TOKENS))
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).orderBy("item", "text").collect()
        hashes, ptr = word_hashes(pa.array([r["text"] for r in mine], pa.string()), _TABLE)
        seeds = Seeds([hashes[a:b] for a, b in zip(ptr[:-1], ptr[1:])], min_match)
        yield benchmark.sparkSession.sparkContext.broadcast(([r["item"] for r in mine], seeds))


def contaminations(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(row struct of ``keep``, item_id, item_tokens, matched_tokens, n_tiles, coverage): one
    row per document and benchmark item whose tiles reach ``coverage``."""
    packed = docs.where(F.col(text_col).isNotNull()).select(row_struct(keep).alias("row"), F.col(text_col).alias("text"))
    schema = schema_of({"row": packed.schema["row"].dataType, "item_id": benchmark.schema[item_col].dataType},
                       "item_tokens bigint, matched_tokens bigint, n_tiles bigint, coverage double")
    id_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for shared in _seed_blocks(benchmark, item_col, item_text_col, min_match):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, seeds = shared.value
            for batch in batches:
                for part, texts in text_slices(batch, batch.column(1), SLICE_ROWS):
                    found = list(seeds.matches(*word_hashes(texts, _TABLE), coverage))
                    if not found:
                        continue
                    n = [sum(t[0] for t in tiles) for _, _, tiles in found]
                    size = [seeds.lengths[k] for _, k, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array([d for d, _, _ in found])), pa.array([names[k] for _, k, _ in found], id_kind),
                        pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([len(t) for _, _, t in found], pa.int64()),
                        pa.array([x / y for x, y in zip(n, size)], pa.float64())],
                        ["row", "item_id", "item_tokens", "matched_tokens", "n_tiles", "coverage"])

        part = packed.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _is_clean(shared, coverage: float):
    """Whether a text holds no item of the broadcast block; the text alone goes to Python."""
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, seeds = shared.value
        for texts in batches:
            keep, first = np.ones(len(texts), bool), 0
            for _, part in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), texts, SLICE_ROWS):
                keep[[first + d for d, _, _ in seeds.matches(*word_hashes(part, _TABLE), coverage)]] = False
                first += len(part)
            yield pa.array(keep)

    return clean.asNondeterministic()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.  The decision is made and
    applied in one map task per block of the benchmark; no text is shuffled."""
    for shared in _seed_blocks(benchmark, item_col, item_text_col, min_match):
        docs = docs.where(_is_clean(shared, coverage)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs
