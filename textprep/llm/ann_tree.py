"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of the rows (``sample_rows``); every row is assigned
to a leaf, descending to the nearest centroid.  A query walks the tree with a priority
queue of nodes, most promising (largest inner product with the centroid) first, and visits
leaves in the order they are popped.  How many is calibrated: the true neighbours of a
bounded set of queries are found by one pass over all rows, and the visits are widened
until ``recall`` of them lie in visited leaves.

The visits are joined with the rows by (leaf, block): a leaf is dealt into blocks of about
BLOCK_ROWS rows, by row, so a leaf that holds a third of all rows is many tasks, even if
all of them are one row repeated.  In a task the
block's vectors come first and the queries stream past them; per query and block only the
``k`` best go on, and a last pass merges them.

Nearness is the inner product in double precision on the original vectors, added up in the
order of the components, whatever the block; ties go to the smaller id.

Cases: vectors that are null, zero, hold a null or non-finite component, or do not have the
most common number of components take no part, as query or candidate; so do rows without
an id; rows with a query's id are never its neighbours; several query rows of one id are
one query (the smallest vector); a query gets all candidates if there are fewer than ``k``;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import bounded_sample, hash53, key_groups, pinned

SAMPLE_ROWS, CALIBRATION_QUERIES = 16_384, 128
BRANCH, MAX_LEAVES, BLOCK_ROWS = 12, 4096, 4096
RECALL, WIDEN = 0.97, 1.2


@dataclass
class Tree:
    children: list[list[int]]  # node -> its children; leaves have none
    centroid: np.ndarray  # (nodes, dimensions)
    leaf: np.ndarray  # node -> leaf number, -1 for inner nodes
    n_leaves: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf number of each vector."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = _nearest(vectors[rows], self.centroid[kids])
            todo += [(int(k), rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaf numbers in the order that the priority queue gives them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield int(self.leaf[node])
                continue
            kids = self.children[node]
            for k, s in zip(kids, (self.centroid[kids] @ query).tolist()):
                heapq.heappush(queue, (-s, k))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centroids)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def fit_tree(sample: np.ndarray, n_leaves: int, branch: int = BRANCH, seed: int = 7) -> Tree:
    """Split the largest leaf by k-means until there are ``n_leaves`` (or no leaf can be split)."""
    rng = np.random.default_rng(seed)
    children, centroid, rows = [[]], [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], {0: np.arange(len(sample))}
    leaves = 1
    heap = [(-len(sample), 0)]
    while heap and leaves < n_leaves:
        _, node = heapq.heappop(heap)
        x = sample[rows[node]]
        different = len(np.unique(x, axis=0))
        k = min(branch, n_leaves - leaves + 1, different)
        if k < 2:
            continue
        c = _kmeans(np.unique(x, axis=0) if different < 2 * k else x, k, rng)
        near = _nearest(x, c)
        used = [i for i in range(k) if (near == i).any()]
        if len(used) < 2:
            continue
        for i in used:
            children[node].append(len(children))
            rows[len(children)] = rows[node][near == i]
            heapq.heappush(heap, (-int((near == i).sum()), len(children)))
            children.append([])
            centroid.append(c[i])
        leaves += len(used) - 1
    leaf = np.full(len(children), -1)
    ends = [i for i, c in enumerate(children) if not c]
    leaf[ends] = np.arange(len(ends))
    return Tree(children, np.array(centroid), leaf, len(ends))


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components that is not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column, dims: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _true_neighbours(shared, dims: int, k: int):
    """Running top k of each calibration query over a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            scores = queries @ _vectors(batch.column(2), dims).T
            for q, own in enumerate(query_ids):
                other = np.flatnonzero(ids != own)
                s, i, lf = (np.concatenate(x) for x in zip(best[q], (scores[q, other], ids[other], leaf[other])))
                top = _top(s, i, k)
                best[q] = (s[top], i[top], lf[top])
        n = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), n).astype(np.int32)), pa.array(np.concatenate([b[0] for b in best])),
            pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[2] for b in best]).astype(np.int32))], ["q", "score", "id", "leaf"])
    return run


def calibrate(indexed: DataFrame, tree: Tree, calibration: list, dims: int, k: int, recall: float) -> int:
    """Leaf visits after which ``recall`` of the calibration queries' true neighbours were met."""
    from pyspark.sql import Window

    ids, vectors = [r["id"] for r in calibration], np.array([r["vector"] for r in calibration], np.float64).reshape(-1, dims)
    shared = indexed.sparkSession.sparkContext.broadcast((ids, vectors))
    found = indexed.select("id", "leaf", "vector").mapInArrow(_true_neighbours(shared, dims, k), "q int, score double, id bigint, leaf int")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")  # k rows per task and query
    true = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("q", "leaf").collect()
    rank = [{leaf: n for n, leaf in enumerate(tree.best_first(v))} for v in vectors]
    places = np.array([rank[r["q"]][r["leaf"]] for r in true])
    visits = 1
    while visits < tree.n_leaves and len(places) and (places < visits).mean() < recall:
        visits = max(visits + 1, math.ceil(visits * WIDEN))
    return min(visits, tree.n_leaves)


def _visits(shared, dims: int, visits: int, k: int):
    """Queries -> (leaf, query, vector) of the leaves visited; more than ``visits`` where
    those hold too few rows for ``k`` neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = shared.value
        for batch in batches:
            rows, leaves = [], []
            for i, v in enumerate(_vectors(batch.column(1), dims)):
                held = 0
                for n, leaf in enumerate(tree.best_first(v)):
                    if n >= visits and held > k:
                        break
                    held += counts[leaf]
                    rows.append(i)
                    leaves.append(leaf)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "query", "vector"])
    return run


def pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``a`` with that of ``b``, added up component by component: the
    same pair gets the same score wherever it is computed, and equal vectors get equal scores."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _best_of(asked: np.ndarray, asked_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of each query's ``k`` best rows.  A matrix product only picks the finalists: all rows
    that its rounding error could have put behind the best ``k``."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = asked @ vectors.T
        norm = float(np.sqrt((vectors * vectors).sum(1).max(initial=0)))
        slack = 4 * (vectors.shape[1] + 2) * np.finfo(np.float64).eps * np.sqrt((asked * asked).sum(1)) * norm
    own_here = np.isin(asked_ids, ids)
    finalists = []
    for r in range(len(asked)):
        other = np.flatnonzero(ids != asked_ids[r]) if own_here[r] else np.arange(len(ids))
        score = rough[r, other] if own_here[r] else rough[r]
        if len(other) > k and np.isfinite(slack[r]):
            edge = np.partition(score, len(score) - k)[len(score) - k]
            other = other[score >= edge - slack[r]]
        finalists.append(other)
    at = np.concatenate(finalists) if finalists else np.zeros(0, np.int64)
    n = [len(f) for f in finalists]
    exact = np.empty(len(at))
    pairs = np.repeat(np.arange(len(asked)), n)
    for a in range(0, len(at), 65_536):  # one query may have a whole block of ties
        exact[a: a + 65_536] = pair_scores(asked[pairs[a: a + 65_536]], vectors[at[a: a + 65_536]])
    out, start = [], 0
    for f in finalists:
        score = exact[start: start + len(f)]
        top = np.lexsort((ids[f], -score))[:k]
        out.append((score[top], ids[f][top]))
        start += len(f)
    return out


def _search(dims: int, k: int):
    """Rows (unit, is_query, id, vector) sorted by unit, candidates first -> (query, scores, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held_ids, held = None, [], []
        ids = vectors = None
        for batch in batches:
            units, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            all_ids, all_vectors = batch.column(2).to_numpy(), _vectors(batch.column(3), dims)
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            out_q, out_s, out_i = [], [], []
            for a, b in zip([0, *cuts], [*cuts, len(units)]):
                if a == b:
                    continue
                if units[a] != unit:
                    unit, held_ids, held, ids = units[a], [], [], None
                if not is_query[a]:
                    held_ids.append(all_ids[a:b])
                    held.append(all_vectors[a:b])
                    continue
                if ids is None:
                    ids = np.concatenate(held_ids) if held_ids else np.zeros(0, np.int64)
                    vectors = np.concatenate(held) if held else np.zeros((0, dims))
                for q0 in range(a, b, 256):
                    asked = slice(q0, min(b, q0 + 256))
                    found = _best_of(all_vectors[asked], all_ids[asked], vectors, ids, k)
                    out_q += list(all_ids[asked])
                    out_s += [f[0] for f in found]
                    out_i += [f[1] for f in found]
            if out_q:
                off = np.concatenate([[0], np.cumsum([len(x) for x in out_i])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(out_q, np.int64)), pa.ListArray.from_arrays(off, pa.array(np.concatenate(out_s))),
                    pa.ListArray.from_arrays(off, pa.array(np.concatenate(out_i)))], ["query", "scores", "ids"])
    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            n = [len(r[1]) for r in rows]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), n)), pa.array(np.concatenate([np.arange(1, x + 1) for x in n]).astype(np.int32)),
                pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], ["query_id", "rank", "vec_id", "score"])

        for group in key_groups(batches, "query"):
            ids, scores = (np.concatenate([np.asarray(c.flatten()) for c in group.column(x).chunks]) for x in ("ids", "scores"))
            top = np.lexsort((ids, -scores))[:k]
            out.append((group.column("query")[0].as_py(), ids[top].astype(np.int64), scores[top].astype(np.float64)))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)
    return run


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, n_leaves: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, its ``k`` nearest found."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), is_query.alias("q"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & usable(F.col("vector")))
    dims_row = base.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims_row is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, n = dims_row["d"], dims_row["n"]
    base = base.where(F.size("vector") == dims)
    first = hash53(F.col("id"))
    sample = sorted(r["vector"] for r in bounded_sample(base, F.col("id"), n, sample_rows).select("vector").collect())
    tree = fit_tree(np.array(sample, np.float64).reshape(-1, dims), n_leaves or min(MAX_LEAVES, max(1, round(math.sqrt(n) / 1.5))))
    sc = spark.sparkContext
    shared = sc.broadcast(tree)  # MAX_LEAVES leaves at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(_vectors(batch.column(2), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["id", "q", "vector", "leaf"])

    indexed = pinned(base.mapInArrow(assign, "id bigint, q boolean, vector array<double>, leaf int"), "leaves")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # MAX_LEAVES rows at most
    counts = np.array([sizes.get(i, 0) for i in range(tree.n_leaves)])
    queries = indexed.where("q").groupBy("id").agg(F.min("vector").alias("vector"))
    calibration = queries.orderBy(first, "id").limit(CALIBRATION_QUERIES).collect()
    visits = calibrate(indexed, tree, calibration, dims, k, recall)

    walked = sc.broadcast((tree, counts))
    visited = queries.mapInArrow(_visits(walked, dims, visits, k), "leaf int, query bigint, vector array<double>")
    blocks = spark.createDataFrame([(i, max(1, math.ceil(int(c) / BLOCK_ROWS))) for i, c in enumerate(counts)], "leaf int, blocks int")
    candidate = indexed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(blocks), "leaf").select(
        F.xxhash64("leaf", F.pmod(F.xxhash64("row"), "blocks").cast("int")).alias("unit"), F.lit(False).alias("is_query"), "id", "vector")
    asked = visited.join(F.broadcast(blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("leaf", "block").alias("unit"), F.lit(True).alias("is_query"), F.col("query").alias("id"), "vector")
    found = candidate.unionByName(asked).repartition(F.col("unit")).sortWithinPartitions("unit", "is_query").mapInArrow(
        _search(dims, k), "query bigint, scores array<double>, ids array<bigint>")
    return found.repartition(F.col("query")).sortWithinPartitions("query").mapInArrow(
        _merge(k), "query_id bigint, rank int, vec_id bigint, score double")
