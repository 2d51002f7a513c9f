"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, the entropy-nearest to one copy each under "source s gives
T_s words" and ``r <= cap``: the solution is ``r = min(cap, exp(lambda_s * size / mean_s))``,
with lambda_s from the convex dual.  The rate depends on (source, size) alone, so the
table of those cells with their row counts is all that the Newton iterations read; each
iteration is one aggregation to one row per source.  Rates are rounded into whole copies
cell by cell, longest texts first, carrying the error on; a second pass takes what is left
of it by any copies up to the cap, so a source ends within a short text of its target; inside a cell the documents with the smallest hashes take the extra copy.

Bounds: sources are the mix's configuration, at most ``MAX_SOURCES`` (an error beyond);
cells are at most sources x different text lengths, and are never collected.

Cases: null or empty text has size 0, takes no words and one copy; a null source is a
source of its own, last in order; of rows equal in id and text as many take the extra copy as
are due (which of them is open, as they differ at most in columns that the mix does not read); a source
whose target is cap x size takes ``cap`` copies of everything; an empty table gives an
empty result; other columns are kept, whatever their names (the operator's own columns
``copies``, ``size``, ``source_size``, ``target`` replace such columns).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textprep.llm.common import bounded_broadcast, hash53, pinned, row_struct, word_count

MAX_SOURCES = 100_000
CUT_ROWS = 512  # mean rows of a cell that are ranked together
PLAN_BROADCAST_ROWS = 300_000
TIE_ROWS = 4096  # mean rows of one hash that are numbered together


def targets_with_cap(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; a share stops at cap x size and the excess is shared
    again by weight among the others until none is above."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        share = {i: rest * weights[i] / w if w else 0.0 for i in open_}
        over = [i for i in open_ if share[i] >= cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def cyclic_weights(pattern: Sequence[float]) -> Callable[[int], list[float]]:
    return lambda n: [pattern[i % len(pattern)] for i in range(n)]


def solve_dual(cells: DataFrame, sources: list[dict], cap: float, tol: float = 1e-10, max_iter: int = 100) -> list[float]:
    """lambda of each source by safeguarded Newton steps; every step aggregates ``cells``
    (sid, size, n) to the value and slope of each source's constraint."""
    spark = cells.sparkSession
    lam, low, high, done = [], [], [], []
    for s in sources:
        closed = s["target"] <= 0 or s["target"] >= cap * s["size"]
        lam.append(math.inf if closed and s["target"] > 0 else -math.inf if closed else math.log(s["target"] / s["size"]))
        low.append(-math.inf)
        high.append(math.inf)
        done.append(closed)
    for _ in range(max_iter):
        todo = [i for i in range(len(sources)) if not done[i]]
        if not todo:
            break
        now = spark.createDataFrame([(i, lam[i], float(sources[i]["mean"])) for i in todo], "sid int, lam double, mean double")
        z = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size")
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        got = cells.join(F.broadcast(now), "sid").groupBy("sid").agg(  # at most MAX_SOURCES rows
            F.sum(words * F.least(tilt, F.lit(float(cap)))).alias("value"),
            F.sum(F.when(tilt < cap, words * z * tilt).otherwise(0.0)).alias("slope")).collect()
        for g in got:
            i, gap = g["sid"], g["value"] - sources[g["sid"]]["target"]
            if abs(gap) <= tol * sources[i]["target"]:
                done[i] = True
                continue
            if gap < 0:
                low[i] = lam[i]
            else:
                high[i] = lam[i]
            step = lam[i] - gap / g["slope"] if g["slope"] > 0 else math.nan
            if not (low[i] < step < high[i]) or math.isnan(step):  # outside the bracket: widen or halve it
                if math.isinf(high[i]):
                    step = max(2 * lam[i], lam[i] + 1)
                elif math.isinf(low[i]):
                    step = min(2 * lam[i], lam[i] - 1)
                else:
                    step = (low[i] + high[i]) / 2
            if step == lam[i]:
                done[i] = True
            lam[i] = step
    # the last digits depend on the order of sums; without them reruns agree
    return [x if math.isinf(x) else float(f"{x:.8e}") for x in lam]


def mix_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The narrow rows that the plan is made from: source, size, hash."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        hash53(F.col(id_col), F.col(text_col)).alias("h"))


def mix_plan(rows: DataFrame, weights: Callable[[int], list[float]], total_share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, size, source_size, target, rate, lo, cut, over, ties): a document of that source
    and size takes ``lo`` copies, and one more if its hash is below ``cut``; of the ``ties`` documents
    whose hash is ``cut``, ``over`` take one more.  ``rows`` is
    ``mix_rows`` as a scratch table, as it is read several times."""
    spark = rows.sparkSession
    by_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in by_source]
    targets = targets_with_cap(sizes, weights(len(sizes)), total_share * sum(sizes), cap)
    sources = [{"size": r["size"], "mean": max(1.0, r["size"] / r["n"]), "target": t} for r, t in zip(by_source, targets)]
    head = spark.createDataFrame(
        [(i, r["source"], r["size"], s["target"]) for i, (r, s) in enumerate(zip(by_source, sources))],
        "sid int, source string, source_size bigint, target double")
    cells = pinned(
        rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(head.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-cells")
    lam = solve_dual(cells.where("size > 0"), sources, cap)
    means = [s["mean"] for s in sources]

    def rounded(cell: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of one source's cells; a source has at most as many as text lengths."""
        cell = cell.sort_values("size", ascending=False, ignore_index=True)
        sid = int(cell["sid"].iloc[0])
        size, n = cell["size"].to_numpy(), cell["n"].to_numpy()
        rate = np.minimum(float(cap), np.exp(np.minimum(700.0, lam[sid] * (size / means[sid])))) if math.isfinite(lam[sid]) \
            else np.full(len(size), float(cap) if lam[sid] > 0 else 0.0)
        rate[size == 0] = 1.0
        least = np.minimum(np.floor(rate), cap).astype(np.int64) * n
        most = np.minimum(np.ceil(rate), cap).astype(np.int64) * n
        copies = least.copy()
        carry = 0.0
        for low, high in ((least, most), (0 * n, cap * n)):  # then the rest of the error, by any copies up to the cap
            for k in range(len(size)):
                if size[k]:
                    if low is least:
                        want = carry + rate[k] * n[k] * size[k]
                        copies[k] = min(max(round(want / size[k]), low[k]), high[k])
                        carry = want - copies[k] * size[k]
                    elif abs(carry) >= size[k] / 2:
                        now = min(max(copies[k] + round(carry / size[k]), low[k]), high[k])
                        carry -= (now - copies[k]) * size[k]
                        copies[k] = now
        copies[size == 0] = n[size == 0]
        lo, extra = copies // n, copies % n
        return cell.assign(rate=rate, lo=lo, extra=extra)[
            ["sid", "source", "size", "n", "source_size", "target", "rate", "lo", "extra"]]

    plan = pinned(cells.groupBy("sid").applyInPandas(
        rounded, "sid int, source string, size bigint, n bigint, source_size bigint, target double, rate double, lo bigint, extra bigint"), "mix-plan")
    # the hash that cuts off the `extra` smallest of a cell: only the bucket it falls in is ranked
    part = plan.where("extra > 0 AND extra < n").select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "sid", "extra", F.ceil(F.col("n") / CUT_ROWS).alias("nb"))
    keyed = rows.join(bounded_broadcast(part, PLAN_BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(
        "sid", "size", "extra", "h", F.least(F.col("nb") - 1, F.floor(F.col("h") / float(1 << 53) * F.col("nb"))).alias("b"))
    before = Window.partitionBy("sid", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    border = (
        keyed.groupBy("sid", "size", "b").agg(F.count(F.lit(1)).alias("c"), F.first("extra").alias("extra"))
        .withColumn("skip", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .where("skip < extra AND extra <= skip + c").select("sid", "size", "b", (F.col("extra") - F.col("skip")).alias("need")))
    # rows of one hash (equal in id and text) are counted first, so a bucket ranks different hashes only
    smaller = Window.partitionBy("sid", "size", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        keyed.groupBy("sid", "size", "b", "h").agg(F.count(F.lit(1)).alias("ties")).join(border, ["sid", "size", "b"])
        .withColumn("over", F.col("need") - F.coalesce(F.sum("ties").over(smaller), F.lit(0)))
        .where("over > 0 AND over <= ties").select("sid", "size", F.col("h").alias("cut"), "over", "ties"))
    whole = F.when(F.col("extra") <= 0, F.lit(-1)).otherwise(F.lit(1 << 53)).cast("bigint")
    return pinned(plan.join(cuts, ["sid", "size"], "left").select(
        "source", "size", "source_size", "target", "rate", "lo", F.coalesce("cut", whole).alias("cut"),
        F.coalesce("over", F.lit(0)).cast("bigint").alias("over"), F.coalesce("ties", F.lit(0)).cast("bigint").alias("ties")), "mix")


def apply_plan(rows: DataFrame, plan: DataFrame, source: str = "source", size: str = "size", h: str = "h") -> DataFrame:
    """``rows`` with source_size, target and copies."""
    own = {c: f"_{c}" for c in ("source", "size", "lo", "cut", "over", "ties")}
    p = bounded_broadcast(plan.drop("rate"), PLAN_BROADCAST_ROWS).withColumnsRenamed(own)
    dealt = rows.join(p, F.col(source).eqNullSafe(F.col("_source")) & (F.col(size) == F.col("_size")))
    tied = (F.col(h) == F.col("_cut")) & (F.col("_over") < F.col("_ties"))
    extra = (F.col(h) < F.col("_cut")) | ((F.col(h) == F.col("_cut")) & ~tied)
    out = dealt.withColumn("copies", F.col("_lo") + extra.cast("bigint"))
    if not plan.where("over < ties").isEmpty():
        out = out.where(~tied).unionByName(_deal_ties(dealt.where(tied)))
    return out.drop(*own.values())


def _deal_ties(tied: DataFrame) -> DataFrame:
    """Rows of one hash of which ``_over`` take one more copy: they are numbered by buckets of some
    TIE_ROWS rows, whose starts are sums of the counts of those before."""
    cell = ["_source", "_size"]
    rows = pinned(tied.withColumn("_row", F.monotonically_increasing_id()), "mix-ties").withColumn(
        "_bucket", F.pmod(F.xxhash64("_row"), F.ceil(F.col("_ties") / TIE_ROWS)))
    before = Window.partitionBy(*cell).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cell, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_number", F.row_number().over(Window.partitionBy(*cell, "_bucket").orderBy("_row")))
    return numbered.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_bucket") == F.col("_b"))).withColumn(
        "copies", F.col("_lo") + (F.col("_start") + F.col("_number") <= F.col("_over")).cast("bigint")).drop("_row", "_bucket", "_s", "_z", "_b", "_start", "_number")


def mix(docs: DataFrame, weights: Callable[[int], list[float]], id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", total_share: float = 1.5, cap: int = 2) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0..cap)."""
    plan = mix_plan(pinned(mix_rows(docs, id_col, text_col, source_col), "mix-rows"), weights, total_share, cap)
    own = {"size", "source_size", "target", "copies"}
    keep = [c for c in docs.columns if c not in own]
    packed = docs.select(row_struct(keep).alias("_doc"), F.col(source_col).cast("string").alias("_src"), word_count(F.col(text_col)).alias("size"),
                         hash53(F.col(id_col), F.col(text_col)).alias("_h"))
    return apply_plan(packed, plan, "_src", "size", "_h").select("_doc.*", "size", "source_size", "target", "copies")
