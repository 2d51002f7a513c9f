"""§2.5 ordered operators, §2.6 limits, §2.7 rebalance and §2.10 augmentation /
sampling, all driven by the seeded per-row hash (never ``rand()``)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.functions.rnd import seeded_bits, seeded_randint, seeded_uniform
from textprep.functions.text import MASK_TOKEN, split_whitespace
from textprep.operators.order import dense_index, kth_cut
from textprep.operators.relational import checked_broadcast


# --- shuffles, slices, batches ---------------------------------------------------

def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "idx") -> DataFrame:
    """``sample(frac=1).reset_index``: order by the seeded hash (ties by key) and
    number the rows."""
    h = df.withColumn("_h", seeded_bits(F.col(key), F.lit(0), seed))
    return dense_index(h, ["_h", key], name).drop("_h")


def slice_by_position(df: DataFrame, order_col: str, n: int, part: str = "head") -> DataFrame:
    """``df.iloc[:n]`` (``part="head"``) or ``df.iloc[n:]`` (``part="tail"``) in the
    order of a unique bigint position column; an exact boundary, no sort.  Rows without
    a position come last: they are in the tail."""
    cut = kth_cut(df, F.col(order_col), F.col(order_col), n)
    return df.where(cut) if part == "head" else df.where(~F.coalesce(cut, F.lit(False)))


def split_ordered(df: DataFrame, order_col: str, train: float | int, name: str = "part") -> DataFrame:
    """First ``int(f*n)`` rows (or first ``train`` rows when an int) are train."""
    k = train if isinstance(train, int) else lambda n: int(train * n)
    cut = kth_cut(df, F.col(order_col), F.col(order_col), k)
    return df.withColumn(name, F.when(cut, F.lit("train")).otherwise(F.lit("validation")))


def batch_assign(df: DataFrame, order_cols: Sequence[str], batch_size: int, drop_last: bool = False,
                 name: str = "batch_id") -> DataFrame:
    ix = dense_index(df, order_cols, "_idx")
    out = ix.withColumn(name, F.floor(F.col("_idx") / batch_size).cast("long"))
    if drop_last:
        full = df.count() // batch_size
        out = out.where(F.col(name) < F.lit(full))
    return out.drop("_idx")


def batch_pad_to_max(df: DataFrame, ids: str, batch: str, pad: int = 0, name: str = "padded") -> DataFrame:
    """Pad each id array with ``pad`` up to the longest array of its batch
    (per-batch max from a grouped aggregate, joined back on the batch id)."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_len"))
    joined = df.join(longest, batch)
    fill = F.array_repeat(F.lit(pad), (F.col("_len") - F.size(ids)).cast("int"))
    return joined.withColumn(name, F.concat(F.col(ids), fill)).drop("_len")


def head_n(df: DataFrame, order_cols: Sequence, n: int) -> DataFrame:
    """Top-n by order: ``TakeOrderedAndProject`` (per-partition top-n, then merge)."""
    return df.orderBy(*order_cols).limit(n)


# --- splits -------------------------------------------------------------------------

def _hash_cut(df: DataFrame, key: str, seed: int, k) -> Column:
    bits = seeded_bits(F.col(key), F.lit(0), seed)
    return kth_cut(df, bits, F.col(key), k)


def split_fraction(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, name: str = "part") -> DataFrame:
    """Exact-size train/test split: the ``ceil(n * test_size)`` rows with the
    smallest seeded hash are test.  The cut is found by histogram aggregation, so
    the split itself is a filter on a pure function of the row."""
    cut = _hash_cut(df, key, seed, lambda n: math.ceil(n * test_size))
    return df.withColumn(name, F.when(cut, F.lit("test")).otherwise(F.lit("train")))


def split_three_way(df: DataFrame, key: str, seed: int = 42, holdout: float = 0.4, test_of_holdout: float = 0.5,
                    name: str = "part") -> DataFrame:
    """60/20/20 as two nested exact splits (first a 40 % holdout, then half of it)."""
    first = split_fraction(df, key, holdout, seed, "_p1")
    hold = first.where(F.col("_p1") == "test")
    cut2 = _hash_cut(hold, key, seed + 1, lambda n: math.ceil(n * test_of_holdout))
    part = F.when(F.col("_p1") == "train", F.lit("train")).when(cut2, F.lit("test")).otherwise(F.lit("validation"))
    return first.withColumn(name, part).drop("_p1")


def class_cap_rebalance(df: DataFrame, label: str, capped_value, cap: int, order_col: str, seed: int = 42,
                        name: str = "idx") -> DataFrame:
    """First ``cap`` rows (in ``order_col`` order) of the capped class plus every
    row of the other classes, then a seeded shuffle."""
    capped = df.where(F.col(label) == F.lit(capped_value))
    cut = kth_cut(capped, F.col(order_col), F.col(order_col), cap)
    kept = capped.where(cut).unionByName(df.where((F.col(label) != F.lit(capped_value)) | F.col(label).isNull()))
    return seeded_shuffle(kept, order_col, seed, name)


# --- augmentation -------------------------------------------------------------------

def mask_tokens(df: DataFrame, text: str, key: str, out: str = "masked", prob: float = 0.3,
                seed: int = 42) -> DataFrame:
    """Replace ``max(1, int(n * prob))`` distinct tokens by ``[MASK]``; the chosen
    positions are those with the smallest seeded hash of ``(key, position)``.
    Text without tokens is returned unchanged.

    Built in separate projections on purpose: the k-th smallest draw is a column
    referenced both inside and outside the per-token lambda, so the optimizer
    keeps it computed once per row instead of once per token."""
    toks = df.withColumn("_toks", split_whitespace(F.col(text)))
    draws = toks.withColumn(
        "_draws", F.transform("_toks", lambda t, i: F.shiftleft(seeded_bits(F.col(key), i, seed), 31).bitwiseOR(i.cast("bigint")))
    )  # 32 bits of the hash, then the position: plain numbers sort faster than structs
    k = F.greatest(F.lit(1), F.floor(F.size("_toks") * F.lit(prob)).cast("int"))
    kth = draws.withColumn("_kth", F.try_element_at(F.sort_array("_draws"), k))
    masked = F.zip_with("_toks", "_draws", lambda t, d: F.when(d <= F.col("_kth"), F.lit(MASK_TOKEN)).otherwise(t))
    res = F.when(F.col("_kth").isNull(), F.col(text)).otherwise(F.array_join(masked, " "))
    return kth.withColumn(out, res).drop("_toks", "_draws", "_kth")


def cut_mix_pair(t1: Column, t2: Column, key: Column, seed: int = 42, min_frac: float = 0.2,
                 max_frac: float = 0.8, tokens1: Column | None = None, tokens2: Column | None = None) -> Column:
    """Prefix of ``t1`` + suffix of ``t2`` at seeded cut points; ``''`` when a side
    has no tokens.  ``tokens1``/``tokens2`` accept any tokenizer's output array."""
    a = tokens1 if tokens1 is not None else split_whitespace(t1)
    b = tokens2 if tokens2 is not None else split_whitespace(t2)
    na, nb = F.size(a), F.size(b)

    def bounds(n):
        lo = F.greatest(F.lit(1), F.floor(n * F.lit(min_frac)).cast("int"))
        hi = F.greatest(F.lit(1), F.floor(n * F.lit(max_frac)).cast("int"))
        return lo, F.greatest(lo, hi)

    lo1, hi1 = bounds(na)
    lo2, hi2 = bounds(nb)
    c1 = seeded_randint(key, F.lit(1), seed, lo1, hi1)
    c2 = seeded_randint(key, F.lit(2), seed, lo2, hi2)
    out = F.concat(F.slice(a, F.lit(1), c1), F.slice(b, c2 + 1, F.greatest(nb - c2, F.lit(0))))
    return F.when((na == 0) | (nb == 0), F.lit("")).otherwise(F.array_join(out, " "))


def pair_within_label(df: DataFrame, label: str, key: str, text: str, n_aug: int = 1, seed: int = 42) -> DataFrame:
    """``n_aug * n_label`` draws of two different rows of the same label.

    Rows are numbered inside their label through one global dense index on
    ``(label, hash, key)`` minus a per-label offset (no per-label window, so a
    label holding a third of the rows is still spread over all tasks).  Each draw
    picks two distinct local indexes from its seeded hash and fetches the texts
    with equi-joins on ``(label, local index)``."""
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = rows.withColumn("_h", seeded_bits(F.col(key), F.lit(0), seed))
    ix = dense_index(rows.select(label, key, text, "_h"), [label, "_h", key], "_g")
    stats = ix.groupBy(label).agg(F.min("_g").alias("_base"), F.count(F.lit(1)).alias("_n"))
    # one row per label: broadcast only after the size check
    local = ix.join(checked_broadcast(stats), label).withColumn("_i", F.col("_g") - F.col("_base"))
    local = local.where(F.col("_n") >= 2)
    draws = local.select(label, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(n_aug - 1))).alias("_m"))
    draws = draws.withColumn("draw_id", F.col("_i") * n_aug + F.col("_m"))
    dkey = F.concat_ws(":", F.col(label).cast("string"), F.col("draw_id").cast("string"))
    a = F.floor(seeded_uniform(dkey, F.lit("a"), seed) * F.col("_n")).cast("long")
    b0 = F.floor(seeded_uniform(dkey, F.lit("b"), seed) * (F.col("_n") - 1)).cast("long")
    draws = draws.select(label, "draw_id", a.alias("_a"), F.when(b0 >= a, b0 + 1).otherwise(b0).alias("_b"))
    side = local.select(label, "_i", text)
    left = side.withColumnRenamed("_i", "_a").withColumnRenamed(text, "text_a")
    right = side.withColumnRenamed("_i", "_b").withColumnRenamed(text, "text_b")
    return draws.join(left, [label, "_a"]).join(right, [label, "_b"]).select(label, "draw_id", "text_a", "text_b")


def augment_cutmix(df: DataFrame, label: str, key: str, text: str, n_aug: int = 1, seed: int = 42) -> DataFrame:
    """Original rows plus one cut-mix row per draw (non-empty results only); the
    new rows carry only text and label, other columns are null."""
    pairs = pair_within_label(df, label, key, text, n_aug, seed)
    dkey = F.concat_ws(":", F.col(label).cast("string"), F.col("draw_id").cast("string"))
    mixed = pairs.select(label, cut_mix_pair(F.col("text_a"), F.col("text_b"), dkey, seed).alias(text))
    mixed = mixed.where(F.col(text) != "")
    return df.unionByName(mixed, allowMissingColumns=True)


def token_swap_mix(df: DataFrame, key: str, ids: str, labels: str, swap_prob: float = 0.1,
                   seed: int = 42) -> DataFrame:
    """Token-level swap with a permuted partner row: position ``j`` of row ``i``
    takes the partner's token with seeded probability ``swap_prob``; the label is
    ``(1 - f) * y + f * y_partner`` with ``f`` the swapped share.  The partner of
    the row at position ``i`` (key order) is the row at position ``i`` of the
    seeded-hash order, i.e. a random permutation, joined by position."""
    by_key = dense_index(df.select(key, ids, labels), [key], "_pos")
    perm = dense_index(
        df.select(F.col(key).alias("partner_key"), F.col(ids).alias("_pids"), F.col(labels).alias("_plab"),
                  seeded_bits(F.col(key), F.lit(0), seed).alias("_h")),
        ["_h", "partner_key"], "_pos",
    ).drop("_h")
    j = by_key.join(perm, "_pos")
    mask = F.transform(F.col(ids), lambda x, i: seeded_uniform(F.col(key), i, seed) < F.lit(swap_prob))
    mixed = F.zip_with(F.arrays_zip(F.col(ids), F.col("_pids")), mask,
                       lambda pr, m: F.when(m, pr["_pids"]).otherwise(pr[ids]))
    swapped = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))
    frac = F.coalesce(F.try_divide(swapped.cast("double"), F.size(F.col(ids))), F.lit(0.0))  # no tokens: nothing swapped
    out = j.select(key, "partner_key", mixed.alias("mixed_ids"), frac.alias("swap_frac"), labels, "_plab")
    lab = F.zip_with(F.col(labels), F.col("_plab"),
                     lambda y, yp: (F.lit(1.0) - F.col("swap_frac")) * y + F.col("swap_frac") * yp)
    return out.select(key, "partner_key", "mixed_ids", "swap_frac", lab.alias("mixed_labels"))


def bernoulli_gate(key: Column, augmented: Column, original: Column, prob: float = 0.5, seed: int = 42,
                   is_train: Column | None = None) -> Column:
    gate = seeded_uniform(key, F.lit("gate"), seed) < F.lit(prob)
    if is_train is not None:
        gate = gate & is_train
    return F.when(gate, augmented).otherwise(original)


def error_samples(df: DataFrame, pred: str, label: str, order_col: str, n: int = 10) -> DataFrame:
    return head_n(df.where(F.col(pred) != F.col(label)), [order_col], n)


def vocab_top_k(counts: DataFrame, k: int, token: str = "token", count: str = "count") -> DataFrame:
    return counts.orderBy(F.col(count).desc(), F.col(token).asc()).limit(k)

