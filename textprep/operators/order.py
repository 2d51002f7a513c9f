"""Order-dependent operators without a single-task global window.

Spark rows have no position and ``row_number().over(Window.orderBy(...))``
without ``partitionBy`` pulls every row into one task.  Instead:

* ``kth_cut`` finds the exact boundary of the first ``k`` rows in an order by one
  min / max / count aggregate and a histogram or two (each a partial + final hash
  aggregate that returns at most ``2**16`` buckets), so "first k rows" / exact-size
  splits are a plain filter with no sort at all;
* ``ordered_layout`` range-partitions on the full (unique) order key, sorts
  within partitions and pins the layout with a reliable ``checkpoint()``;
  ``dense_index`` adds per-partition offsets (one row per partition, broadcast)
  and ``ffill`` carries the last non-null value across partitions the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep.session import ensure_checkpoint_dir

def _cols(order_cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


# --- exact "first k rows" boundary -------------------------------------------

BUCKET_BITS = 16  # a histogram sends at most 2**16 rows to the driver
FEW_ROWS = 4096  # a bucket of at most so many rows is read instead of cut again
_SIGN = 1 << 63


def kth_cut(df: DataFrame, value: Column, tie_key: Column, k: int | Callable[[int], int]) -> Column:
    """Predicate selecting exactly the ``k`` smallest rows by ``(value, tie_key)``; ``k``
    may be a function of the number of rows.

    ``value`` may be any bigint; ``tie_key`` breaks ties and must be unique per ``value``.
    One aggregate gives count, least and largest value.  Then histograms of at most 2**16
    equal buckets (the next 16 bits below those that all values share) close in on the
    bucket that holds the k-th row, until it is small enough to read or is one value.
    Rows with a null value are never among the first."""
    unsigned = value.cast("bigint").bitwiseXOR(F.lit(-_SIGN))  # the order of bigints as unsigned bits
    base = df.select(value.cast("bigint").alias("_v"), unsigned.alias("_u"), tie_key.alias("_k")).where(F.col("_v").isNotNull())
    total, low, high = base.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    if callable(k):
        k = k(total)
    if k <= 0:
        return F.lit(False)
    if k >= total:
        return F.coalesce(value.isNotNull(), F.lit(False))
    shift = ((low + _SIGN) ^ (high + _SIGN)).bit_length()  # bits that differ
    prefix, held, before = F.lit(True), total, 0
    while shift > 0 and held > FEW_ROWS:
        shift = max(0, shift - BUCKET_BITS)
        bucket = F.shiftrightunsigned(F.col("_u"), shift)
        rows = base.where(prefix).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b, n in sorted((((r["b"] + (1 << 64)) % (1 << 64), r["n"]) for r in rows)):
            if before + n >= k:
                break
            before += n
        signed = b - (1 << 64) if b >= _SIGN else b
        prefix, held = bucket == F.lit(signed), n
    need = k - before
    inside = base.where(prefix).select("_v", "_k")
    if held <= FEW_ROWS:
        border, tie = sorted(map(tuple, inside.collect()))[need - 1]
    else:  # one value with many rows: its tie keys, found the same way by sorting them in place
        border = inside.first()["_v"]
        tie = inside.select("_k").orderBy("_k").limit(need).agg(F.max("_k").alias("m")).first()["m"]
    v = value.cast("bigint")
    return (v < F.lit(border)) | ((v == F.lit(border)) & (tie_key <= F.lit(tie)))


# --- pinned sorted layout ----------------------------------------------------

def ordered_layout(df: DataFrame, order_cols: Sequence, num_partitions: int | None = None) -> DataFrame:
    """Range-partition on the full order key, sort within partitions, tag each row
    with ``_part`` (partition id, monotone in the order) and ``_seq`` (increasing
    within a partition), and pin it with a reliable checkpoint so that every later
    use sees the same layout even after executor loss."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _cols(order_cols)
    laid = (
        df.repartitionByRange(n, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return laid.checkpoint(eager=True)


def _part_offsets(laid: DataFrame) -> DataFrame:
    # one row per partition: bounded by the partition count, safe to broadcast
    per = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint"))


def dense_index(df: DataFrame, order_cols: Sequence, name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order ``order_cols`` (must be unique)."""
    laid = ordered_layout(df, order_cols, num_partitions)
    off = _part_offsets(laid)
    out = laid.join(F.broadcast(off.select("_part", "_off", "_first")), "_part").withColumn(
        name, F.col("_off") + F.col("_seq") - F.col("_first")
    )
    return out.drop("_part", "_seq", "_off", "_first")


def ffill(df: DataFrame, order_cols: Sequence, cols: Sequence[str] | None = None,
          num_partitions: int | None = None) -> DataFrame:
    """Forward-fill ``cols`` (default: all non-order columns) in row order.

    Within a range partition: ``last(ignorenulls)`` over the partition's rows.
    Across partitions: the last non-null value of every earlier partition, taken
    from a per-partition summary (one row per partition, broadcast)."""
    order_names = [c for c in order_cols if isinstance(c, str)]
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in order_names]
    laid = ordered_layout(df, order_cols, num_partitions)
    return ffill_laid(laid, cols).select(*df.columns)


def ffill_laid(laid: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``ffill`` on a frame already produced by ``ordered_layout`` (keeps
    ``_part`` / ``_seq``, so later steps can reuse the same global order:
    ``_seq`` is monotone across partitions because partitions are ranges)."""
    cols = list(cols)
    w_in = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = laid.select(
        *[c for c in laid.columns if c not in cols],
        *[F.last(c, ignorenulls=True).over(w_in).alias(c) for c in cols],
    )
    # last non-null per partition = value at the greatest _seq among non-null rows
    summary = laid.groupBy("_part").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("_seq"), F.col(c)))).alias(f"_l_{c}") for c in cols]
    )
    w_prev = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        "_part",
        *[F.last(F.col(f"_l_{c}")[c], ignorenulls=True).over(w_prev).alias(f"_c_{c}") for c in cols],
    )
    return filled.join(F.broadcast(carry), "_part", "left").select(
        *[c for c in laid.columns if c not in cols],
        *[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) for c in cols],
    )


def running_max_records(df: DataFrame, order_cols: Sequence, value: str, name: str = "is_record",
                        num_partitions: int | None = None) -> DataFrame:
    """Flag rows whose ``value`` exceeds every earlier value (a new running max)."""
    laid = ordered_layout(df, order_cols, num_partitions)
    w_in = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    local_prev = F.max(value).over(w_in)
    summary = laid.groupBy("_part").agg(F.max(value).alias("_pmax"))
    w_prev = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("_part", F.max("_pmax").over(w_prev).alias("_cmax"))
    with_prev = laid.withColumn("_lprev", local_prev).join(F.broadcast(carry), "_part", "left")
    prev = F.greatest(F.col("_lprev"), F.col("_cmax"))  # greatest skips nulls
    out = with_prev.withColumn(name, prev.isNull() | (F.col(value) > prev))
    return out.drop("_part", "_seq", "_lprev", "_cmax")
