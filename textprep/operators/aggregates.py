"""§2.4 aggregations: code tables, counts, grouped collections, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep.operators.order import dense_index

# Code tables learned from a category column are numbered with a window over the
# *distinct values* only; above this many values the numbering switches to the
# distributed dense index instead of one window task.
SMALL_DISTINCT = 100_000


def _number(distinct: DataFrame, order_cols: Sequence, name: str) -> DataFrame:
    n = distinct.count()
    if n <= SMALL_DISTINCT:
        w = Window.orderBy(*order_cols)
        return distinct.withColumn(name, (F.row_number().over(w) - 1).cast("int"))
    return dense_index(distinct, order_cols, name).withColumn(name, F.col(name).cast("int"))


def distinct_first_seen_ids(df: DataFrame, col: str, pos: str | Sequence[str], name: str = "id") -> DataFrame:
    """``enumerate(series.unique())``: ids in order of first appearance.
    Partial aggregation of ``min(position)`` per value, then number the values."""
    pos_cols = [pos] if isinstance(pos, str) else list(pos)
    first = F.min(F.struct(*pos_cols)).alias("_first")
    distinct = df.where(F.col(col).isNotNull()).groupBy(col).agg(first)
    return _number(distinct, ["_first"], name).select(F.col(col).alias("value"), name)


def label_encode_sorted(df: DataFrame, col: str, name: str = "id") -> DataFrame:
    """``LabelEncoder``: ids in sorted value order."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    return _number(distinct, [col], name).select(F.col(col).alias("value"), name)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass, long format (column, n_null)."""
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, n_null)")


def value_histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 9) -> DataFrame:
    """Pearson correlation of every column pair in one aggregation pass, long format."""
    aggs = []
    for a in cols:
        for b in cols:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}"))
    wide = df.agg(*aggs)
    n = len(cols) * len(cols)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a in cols for b in cols)
    return wide.selectExpr(f"stack({n}, {stack}) AS (col_a, col_b, r)").withColumn("r", F.round("r", digits))


def word_counts(tokens: Column, df: DataFrame, name: str = "token") -> DataFrame:
    """Token frequencies: explode then a partial + final hash aggregate (map-side
    combine keeps a hot token from reaching one reducer with all its rows)."""
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def group_collect(df: DataFrame, key: str, order_cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``groupby(key)`` with per-group lists in row order (null keys dropped).

    The lists are built with ``collect_list`` of a struct that carries the row
    position and sorted inside the group; rows of one group are the output row
    itself, so the collected array is exactly the result's size."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], *[F.col(f) for f in fields])))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(ordered.alias("_rows"))


def max_nested_size(df: DataFrame, arr: str, inner: str, order_cols: Sequence[str]) -> DataFrame:
    """Largest inner-array size per row (``max(size)`` over the exploded structs)."""
    return df.select(*order_cols, F.coalesce(F.array_max(F.transform(arr, lambda x: F.size(x[inner]))), F.lit(0)).alias("max_size"))
