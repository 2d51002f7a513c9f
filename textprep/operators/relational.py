"""§2.2 projections / filters / recodes, §2.3 joins and §2.7 set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.functions.text import PAT, java
from textprep.operators.order import dense_index
from textprep.session import ensure_checkpoint_dir

# Upper bounds for a side we broadcast; above them the join stays a
# shuffled join that AQE may still convert at runtime from real sizes.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def measured(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """The side, and whether its rows and bytes keep the bounds.  It is learned once: it is
    checkpointed, so neither the measure nor what follows computes it again."""
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in small.dtypes if t == "string"), F.lit(16 * len(small.columns)))
    n, size = small.agg(F.count(F.lit(1)), F.sum(width)).first()
    return small, n <= max_rows and (size or 0) <= max_bytes


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only after measuring the side's rows and bytes."""
    small, fits = measured(small, max_rows, max_bytes)
    return F.broadcast(small) if fits else small


def select_drop(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    out = df.select(*keep) if keep else df
    return out.drop(*drop) if drop else out


def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=subset)


def dropna_column(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def fillna_const(df: DataFrame, value, subset: Sequence[str]) -> DataFrame:
    return df.na.fill(value, subset=list(subset))


def derive_sum(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return df.withColumn(name, F.col(a) + F.col(b))


def filter_not_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """pandas ``df[~df[col].isin(values)]``: null rows are kept."""
    return df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def cast_text(col: Column) -> Column:
    """Python ``str(x)``: null (NaN) becomes the text ``nan``."""
    return F.coalesce(col.cast("string"), F.lit("nan"))


def cast_int(col: Column) -> Column:
    return col.try_cast("int")


def map_values(col: Column, mapping: Mapping) -> Column:
    """Dictionary recode by a literal map; unknown values become null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col)


def map_values_strict(df: DataFrame, col: str, codes: DataFrame, value_col: str = "value",
                      id_col: str = "id", out: str | None = None) -> DataFrame:
    """Recode ``col`` by a learned code table; a value missing from the table raises."""
    out = out or f"{col}_id"
    joined = df.join(checked_broadcast(codes.select(F.col(value_col).alias(col), F.col(id_col).alias(out))), col, "left")
    return joined.withColumn(
        out,
        F.when(F.col(out).isNull() & F.col(col).isNotNull(),
               F.raise_error(F.concat(F.lit("unseen value: "), F.col(col).cast("string")))).otherwise(F.col(out)),
    )


def minmax_affine(col: Column, lo: float, hi: float) -> Column:
    """``2 * (x - lo) / (hi - lo) - 1`` with fixed bounds."""
    return F.lit(2.0) * (col - F.lit(lo)) / F.lit(hi - lo) - F.lit(1.0)


def pick_first_or_else(arr: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(arr, F.lit(1)), other)


# --- joins -------------------------------------------------------------------

def lookup_join(df: DataFrame, codes: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Per-row dictionary lookup as a join against a (size-checked) code table."""
    return df.join(checked_broadcast(codes), on, how)


def zip_align(src: DataFrame, tgt: DataFrame, order_cols, text_col: str = "text",
              mode: str = "compact") -> DataFrame:
    """Pair line i of ``src`` with line i of ``tgt``.

    ``compact``: blank lines are removed per side first and lines re-numbered, so
    one blank line shifts every later pair (the reference behaviour).
    ``strict``: pair by the original line number."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    if mode == "strict":
        a = dense_index(src.select(*order_cols, F.col(text_col).alias("src")), order_cols).drop(*order_cols)
        b = dense_index(tgt.select(*order_cols, F.col(text_col).alias("tgt")), order_cols).drop(*order_cols)
        return a.join(b, "idx", "inner")
    blank = F.regexp_replace(F.col(text_col), F.lit(java(PAT["strip"])), F.lit("")) == ""  # any white space, not spaces alone
    a = dense_index(src.where(~blank).select(*order_cols, F.col(text_col).alias("src")),
                    order_cols).drop(*order_cols)
    b = dense_index(tgt.where(~blank).select(*order_cols, F.col(text_col).alias("tgt")),
                    order_cols).drop(*order_cols)
    return a.join(b, "idx", "inner")


# --- set operations ------------------------------------------------------------

def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_missing_cols(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
