"""Seeded, partition-independent randomness.

One uniform draw per (row key, slot, seed): the first 32 bits of
``md5(key|slot|seed)`` divided by 2^32.  It is a pure function of the row, so it
gives the same value under any partitioning, retry or input order, and DuckDB
computes the identical value with ``('0x'||substr(md5(...),1,8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _s(x) -> Column:
    c = x if isinstance(x, Column) else F.lit(x)
    return c.cast("string")


def seeded_bits(key, slot, seed) -> Column:
    """Unsigned 32-bit integer (as bigint) for (key, slot, seed)."""
    h = F.md5(F.concat_ws("|", _s(key), _s(slot), _s(seed)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def seeded_uniform(key, slot, seed) -> Column:
    """Uniform double in [0, 1) for (key, slot, seed)."""
    return seeded_bits(key, slot, seed) / F.lit(TWO_32)


def seeded_randint(key, slot, seed, lo: Column, hi: Column) -> Column:
    """Integer uniform on [lo, hi] (inclusive), like ``random.randint``."""
    span = (hi - lo + 1).cast("bigint")
    return (lo + F.floor(seeded_uniform(key, slot, seed) * span)).cast("int")


# --- SQL (DuckDB) spelling of the same draws, used by the oracle queries -------

def sql_uniform(key: str, slot: str, seed: int | str) -> str:
    return (
        f"(('0x'||substr(md5(concat_ws('|', CAST({key} AS VARCHAR), CAST({slot} AS VARCHAR), "
        f"CAST({seed} AS VARCHAR))),1,8))::BIGINT / 4294967296.0)"
    )
