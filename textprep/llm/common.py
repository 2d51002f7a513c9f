"""Shared helpers: scratch tables, size-checked broadcasts and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from textprep.session import ensure_checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"  # a word: a run without ASCII white space
BLOCK_BYTES = 1 << 19  # texts are hashed in blocks of about this many bytes
SLICE_BYTES = 1 << 21  # UTF-8 bytes of texts that a step of a task holds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark's scan splits it (no exchange before the per-row work)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table in the shared checkpoint folder and read it back:
    lineage is cut, lost executors cost nothing, and columns are pruned on every read.
    The shuffle files behind it go when it is written, the table itself by ``discard`` or
    when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        jpath = sc._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send at most ``rows`` rows at once to a Python worker.  Rows of packed columns
    are large, and the JVM keeps the memory of its largest batch."""
    before = spark.conf.get(_ARROW_ROWS, None)
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_ARROW_ROWS) if before is None else spark.conf.set(_ARROW_ROWS, before)


def bounded_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``small`` when it has at most ``max_rows`` rows, else leave the join to
    a shuffle (same result).  ``small`` should be cheap to count (a scratch table)."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_struct(columns: list[str]) -> Column:
    """The columns as one struct, whatever their names."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in columns])


def fresh_name(base: str, columns: list[str]) -> str:
    """``base``, lengthened until no column has that name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def schema_of(given: dict[str, DataType], more: str) -> StructType:
    """A schema of the fields ``given`` and those of the DDL string ``more``."""
    out = StructType()
    for name, kind in given.items():
        out = out.add(name, kind)
    return StructType([*out.fields, *StructType.fromDDL(more).fields])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def hash53(*cols: Column) -> Column:
    """53 hash bits as a non-negative bigint."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11)


def explode_count(df: DataFrame, count: str, index: str, block: int = 4096) -> DataFrame:
    """One row for each 0 <= index < count, in two explodes so that no array is long."""
    n = F.col(count)
    return (
        df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block).cast("bigint"))))
        .withColumn(index, F.explode(F.sequence(F.col("_block") * block, F.least(n, (F.col("_block") + 1) * block) - 1)))
        .drop("_block")
    )


def most_frequent(counts: DataFrame, n: str, bound: int) -> DataFrame:
    """The rows with the largest ``n`` (1 or more), at most ``bound`` of them: all above a
    border found from a histogram of a few thousand bins (no rows are sent to be ranked)."""
    bin_of = F.floor(F.log(F.col(n)) * 100)  # counts below 100 have bins of their own
    room, border = bound, None
    for r in sorted(counts.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        if r["rows"] > room:
            break
        room, border = room - r["rows"], r["bin"]
    return counts.limit(0) if border is None else counts.where(bin_of >= border)


def bounded_sample(df: DataFrame, key: Column, total: int, bound: int) -> DataFrame:
    """At most ``bound`` of ``total`` rows, those with the smallest hashes of ``key``; the
    border leaves five standard deviations of room, so the limit behind it cuts nothing."""
    if total <= bound:
        return df
    want = max(1.0, bound - 5 * bound ** 0.5)
    return df.where(hash53(key) < int(want / total * (1 << 53))).limit(bound)


# --- vectorised word hashing -------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK_BYTES + 1024), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[base] = table
    return table[:n]


def byte_table(lower: bool = False, split_punctuation: bool = False) -> np.ndarray:
    """Byte -> normalised byte; 0x20 stands for every separator."""
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = 0x20
    if lower:
        table[65:91] += 32
    if split_punctuation:
        for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
            table[lo:hi] = 0x20
    return table


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a non-null string column and its n + 1 offsets, without copies."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offs, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, kind)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def text_slices(batch: pa.RecordBatch, texts: pa.Array, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """``batch`` and its non-null ``texts`` in parts of at most ``rows`` rows and SLICE_BYTES of
    text (a longer text is a part of its own), so that a step's arrays do not grow with the batch."""
    _, off = string_buffers(texts)
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1
        b = min(max(a + 1, b), a + rows, batch.num_rows)
        yield batch.slice(a, b - a), texts.slice(a, b - a)
        a = b
    pa.default_memory_pool().release_unused()  # a reused worker would keep its peak


def _hash_block(raw: np.ndarray, starts_doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and last two bytes of each word; ``starts_doc``: positions where a text begins."""
    norm = table[raw]
    inside = norm != 0x20
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = starts_doc[starts_doc < len(raw)]
    begin[at] = inside[at]
    last = inside.copy()  # last byte of a word: the next byte is outside or begins a word
    last[:-1] &= ~inside[1:] | begin[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    if len(s) == 0:
        return s, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[norm] * _power_table(_MULT, len(raw)), out=total[1:])
    h = (total[e] - total[s]) * _power_table(_INV, len(raw))[s]
    ending = norm[e - 1].astype(np.int64) + np.where(e - s > 1, norm[np.maximum(e - 2, 0)].astype(np.int64) << 8, 0)
    return s, mix64(h + (e - s).astype(np.uint64) * np.uint64(_MULT)), ending


def word_hashes(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of the batch, in order; n + 1 word offsets of the texts)."""
    return words_with_endings(column, table)[:2]


def words_with_endings(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word of the batch, in order; n + 1 word offsets of the texts;
    each word's last two bytes as a number).

    A Karp-Rabin prefix sum over the column's bytes gives every word's hash without
    building a string.  The hash depends on the word's normalised bytes alone."""
    raw, off = string_buffers(column)
    starts, hashes, endings = [], [], []
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + BLOCK_BYTES)
        if hi < len(raw):  # cut at a text's start or after white space, never inside a word
            cut = off[np.searchsorted(off, hi, "right") - 1]
            if cut <= lo:
                piece = table[raw[lo:hi]] == 0x20
                cut = lo + int(np.flatnonzero(piece)[-1]) + 1 if piece.any() else 0
                while cut == 0:  # a word longer than a block
                    hi = min(len(raw), hi + BLOCK_BYTES)
                    nxt = off[(off > lo) & (off <= hi)]
                    piece = np.flatnonzero(table[raw[lo:hi]] == 0x20)
                    ends = [*map(int, nxt[:1]), *(lo + 1 + int(p) for p in piece[:1])]
                    cut = min(ends) if ends else (len(raw) if hi == len(raw) else 0)
            hi = int(cut)
        inner = off[(off >= lo) & (off < hi)] - lo
        s, h, end = _hash_block(raw[lo:hi], inner, table)
        starts.append(s + lo)
        hashes.append(h)
        endings.append(end)
        lo = hi
    pos = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not hashes:
        return np.zeros(0, np.uint64), np.searchsorted(pos, off), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(pos, off), np.concatenate(endings)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``n`` consecutive words (empty if there are fewer)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix64(h * np.uint64(_MULT) + words[k: len(words) - n + 1 + k])
    return h


def key_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` (long) of a partition sorted by it, across batch borders."""
    rest: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        if rest and rest[0].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(rest)
            rest = []
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            rest.append(table.slice(a, b - a))
            if b < len(keys):
                yield pa.concat_tables(rest) if len(rest) > 1 else rest[0]
                rest = []
    if rest:
        yield pa.concat_tables(rest)
