"""§2.9 array and encoding column functions (higher-order functions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_ID, UNK_ID, SOS_ID, EOS_ID = 0, 1, 2, 3
IGNORE_TAG_ID = 37  # padding id of tag sequences (ignored by the tagging loss)


def age_range_expand(col: Column) -> Column:
    """``"21-30"`` -> ``[21, ..., 30]``."""
    parts = F.split(F.trim(col), "-")
    return F.sequence(parts[0].cast("int"), parts[1].cast("int"))


def parse_int_list(col: Column) -> Column:
    return F.from_json(col, "array<int>")


def one_hot(idx: Column, num_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda i: F.when(i == idx, 1).otherwise(0))


def multi_hot(values: Column, slots: int = 100) -> Column:
    """Slot ``v - 1`` is 1 for every value ``v`` in the array."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(slots)),
        lambda i: F.when(F.array_contains(values, i), 1).otherwise(0),
    )


def argmax_id(arr: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def softmax(arr: Column) -> Column:
    m = F.array_max(arr)
    ex = F.transform(arr, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def pad_truncate(ids: Column, length: int, pad: int = PAD_ID) -> Column:
    """Cut to ``length`` then right-pad with ``pad``."""
    cut = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(cut)))
    return F.concat(cut, fill)


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= n, 1).otherwise(0))


def pad_labels(ids: Column, length: int) -> Column:
    return pad_truncate(ids, length, IGNORE_TAG_ID)


def seq2seq_shift(src: Column, tgt: Column, length: int) -> Column:
    """encoder ``[2] + x[:L-2] + [3]``; target ``y[:L-1] + [3]``; decoder input
    ``[2] + y[:L-1]``; returned as a struct of three arrays."""
    enc = F.concat(F.array(F.lit(SOS_ID)), F.slice(src, 1, length - 2), F.array(F.lit(EOS_ID)))
    target = F.concat(F.slice(tgt, 1, length - 1), F.array(F.lit(EOS_ID)))
    dec = F.concat(F.array(F.lit(SOS_ID)), F.slice(tgt, 1, length - 1))
    return F.struct(enc.alias("encoder"), target.alias("target"), dec.alias("decoder"))


def seq2seq_wrapped_target(tgt: Column, length: int) -> Column:
    """The recurrent model's target: ``[2] + y[:L-2] + [3]``."""
    return F.concat(F.array(F.lit(SOS_ID)), F.slice(tgt, 1, length - 2), F.array(F.lit(EOS_ID)))


def cut_at_eos(ids: Column, eos: int = EOS_ID) -> Column:
    """Everything before the first ``eos``."""
    p = F.array_position(ids, F.lit(eos))
    return F.when(p > 0, F.slice(ids, F.lit(1), (p - 1).cast("int"))).otherwise(ids)
