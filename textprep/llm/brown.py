"""LM scoring with Brown's class-based bigrams.

    p(text) = product over tokens, then one end, of p(class | class before) * p(word | class)

Units of clustering are all words that occur ``least`` times or more and, for rarer and
unknown words, their ending (last two bytes): every word has a class, known or not.  The map
takes 8 bytes (hash) and one (class) per unit and is broadcast.  The exchange algorithm moves units between classes to raise the
class-bigram likelihood.  Its counts are a table of unit bigrams over all training texts,
laid out by unit in rows of packed columns, so each step is one pass in which a task holds
the whole neighbourhood of its units; a step is taken only if the likelihood, counted
again, rises.

Word counts cover all training texts.  A word's count is needed where a text is scored:
the ``hot`` most frequent words' counts are broadcast (a bound, not a cut), all others are
joined by word hash, so a common word never becomes one key of a shuffle.

Smoothing: p(c | b) = (n(b, c) + A * p(c)) / (n(b) + A); p(w | c) = (n(w) + D) / (n(c) + D * (v(c) + 1)),
one share D per class being left for unknown words.  Words are 64-bit hashes (a collision
of two of ten million words has a chance of 3e-6).

Cases: null text is empty, its one token is the end; without training texts every count is
0 and the smoothing alone is left; repeated rows count and score as rows; a null id is
kept; given ``frequent``, only so many words are units (ties go by hash); words tied at the ``hot`` border are joined; other columns are
ignored unless in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import arrow_rows, byte_table, discard, most_frequent, pinned, row_struct, schema_of, text_slices, words_with_endings

LEAST, DEALT, HOT, CLASSES = 5, 8192, 1 << 20, 64  # DEALT: words that start in classes of their own rank, the others in their ending's
ROUNDS, LEAST_GAIN = 12, 1e-4
CLASS_PRIOR, WORD_PRIOR = 8.0, 0.5
ENDINGS = 1 << 16
PACK_ROWS = 1 << 16  # rows of the bigram table that are one row of packed columns
TASK_PAIRS, RANGE_PAIRS = 1 << 19, 1 << 21  # pairs that a map task holds before it deals them out; pairs of a range of units, about
FOLD_PAIRS = 1 << 20  # pairs of a range that wait to be summed, or as many as are summed already
BLOCK_UNITS = 1 << 12  # units whose moves are judged at once
BATCH_ROWS = 4  # packed rows that go to a Python worker at once
_PACKED = {"unit": np.int32, "first": np.uint8, "other": np.int32, "n": np.int32}
_MOVES = {"unit": np.int32, "best": np.int16, "gain": np.float32, "mass": np.float32}
END = np.int64(0)  # key of the end token in the table of counts
_TABLE = byte_table(lower=True)
_TEXTS = 2000  # texts that a step of a task holds


@dataclass
class Units:
    frequent: np.ndarray  # sorted uint64 hashes of the words that are units

    @property
    def end(self) -> int:
        return len(self.frequent) + ENDINGS

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at, known = lookup(self.frequent, words)
        return np.where(known, at, len(self.frequent) + endings)


@dataclass
class ClassModel:
    units: Units
    classes: np.ndarray  # class of each unit; the end has the last class, alone
    transition: np.ndarray  # log10 p(class | class before)
    class_norm: np.ndarray  # log10 (n(c) + D * (v(c) + 1))
    hot: np.ndarray  # sorted uint64 hashes
    hot_count: np.ndarray
    counts: DataFrame  # word, ending, n of all training words and the end
    tokens: int
    types: int
    ends: int


def lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each value in a sorted table."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    order = np.argsort(values)  # sorted values are found without jumping about in a large table
    at = np.empty(len(values), np.int64)
    at[order] = np.minimum(np.searchsorted(table, values[order]), len(table) - 1)
    return at, table[at] == values


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch, batch.column(0)):
            words, _, endings = words_with_endings(texts, _TABLE)
            order = np.argsort(words)  # any occurrence will do: a word has one ending
            words = words[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(words)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(words[first].view(np.int64), END)), pa.array(np.append(endings[order[first]], -1).astype(np.int32)),
                pa.array(np.append(n, part.num_rows).astype(np.int64))], ["word", "ending", "n"])


def _steps(words: np.ndarray, ptr: np.ndarray, endings: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """(unit before, unit) of every token and end of a batch of texts, text after text."""
    u = units.of(words, endings)
    here = np.insert(u, ptr[1:], units.end)
    before = np.insert(u, ptr[:-1], units.end)
    return before, here


def _count_bigrams(shared, ranges: int):
    """Texts -> (part, pairs, n): the counted pairs of each range of units as packed rows, every pair
    twice, for the unit that comes first and for the other; a pair's number is unit, side, other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Units = shared.value
        base = np.int64(units.end + 1)
        held, count, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pair, n = _summed(np.concatenate(held), np.concatenate(count))
            before = pair // base
            here = pair - before * base
            for unit, side, other in ((before, 1, here), (here, 0, before)):
                number = (unit * 2 + side) * base + other
                part = (unit % ranges).astype(np.min_scalar_type(ranges))  # narrow: dealt by a radix sort
                if side:  # pairs are in the order of their numbers
                    order = np.argsort(part, kind="stable")
                else:
                    order = np.argsort(number)  # all different
                    order = order[np.argsort(part[order], kind="stable")]
                edges = np.searchsorted(part[order], np.arange(ranges + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    mine = order[edges[k]: edges[k + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k], pa.int32()), pa.array([number[mine].tobytes()], pa.binary()), pa.array([n[mine].astype(np.int32).tobytes()], pa.binary())], ["part", "pairs", "n"])

        for batch in batches:
            for _, texts in text_slices(batch, batch.column(0)):
                before, here = _steps(*words_with_endings(texts, _TABLE), units)
                pair, n = np.unique(before * base + here, return_counts=True)
                held.append(pair)
                count.append(n)
                size += len(pair)
                if size > TASK_PAIRS:
                    yield from flush()
                    held, count, size = [], [], 0
        if held:
            yield from flush()
    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _merge(shared):
    """All packed rows of a partition -> rows (unit, first, other, n) of packed columns, sorted by unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.int64(shared.value.end + 1)
        part, keys, counts, size = None, [], [], 0  # of a range: what is summed (first), and what is not yet

        def fold() -> None:
            nonlocal keys, counts, size
            pair, n = _summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [pair], [n], 0

        def emit() -> Iterator[pa.RecordBatch]:
            fold()
            for a in range(0, len(keys[0]), PACK_ROWS):
                pair, n = keys[0][a: a + PACK_ROWS], counts[0][a: a + PACK_ROWS]
                unit = pair // base
                cols = {"unit": unit >> 1, "first": unit & 1, "other": pair - unit * base, "n": n}
                yield pa.RecordBatch.from_arrays([pa.array([cols[c].astype(kind).tobytes()], pa.binary()) for c, kind in _PACKED.items()], list(_PACKED))

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0)[i].as_py()
                if now != part:
                    if part is not None:
                        yield from emit()
                    part, keys, counts, size = now, [], [], 0
                pair, n = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((1, np.int64), (2, np.int32)))
                keys.append(pair)
                counts.append(n)
                size += len(pair)
                if size > max(FOLD_PAIRS, len(keys[0])):
                    fold()
        if part is not None:
            yield from emit()
    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            unit, first, other, n = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in enumerate(_PACKED.values()))
            yield [unit, first.astype(bool), other, n]


def _class_matrix(shared, k: int):
    """Class bigram counts of the pairs in which the unit comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = shared.value, np.zeros(k * k, np.int64)
        for unit, first, other, n in _unpacked(batches):
            total += np.bincount(classes[unit[first]].astype(np.int64) * k + classes[other[first]], n[first], k * k).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])
    return run


def _best_moves(shared, k: int, half: int | None = None):
    """For each unit, or those of one ``half`` (its number's last bit), the class that raises the likelihood of its
    neighbours most.  Units are looked at in blocks, so that no array has a packed row's units x classes."""
    smooth = 0.1

    def choose(unit, first, other, n, classes, matrix, log_out, log_in) -> pa.RecordBatch:
        new = np.concatenate([[True], unit[1:] != unit[:-1]])  # sorted by unit
        ids, row = unit[new], np.cumsum(new) - 1
        side = np.where(first, 0, k)
        counts = np.bincount(row * 2 * k + side + classes[other], n, len(ids) * 2 * k).reshape(len(ids), 2 * k)
        right, left = counts[:, :k], counts[:, k:]
        score = right @ log_out.T + left @ log_in.T
        own = classes[ids]  # its own class is judged without it
        at = np.arange(len(ids))
        less_out, less_in = np.maximum(matrix[own] - right, 0), np.maximum(matrix.T[own] - left, 0)
        score[at, own] = (
            (right * (np.log(less_out + smooth) - np.log(less_out.sum(axis=1) + smooth * k)[:, None])).sum(axis=1)
            + (left * (np.log(less_in + smooth) - np.log(less_in.sum(axis=1) + smooth * k)[:, None])).sum(axis=1))
        score[:, k - 1] = -np.inf  # the end's class takes no other unit
        best = score.argmax(axis=1)
        gain = score[at, best] - score[at, own]
        gain[own == k - 1] = 0
        return pa.RecordBatch.from_arrays([
            pa.array(ids.astype(np.int32)), pa.array(best.astype(np.int32)), pa.array(gain), pa.array(counts.sum(axis=1))], ["unit", "best", "gain", "mass"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, matrix = shared.value
        log_out = np.log(matrix + smooth) - np.log(matrix.sum(axis=1) + smooth * k)[:, None]
        log_in = np.log(matrix.T + smooth) - np.log(matrix.sum(axis=0) + smooth * k)[:, None]

        def blocks(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """The moves of whole units, sorted by unit, BLOCK_UNITS at a time."""
            starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            edges = np.append(starts[::BLOCK_UNITS], len(cols[0])).tolist()
            for a, b in zip(edges, edges[1:]):
                yield choose(*[c[a:b] for c in cols], classes, matrix, log_out, log_in)

        held = None  # the rows of the last unit go on in the next packed row
        for cols in _unpacked(batches):
            if half is not None:
                mine = cols[0] % 2 == half
                cols = [c[mine] for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            edges = np.flatnonzero(np.diff(cols[0]))
            cut = int(edges[-1]) + 1 if len(edges) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from blocks([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield from blocks(held)
    return run


def _packed_moves(best):
    """The moves of ``best`` as rows of packed columns, one a block of units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for moves in best(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([moves.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in _MOVES.items()], list(_MOVES))
    return run


def exchange(table: DataFrame, classes: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Exchange clustering: (classes, class bigram counts, likelihood after each round).

    ``table`` (unit, first, other, n), in rows of packed columns, holds every bigram twice, for
    either unit; a unit's rows follow each other.  Half of the units may move in a round, so
    that neighbours do not swap for ever."""
    sc = table.sparkSession.sparkContext

    def matrix_of(c: np.ndarray) -> np.ndarray:
        shared, m = sc.broadcast(c), np.zeros(k * k)
        with arrow_rows(table.sparkSession, BATCH_ROWS):
            for r in table.mapInArrow(_class_matrix(shared, k), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
                m[r["cell"]] = r["n"]  # at most k * k rows
        return m.reshape(k, k)

    def likelihood(m: np.ndarray) -> float:
        def ent(x: np.ndarray) -> float:
            x = x[x > 0]
            return float((x * np.log(x)).sum())
        return ent(m) - ent(m.sum(axis=0)) - ent(m.sum(axis=1))

    matrix = matrix_of(classes)
    history = [likelihood(matrix)]
    still = 0
    for r in range(rounds):
        shared = sc.broadcast((classes, matrix))
        with arrow_rows(table.sparkSession, BATCH_ROWS):
            got = table.mapInArrow(_packed_moves(_best_moves(shared, k, r % 2)), ", ".join(f"{c} binary" for c in _MOVES)).collect()  # 14 bytes a unit
        moves = pd.DataFrame({c: np.frombuffer(b"".join(row[c] for row in got), kind) for c, kind in _MOVES.items()})
        moves = moves.sort_values(["mass", "unit"]).drop_duplicates("unit", keep="last")
        moves = moves[moves["gain"] > 0].sort_values(["gain", "unit"], ascending=False)
        improved = False
        while len(moves):
            new = classes.copy()
            new[moves["unit"].to_numpy()] = moves["best"].to_numpy()
            counted = matrix_of(new)
            if likelihood(counted) > history[-1]:
                improved = likelihood(counted) - history[-1] > LEAST_GAIN * abs(history[-1])
                classes, matrix = new, counted
                break
            moves = moves.head(len(moves) // 4)  # too many at once: only those that gain most
        history.append(likelihood(matrix))
        still = 0 if improved else still + 1
        if still == 2:
            break
    return classes, matrix, history


def fit(train: DataFrame, text_col: str = "text", frequent: int | None = None, hot: int = HOT, n_classes: int = CLASSES,
        rounds: int = ROUNDS, least: int = LEAST) -> ClassModel:
    """Learn from every row of ``train``.  All words that occur ``least`` times are units,
    or only the ``frequent`` most frequent words when that is given."""
    sc = train.sparkSession.sparkContext
    texts = _texts(train, text_col)
    counts = pinned(texts.mapInArrow(_count_words, "word bigint, ending int, n bigint").groupBy("word").agg(
        F.min("ending").alias("ending"), F.sum("n").alias("n")), "words")
    tokens, types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    is_end = F.col("word") == F.lit(int(END))
    ends = int(counts.where(is_end).agg(F.sum("n")).first()[0] or 0)
    top = most_frequent(counts.where(~is_end), "n", hot).select("word", "n").toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True])  # at most `hot` rows
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by_hash = np.argsort(words)
    if frequent is None:
        is_unit = ~is_end & (F.col("n") >= least)
    elif len(words[:frequent]):
        word, border = top.iloc[len(words[:frequent]) - 1][["word", "n"]]
        is_unit = ~is_end & ((F.col("n") > int(border)) | ((F.col("n") == int(border)) & (F.col("word") <= int(word))))
    else:
        is_unit = F.lit(False)
    start = counts.where(is_unit).select("word", F.pmod("ending", F.lit(n_classes)).cast("smallint").alias("c")).toArrow()  # 10 bytes a unit
    head, first_class = start["word"].to_numpy().view(np.uint64), start["c"].to_numpy()
    order = np.argsort(head)
    head, first_class = head[order], first_class[order]
    units = Units(head)

    shared = sc.broadcast(units)
    ranges = max(1, -(-2 * (tokens + 1) // RANGE_PAIRS))  # grows with the texts
    packed = texts.mapInArrow(_count_bigrams(shared, ranges), "part int, pairs binary, n binary").repartitionById(ranges, F.col("part"))  # a range is one partition
    table = pinned(packed.mapInArrow(_merge(shared), ", ".join(f"{c} binary" for c in _PACKED)), "unit-bigrams")

    k = n_classes + 1
    classes = np.empty(units.end + 1, np.min_scalar_type(n_classes))
    classes[: len(head)] = first_class
    rank, known = lookup(head, words[:DEALT])
    classes[rank[known]] = np.flatnonzero(known) % n_classes  # by falling frequency, as a deal of cards
    classes[len(head): units.end] = np.arange(ENDINGS) % n_classes
    classes[units.end] = n_classes
    classes, matrix, _ = exchange(table, classes, k, rounds)
    discard(table)

    n_class = matrix.sum(axis=0)
    total = max(n_class.sum(), 1.0)
    prior = (n_class + 1.0) / (total + k)
    prior /= prior.sum()
    transition = np.log10((matrix + CLASS_PRIOR * prior) / (matrix.sum(axis=1, keepdims=True) + CLASS_PRIOR))
    types_class = np.bincount(classes[: len(head)], minlength=k).astype(np.float64)
    for r in counts.where(~is_end & ~is_unit).groupBy("ending").agg(F.count(F.lit(1)).alias("v")).collect():
        types_class[classes[len(head) + r["ending"]]] += r["v"]  # at most ENDINGS rows
    norm = np.log10(n_class + WORD_PRIOR * (types_class + 1))
    return ClassModel(units, classes, transition, norm, words[by_hash], n[by_hash], counts, tokens, types, ends)


def _score_texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text) -> row, n_tokens, n_known, unigram, score, and the words whose counts
        are still to come, with their repeats."""
        units, classes, transition, norm, hot, hot_count, tokens, types, ends = shared.value
        base = np.log10(tokens + types + 1.0)
        for whole in batches:
            for batch, texts in text_slices(whole, whole.column(1), _TEXTS):
                words, ptr, endings = words_with_endings(texts, _TABLE)
                n = batch.num_rows
                before, here = _steps(words, ptr, endings, units)
                size = np.diff(ptr) + 1
                doc = np.repeat(np.arange(n), size)
                cb, c = classes[before], classes[here]
                own = transition[cb, c]
                is_word = here != units.end
                own[is_word] -= norm[c[is_word]]
                score = np.bincount(doc, own, n)
                unigram = -size * base + np.log10(ends + 1.0)
                known = np.full(n, int(ends > 0), np.int64)
                of = doc[is_word]
                place, found = lookup(hot, words)
                if found.any():
                    got, who = hot_count[place[found]], of[found]
                    score += np.bincount(who, np.log10(got + WORD_PRIOR), n)
                    unigram += np.bincount(who, np.log10(got + 1.0), n)
                    known += np.bincount(who, minlength=n)
                rest, who = words[~found].view(np.int64), of[~found]
                order = np.lexsort((rest, who))
                rest, who = rest[order], who[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(rest) != 0) | (np.diff(who) != 0)])) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rest)))
                off = np.concatenate([[0], np.cumsum(np.bincount(who[new], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(size.astype(np.int64)), pa.array(known), pa.array(unigram), pa.array(score),
                    pa.ListArray.from_arrays(off, pa.array(rest[new])), pa.ListArray.from_arrays(off, pa.array(times.astype(np.int32)))],
                    ["row", "n_tokens", "n_known", "unigram", "score", "words", "times"])
    return run


def score(docs: DataFrame, model: ClassModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row struct of ``keep``, n_tokens, n_known, unigram_score, score) of every row; the
    scores are log10 probabilities under add-one word frequencies and the class model."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.units, model.classes, model.transition, model.class_norm, model.hot, model.hot_count,
                           model.tokens, model.types, model.ends))
    packed = docs.select(row_struct(keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = pinned(packed.mapInArrow(
        _score_texts(shared), schema_of({"row": packed.schema["row"].dataType}, "n_tokens bigint, n_known bigint, unigram double, score double, words array<bigint>, times array<int>"),
    ).withColumn("rid", F.monotonically_increasing_id()), "scored")  # numbered once, as written
    tail = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    count = F.coalesce("n", F.lit(0))
    joined = tail.join(model.counts.select("word", "n"), "word", "left").groupBy("rid").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(count + 1.0)).alias("u"), F.sum(F.col("times") * F.log10(count + WORD_PRIOR)).alias("s"))
    return scored.select("rid", "row", "n_tokens", "n_known", "unigram", "score").join(joined, "rid", "left").select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"),
        (F.col("unigram") + F.coalesce("u", F.lit(0.0))).alias("unigram_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"))
