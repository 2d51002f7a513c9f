"""Word-piece counts by a linear longest-match automaton.

The vocabulary's trie gets failure links and, on each link, the number of pieces that
following it completes.  One pass over a word's characters then gives the length of its
greedy longest-match tokenisation; no piece is built and no character is read twice.

Words are split at Unicode white space and start with ``word_prefix``; pieces that do not
start a word carry ``suffix_indicator`` ("" if the vocabulary makes no difference).  A word
that greedy matching cannot finish counts as one unknown token.

Cases: null, empty and blank texts have 0 words and 0 tokens; a word or text of any length
is read once, in bounded pieces; repeated rows are counted as rows; other columns are
kept, except that ``n_words``, ``n_tokens`` and ``n_unknown`` are replaced; an empty
vocabulary makes every word unknown.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import fresh_name, quoted, schema_of

MAX_VOCAB = 2_000_000  # bound of the broadcast vocabulary
CACHE_WORDS = 200_000
CACHED_CHARS = 48
BLOCK_CHARS = 1 << 20
UNKNOWN = 1 << 32  # a word's count holds its unknown flag above this bit


@dataclass
class Automaton:
    children: list[dict[str, int]]
    fail: list[int]  # -1: none
    pops: list[int]  # pieces completed by following the failure link
    root: int
    suffix_root: int
    word_prefix: str

    def count(self, word: str) -> int:
        """Pieces of a word; ``1 + UNKNOWN`` if it cannot be tokenised."""
        children, fail, pops = self.children, self.fail, self.pops
        state, n = self.root, 0
        for part in (self.word_prefix, word):
            for c in part:
                while c not in children[state]:
                    if fail[state] < 0:
                        return 1 + UNKNOWN
                    n += pops[state]
                    state = fail[state]
                state = children[state][c]
        while state != self.suffix_root:
            if fail[state] < 0:
                return 1 + UNKNOWN
            n += pops[state]
            state = fail[state]
        return n


def build(pieces: Iterable[str], suffix_indicator: str = "##", word_prefix: str = "") -> Automaton:
    pieces = [p for p in dict.fromkeys(pieces) if p]
    if len(pieces) > MAX_VOCAB:
        raise ValueError(f"more than {MAX_VOCAB} pieces")
    children: list[dict[str, int]] = [{}]
    root = 0
    if suffix_indicator:
        children.append({})
    suffix_root = len(children) - 1
    final = set()
    for p in pieces:
        state = root
        if suffix_indicator and p.startswith(suffix_indicator) and len(p) > len(suffix_indicator):
            state, p = suffix_root, p[len(suffix_indicator):]
        for c in p:
            nxt = children[state].get(c)
            if nxt is None:
                nxt = children[state][c] = len(children)
                children.append({})
            state = nxt
        final.add(state)
    fail, pops = [-1] * len(children), [0] * len(children)
    level = sorted({root, suffix_root})
    while level:  # breadth first: a failure link always leads to a shallower state
        below = []
        for u in level:
            for c, v in children[u].items():
                below.append(v)
                if v in final:
                    fail[v], pops[v] = suffix_root, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in children[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][c], n
        level = below
    return Automaton(children, fail, pops, root, suffix_root, word_prefix)


def sentencepiece_pieces(path: str) -> list[str]:
    """Normal pieces of a SentencePiece model (its word mark is a character of the piece)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class _Counts(dict):
    """Memo of short words; cleared when full, so memory is bounded and results never change."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def _blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, a block of characters at a time."""
    if len(text) <= BLOCK_CHARS:
        yield text.split()
        return
    rest = ""
    for a in range(0, len(text), BLOCK_CHARS):
        piece = text[a: a + BLOCK_CHARS]
        words = (rest + piece).split()
        rest = words.pop() if words and not piece[-1].isspace() else ""
        yield words
    yield rest.split()


def token_counts(docs: DataFrame, automaton: Automaton, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_tokens and n_unknown (long)."""
    own = ("n_words", "n_tokens", "n_unknown")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    pad = fresh_name("_pad", keep)  # a struct needs a field even where nothing is kept
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in keep], F.lit(0).alias(pad))
    packed = docs.select(row.alias("row"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                for words in _blocks(text.as_py()):
                    n = sum(map(counts.__getitem__, words))
                    out[0, i] += len(words)
                    out[1, i] += n & (UNKNOWN - 1)
                    out[2, i] += n >> 32
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["row", *own])

    return packed.mapInArrow(count, schema_of({"row": packed.schema["row"].dataType}, "n_words bigint, n_tokens bigint, n_unknown bigint")).select(
        *[F.col("row")[c].alias(c) for c in keep], *own)
