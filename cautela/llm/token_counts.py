"""Token counts by a linear longest-match automaton (operator 1).

The vocabulary is a byte trie. Every node has a failure link - where matching goes on after its pieces
are popped - and the number of pieces popped on the way. Both are folded into one transition table
``state, byte -> state, popped``, so counting takes one look-up a byte and builds no piece. All words of a
slice advance together, one byte a step.

Null and empty texts have 0 words and 0 tokens; a word that the vocabulary cannot spell counts as one
(unknown) token; repeated rows are counted each; extra columns are left out unless asked for with ``keep``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cautela.llm.common import slices, utf8, vocabulary_file, word_bounds

POPPED_SHIFT = 24
STATE_MASK = (1 << POPPED_SHIFT) - 1
#: With fewer words left the steps run word by word instead of as arrays.
NARROW = 24


class Automaton:
    """Greedy longest-match lengths for one vocabulary.

    ``initial`` pieces may start a word (after ``lead`` is put before it), ``inner`` pieces may follow;
    the usual word-piece vocabulary has both sets, a byte-level one uses the same pieces for both.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes] | None = None, lead: bytes = b""):
        initial = set(initial) - {b""}
        inner = initial if inner is None else set(inner) - {b""}
        shared = inner == initial
        child: list[dict[int, int]] = [{}]
        is_piece = [False]

        def insert(root: int, piece: bytes) -> None:
            node = root
            for byte in piece:
                step = child[node].get(byte)
                if step is None:
                    step = len(child)
                    child[node][byte] = step
                    child.append({})
                    is_piece.append(False)
                node = step
            is_piece[node] = True

        self.inner_root = 0
        for piece in inner:
            insert(0, piece)
        self.root = 0
        if not shared:
            self.root = len(child)
            child.append({})
            is_piece.append(False)
            for piece in initial:
                insert(self.root, piece)
        self.dead = len(child)
        if self.dead >= STATE_MASK:
            raise ValueError("The vocabulary has too many trie nodes.")
        self._link(child, is_piece, [0] if shared else [0, self.root])
        self.lead_state, self.lead_popped = self.root, 0
        for byte in lead:
            code = int(self.table[self.lead_state * 256 + byte])
            self.lead_state, self.lead_popped = code & STATE_MASK, self.lead_popped + (code >> POPPED_SHIFT)

    def _link(self, child: list[dict[int, int]], is_piece: list[bool], roots: list[int]) -> None:
        """Breadth first: a node's row is its failure state's row plus its popped count, then its own children."""
        size, dead = len(child), self.dead
        table = np.full((size + 1, 256), dead, np.uint32)
        fail = np.full(size + 1, dead, np.int64)
        popped = np.zeros(size + 1, np.int64)
        tail = np.full(size + 1, -1, np.int64)  # pieces left in a state at a word's end; -1: cannot be spelled
        tail[roots] = 0
        for root in roots:  # nothing to pop at a root: a byte without a child ends in the dead state
            for byte, node in child[root].items():
                table[root, byte] = node
        level = [(root, byte, node) for root in roots for byte, node in child[root].items()]
        while level:
            below = []
            for parent, byte, node in level:
                if is_piece[node]:
                    fail[node], popped[node] = self.inner_root, 1
                elif parent in roots:
                    fail[node], popped[node] = dead, 0
                else:
                    code = int(table[fail[parent], byte])
                    fail[node] = code & STATE_MASK
                    popped[node] = popped[parent] + (code >> POPPED_SHIFT)
                if tail[fail[node]] >= 0:
                    tail[node] = popped[node] + tail[fail[node]]
                if popped[node] > 255:
                    raise ValueError("A piece splits into more than 255 others.")
                row = table[fail[node]].copy()
                if fail[node] != dead:
                    row += np.uint32(popped[node] << POPPED_SHIFT)
                    row[(row & STATE_MASK) == dead] = dead
                for b, deeper in child[node].items():
                    row[b] = deeper
                    below.append((node, b, deeper))
                table[node] = row
            level = below
        self.tail = tail
        self.table = table.reshape(-1)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start:end]``."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.full(len(starts), self.lead_state, np.int64)
        total = np.full(len(starts), self.lead_popped, np.int64)
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        step = 0
        for step, n in enumerate(active):
            if n < NARROW:
                break
            codes = self.table[state[:n] * 256 + data[starts[:n] + step]]
            state[:n] = codes & STATE_MASK
            total[:n] += codes >> POPPED_SHIFT
        else:
            step = len(active)
        for i in range(int(active[step]) if step < len(active) else 0):
            s, t = int(state[i]), int(total[i])
            for byte in data[starts[i] + step : starts[i] + lengths[i]].tolist():
                code = int(self.table[s * 256 + byte])
                s, t = code & STATE_MASK, t + (code >> POPPED_SHIFT)
            state[i], total[i] = s, t
        left = self.tail[state]
        counts = np.empty(len(starts), np.int64)
        counts[order] = np.where(left < 0, 1, total + left)
        return counts


def byte_stand_ins() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte, from one rule."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes."""
    decode = {c: b for b, c in enumerate(byte_stand_ins())}
    with open(vocabulary_file(path), encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [bytes(decode[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


@lru_cache(maxsize=2)
def byte_level_automaton(path: str) -> Automaton:
    """Words are matched with one space before them, so the vocabulary's word-initial pieces apply."""
    return Automaton(byte_level_vocabulary(path), lead=b" ")


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words and n_tokens of every whole text; ``vocabulary`` is a file path on every node.

    A word is a run without white space (\\x20, \\x09-\\x0D). One pass, no shuffle.
    """
    source = df.select(*keep, df[text].cast("string").alias("_text"))
    schema = T.StructType(
        [*(source.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = byte_level_automaton(vocabulary)
        for batch in slices(batches, "_text"):
            data, offsets = utf8(batch.column("_text"))
            starts, ends, rows = word_bounds(data, offsets)
            words = np.bincount(rows, minlength=batch.num_rows)
            tokens = np.bincount(rows, weights=automaton.count(data, starts, ends), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(words, pa.int64()), pa.array(tokens.astype(np.int64))],
                [*names, "n_words", "n_tokens"],
            )

    return source.mapInArrow(run, schema)
