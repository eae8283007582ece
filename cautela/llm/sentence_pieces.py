"""SentencePiece encoding and decoding by suffix-array matching (operator 3).

The different words of a batch that the worker has not met lately are concatenated; their suffixes, sorted by as many characters as the longest piece has,
form a suffix array. Every piece of the vocabulary finds its range of occurrences there by binary search. The
occurrences are the edges of the words' lattices; sorted by the position where they end, they are relaxed from left to
right, all words at once.

The public model is a BPE model, whose result is not the best-scored path. Relaxing therefore keeps, for each position,
the one edge that the merges would end with: an edge is taken if its piece and the last piece at its start stay two
pieces when they are merged on their own (such local agreement determines the whole result). Longer edges are tried first.

Characters outside the vocabulary fall back to byte pieces. A null text has null ids, an empty one none; decoding gives
the text back unless it contains the escape character for spaces or more than one such meaning. Repeated rows are encoded
each; extra columns are passed through, one named like the result is an error; an empty table gives no rows. Runs of spaces have equal
scores and are merged as they stand, as are texts that hold a \\0.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cautela.llm.common import REMEMBERED_BYTES, WordMemory, slices, vocabulary_file

SPACE_MARK = "▁"
#: Characters of words that are indexed together.
INDEX_CHARS = 120_000
#: Pairs of pieces whose agreement a worker remembers.
AGREED = 500_000
BARRIER, NOT_SET = -2, -1


class PieceEncoder(WordMemory):
    """A model's vocabulary; ``learn`` is the suffix-array matching, ``merge`` the plain merging of one string."""

    most = REMEMBERED_BYTES // 2

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(path))
        self.pieces: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece], self.scores[piece] = i, model.get_score(i)
        self.text_of = {i: p for p, i in self.pieces.items()}
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}|\n", p) for p in self.pieces):
            raise ValueError("Pieces that go beyond a word are not supported.")
        self.longest = max(map(len, self.pieces))
        chars = sorted(set("".join(self.pieces)))
        self.codes = np.full(0x110000, 0xFFFF, ">u2")  # outside the vocabulary; 0 ends a word
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        names = sorted(self.pieces)
        keys = np.zeros((len(names), self.longest), ">u2")
        for row, name in enumerate(names):
            keys[row, : len(name)] = self.codes[[ord(c) for c in name]]
        self.key_ids = np.array([self.pieces[n] for n in names])
        self.key_lengths = np.array([len(n) for n in names])
        ends = keys.copy()
        ends[np.arange(self.longest)[None, :] >= self.key_lengths[:, None]] = 0xFFFF
        self.first_keys, self.last_keys = self._keys(keys), self._keys(ends)
        self.agreed: dict[int, bool] = {}  # at most AGREED pairs
        self.single = np.full(model.get_piece_size(), NOT_SET, np.int8)

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(f"S{2 * self.longest}").ravel()

    def cut(self, text: str) -> list[str] | None:
        """Words with the marks before them, and line breaks, beyond which no piece goes."""
        if not text:
            return []
        if "\0" in text:
            return None
        marked = (" " + text).replace(" ", SPACE_MARK)
        if SPACE_MARK * 2 in marked:
            return re.findall(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+", marked)
        return [w for w in marked.replace("\n", "\0\n\0").replace(SPACE_MARK, "\0" + SPACE_MARK).split("\0") if w]

    def whole(self, text: str) -> bytes:
        return self.merge((" " + text).replace(" ", SPACE_MARK))

    def merge(self, text: str) -> bytes:
        """Best-scored neighbours are merged first, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                joined = parts[i] + parts[j]
                score = self.scores.get(joined)
                if score is not None:
                    heapq.heappush(heap, (-score, i, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        ids: list[int] = []
        for part in parts:
            if part is not None:
                known = self.pieces.get(part)
                ids += [known] if known is not None else [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging two neighbouring pieces' text leaves just these two."""
        pairs = left.astype(np.int64) << 20 | right
        distinct, inverse = np.unique(pairs, return_inverse=True)
        found = np.empty(len(distinct), bool)
        if len(self.agreed) > AGREED:
            self.agreed.clear()
        for k, pair in enumerate(distinct.tolist()):
            known = self.agreed.get(pair)
            if known is None:
                a, b = pair >> 20, pair & 0xFFFFF
                known = self.merge(self.text_of[a] + self.text_of[b]) == np.array([a, b], "<u4").tobytes()
                self.agreed[pair] = known
            found[k] = known
        return found[inverse]

    def _stands(self, ids: np.ndarray) -> np.ndarray:
        """Whether merging a piece's own text gives the piece."""
        for i in np.unique(ids[self.single[ids] == NOT_SET]).tolist():
            self.single[i] = self.merge(self.text_of[i]) == np.array([i], "<u4").tobytes()
        return self.single[ids] == 1

    def learn(self, words: list[str]) -> None:
        group, size = [], 0
        for word in words:
            if SPACE_MARK * 2 in word:  # runs of marks have equal scores: merged as they stand
                self.known[word] = self.merge(word)
                continue
            group.append(word)
            size += len(word) + 1
            if size >= INDEX_CHARS:
                self._match(group)
                group, size = [], 0
        if group:
            self._match(group)

    def _match(self, words: list[str]) -> None:
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        codes = self.codes[points]
        codes[ends] = 0
        # Suffixes by their first characters; what follows a word's end must not count.
        padded = np.concatenate([codes, np.zeros(self.longest, ">u2")]).astype(">u2")  # byte order is lost on joining
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(codes)].copy()
        rest = np.repeat(ends, lengths + 1) - np.arange(len(codes))
        windows[np.arange(self.longest)[None, :] >= rest[:, None]] = 0
        keys = self._keys(windows)
        suffixes = np.argsort(keys, kind="stable")
        keys = keys[suffixes]
        low, high = np.searchsorted(keys, self.first_keys, "left"), np.searchsorted(keys, self.last_keys, "right")
        counts = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        begin, piece, span = suffixes[at], np.repeat(self.key_ids, counts), np.repeat(self.key_lengths, counts)
        # Edges by end, longer first; positions count within the word so that all words advance together.
        word_start = np.repeat(starts, lengths + 1)
        end = begin + span
        place = end - word_start[begin]
        order = np.lexsort((-span, place))
        begin, piece, span, end, place = (x[order] for x in (begin, piece, span, end, place))
        last = np.full(len(codes) + 1, NOT_SET, np.int64)
        outside = np.flatnonzero(codes == 0xFFFF)
        last[outside + 1] = BARRIER
        last_at_start = np.zeros(len(codes) + 1, bool)
        last_at_start[starts] = True
        step = place * (self.longest + 1) + self.longest - span
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(step)], strict=True):
            open_ = np.flatnonzero(last[end[a:b]] == NOT_SET) + a
            if not len(open_):
                continue
            previous, pieces = last[begin[open_]], piece[open_]
            free = last_at_start[begin[open_]] | (previous == BARRIER)
            good = np.zeros(len(open_), bool)
            good[free] = self._stands(pieces[free])
            bound = ~free & (previous >= 0)
            good[bound] = self._agree(previous[bound], pieces[bound])
            last[end[open_[good]]] = pieces[good]
        size = np.array([len(self.text_of.get(i, " ")) for i in range(len(self.single))])
        found_word, found_piece, cursor, alive = [], [], ends.copy(), np.flatnonzero(lengths > 0)
        while len(alive):
            taken = last[cursor[alive]]
            found_word.append(alive)
            found_piece.append(np.where(taken == BARRIER, -cursor[alive], taken))  # where to look up the character
            cursor[alive] -= np.where(taken == BARRIER, 1, size[taken])
            alive = alive[cursor[alive] > starts[alive]]
        if not found_word:
            return
        word_of, piece_of = np.concatenate(found_word), np.concatenate(found_piece)
        turn = np.repeat(np.arange(len(found_word)), [len(w) for w in found_word])
        order = np.lexsort((-turn, word_of))
        word_of, piece_of = word_of[order], piece_of[order]
        edges = np.searchsorted(word_of, np.arange(len(words) + 1))
        raw = piece_of.astype("<u4").tobytes()
        rough = np.unique(word_of[piece_of < 0])
        for i, (word, a, b) in enumerate(zip(words, edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            self.known[word] = raw[4 * a : 4 * b]
        for i in rough.tolist():  # bytes of characters outside the vocabulary
            ids: list[int] = []
            for p in piece_of[edges[i] : edges[i + 1]].tolist():
                char = "" if p >= 0 else chr(int(points[-p - 1]))
                ids += [p] if p >= 0 else [self.byte_ids[x] for x in char.encode("utf-8", "surrogatepass")]
            self.known[words[i]] = np.array(ids, "<u4").tobytes()


class PieceDecoder:
    """The bytes of each piece, and nothing else of a model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(path))
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE_MARK, " ").encode())

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def _decoder(path: str) -> PieceDecoder:
    return PieceDecoder(path)


def _with_columns(df: DataFrame, source: str, fields: list[T.StructField], run) -> DataFrame:
    """``df`` with new last columns made by an Arrow function of the column ``source``."""
    clash = {f.name for f in fields} & set(df.columns)
    if clash:
        raise ValueError(f"The table has columns named like the result: {sorted(clash)}")
    packed = df.select(F.struct("*").alias("row"), F.col(source).alias("source"))
    made = packed.mapInArrow(run, T.StructType([packed.schema["row"], *fields]))
    return made.select(*(F.col("row")[c].alias(c) for c in df.columns), *(f.name for f in fields))


def _encoded(texts: list[str | None], model: str) -> pa.ListArray:
    found = _encoder(model).encode([t or "" for t in texts])
    missing = np.array([t is None for t in texts], bool)
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    values = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(missing))


def _decoded(lists: pa.ListArray, model: str) -> pa.Array:
    decode = _decoder(model).decode
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    texts = [
        None if gone else decode(values[a:b].tolist())  # one row's ids at a time as Python numbers
        for gone, a, b in zip(missing, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    ]
    return pa.array(texts, pa.string())


def encode_pieces(df: DataFrame, model: str, text: str = "text", name: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """All columns and the ids of every whole text; ``model`` is a public tokenizer's name or a file path on every node.

    With ``decoded`` the ids are decoded again in the same worker, into a column of that name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "source"):
            columns = [batch.column("row"), _encoded(batch.column("source").to_pylist(), model)]
            columns += [_decoded(columns[1], model)] if decoded else []
            yield pa.RecordBatch.from_arrays(columns, ["row", name, decoded][: len(columns)])

    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []
    return _with_columns(df, text, fields, run)


def decode_pieces(df: DataFrame, model: str, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """All columns and the text of every list of ids (null: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), _decoded(batch.column("source"), model)], ["row", name])

    return _with_columns(df, ids, [T.StructField(name, T.StringType())], run)
