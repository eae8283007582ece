"""Language identification with a string kernel (operator 5).

The kernel of two texts is the number of character n-grams (1 to ``LONGEST``, a blended spectrum) that both contain,
whatever their counts, normalised by the sizes of the two sets. Landmarks from the training sample give the Nyström map;
one-versus-rest ridge regression in its space gives a weight per landmark and language. Texts are scored in batches:
presence matrix times landmark matrix, then times the weights.

Characters are lower-cased one by one; every letter of every script counts as itself, all else as a gap. An n-gram is a
place of a table of ``WIDTH`` that the hash of its characters gives, so presence has a fixed size and whole texts of any length
are read; two n-grams share a place with a chance of 1 / WIDTH.

Training: labelled texts of at most ``MAX_CHARS`` characters (longer ones are left out, not cut), at most ``PER_LANGUAGE``
different ones of each language and about ``TRAINING_ROWS`` in all, shared equally by however many languages there are; the same
ones at every partitioning. Repeated rows count once. ``LANDMARKS`` of a language, ``ALL_LANDMARKS`` at most, are the landmarks.
Prediction reads the text only. A null text or one without
letters is ``und`` with score 0, and so is every text if there is nothing to learn from; repeated rows are predicted each;
extra columns are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cautela.llm.common import slices, utf8

LONGEST, WIDTH_BITS = 3, 18
WIDTH = 1 << WIDTH_BITS
#: Bounds of the training sample and of the landmarks taken from it. No language is left out for them.
PER_LANGUAGE, TRAINING_ROWS, MAX_CHARS, LANDMARKS, ALL_LANDMARKS = 400, 20_000, 8_000, 60, 3_000
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts of a slice whose presence is held at once.
ROWS = 64
#: N-grams whose presence is held as numbers at once.
COLUMNS = 1 << 13


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Lower-case form of each letter by code point; 0 for everything that is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


_RANDOM = np.random.default_rng(20_250_305)
PLACES = _RANDOM.integers(1, 2**63, LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _places(codes: np.ndarray, n: int) -> np.ndarray:
    """Places of the n-grams that begin at each letter."""
    value = np.full(len(codes) - n + 1, n, np.uint64) * PLACES[-1]
    for k in range(n):
        value += codes[k : k + len(value)].astype(np.uint64) * PLACES[k]
    value ^= value >> np.uint64(29)
    return ((value * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams each text contains, and whether it has a letter. Gaps have no 1-gram, runs of gaps none at all."""
    joined = "".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass")
    codes = folded()[np.frombuffer(joined, "<u4")]
    lengths = np.array([len(t) + 1 for t in texts])
    rows = np.repeat(np.arange(len(texts)), lengths)
    # One gap after a word is enough; the line break after a text is such a gap.
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes, rows = codes[keep], rows[keep]
    found = np.zeros((len(texts), WIDTH), bool)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        inside = rows[: len(codes) - n + 1] == rows[n - 1 :]
        if n == 1:
            inside &= codes > 0
        found[rows[: len(inside)][inside], _places(codes, n)[inside]] = True
    return found, np.bincount(rows[codes > 0], minlength=len(texts)) > 0


@dataclass
class LanguageModel:
    languages: list[str]
    columns: np.ndarray  # n-grams that some landmark contains
    landmarks: np.ndarray
    landmark_sizes: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-rest scores (texts x languages) and which texts have letters."""
        found, has_letters = presence(texts)
        values = kernel(found[:, self.columns], found.sum(axis=1), self.landmarks, self.landmark_sizes)
        return values @ self.weights, has_letters


def kernel(found: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of texts and landmarks; the sizes count all n-grams, the rows only shared columns."""
    common = np.zeros((len(found), len(landmarks)), np.float32)  # whole numbers below 2^24: exact in any order
    for start in range(0, found.shape[1], COLUMNS):
        part = slice(start, start + COLUMNS)
        common += found[:, part].astype(np.float32) @ landmarks[:, part].astype(np.float32).T
    return common / np.maximum(np.sqrt(np.outer(sizes, landmark_sizes)), 1)


def fit_kernel_model(rows: list[tuple[str, str]]) -> LanguageModel | None:
    """Model from (text, language) pairs in a fixed order; None without any text that has letters."""
    fold = folded()
    rows = [r for r in rows if fold[np.frombuffer(r[0].encode("utf-32-le", "surrogatepass"), "<u4")].any()]
    if not rows:
        return None
    languages = sorted({r[1] for r in rows})
    most = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    chosen, taken = [], dict.fromkeys(languages, 0)
    for i, (_, language) in enumerate(rows):
        if taken[language] < most:
            taken[language] += 1
            chosen.append(i)
    # With more languages than landmarks the rest of them is told from the landmarks of the others.
    chosen = chosen[:: -(-len(chosen) // ALL_LANDMARKS)]
    parts = [presence([rows[i][0] for i in chosen[start : start + ROWS]])[0] for start in range(0, len(chosen), ROWS)]
    columns = np.flatnonzero(np.any([p.any(axis=0) for p in parts], axis=0))
    landmark_sizes = np.concatenate([p.sum(axis=1) for p in parts])
    landmarks = np.concatenate([p[:, columns] for p in parts])
    parts = []
    for start in range(0, len(rows), ROWS):
        part = presence([t for t, _ in rows[start : start + ROWS]])[0]
        parts.append(kernel(part[:, columns], part.sum(axis=1), landmarks, landmark_sizes))
    # Nyström: K(x, L) (K(L, L))^-1/2 are the features of ridge regression.
    values, vectors = np.linalg.eigh(kernel(landmarks, landmark_sizes, landmarks, landmark_sizes).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate(parts) @ root
    targets = np.array([[float(language == known) for known in languages] for _, language in rows])
    # Every language weighs the same, however many of its texts were found.
    share = targets.sum(axis=0)
    weight = (targets / share).sum(axis=1) * len(rows) / len(languages)
    gram = features.T @ (features * weight[:, None]) + RIDGE * len(rows) * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, features.T @ (targets * weight[:, None]))
    return LanguageModel(languages, columns, landmarks, landmark_sizes, weights)


def training_sample(df: DataFrame, text: str, language: str, row_id: str) -> list[tuple[str, str]]:
    """The (text, language) rows with the lowest hash of id and text, each once; see the bounds above.

    Counts of different rows per language set the share of the hash range that is read, with room for chance; so few rows more
    than are kept reach the driver, however often a row is repeated, and no group is sorted.
    """
    usable = df.select(F.col(text).alias("text"), F.col(language).alias("language"), F.xxhash64(row_id, text).alias("h"))
    usable = usable.filter(F.col("text").isNotNull() & F.col("language").isNotNull() & (F.char_length("text") <= MAX_CHARS))
    counts = usable.select("language", "h").distinct().groupBy("language").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    most = max(1, min(PER_LANGUAGE, TRAINING_ROWS // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.language, min(1.0, (1.3 * most + 60) / r.n))))
    place = (F.col("h") / F.lit(2.0**64)) + 0.5
    sample = usable.filter(place <= share[F.col("language")]).dropDuplicates(["language", "h"]).collect()
    kept: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.h, r.text)):
        if len(kept.setdefault(r.language, [])) < most:
            kept[r.language].append((r.text, r.language))
    return [row for language in sorted(kept) for row in kept[language]]


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` (without the text unless ``keep_text``) and a struct ``language_id`` (language, score).

    The score is the winning regression value held to 0...1 (1 stands for the training texts of that language).
    """
    if "language_id" in df.columns:
        raise ValueError("The table has a column named like the result: language_id")
    others = [c for c in df.columns if keep_text or c != text]
    row = F.struct(*(F.col(c) for c in others)) if others else F.struct(F.lit(None).alias("none"))
    # A text that is among the other columns is handed over once.
    inside = others.index(text) if text in others and df.schema[text].dataType == T.StringType() else None
    packed = df.select(row.alias("_row"), *([F.col(text).cast("string").alias("_text")] if inside is None else []))
    schema = T.StructType(
        [packed.schema["_row"], T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    handed = df.sparkSession.sparkContext.broadcast(model)  # bounded: ALL_LANDMARKS rows of a table of WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = handed.value
        if inside is not None:
            batches = (pa.RecordBatch.from_arrays([b.column("_row"), b.column("_row").field(inside)], ["_row", "_text"]) for b in batches)
        for batch in slices(batches, "_text"):
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = ["" if t is None else t for t in part.column("_text").to_pylist()]
                names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known is not None:
                    scores, has_letters = known.scores(texts)
                    best = scores.argmax(axis=1)
                    values = np.where(has_letters, np.clip(scores.max(axis=1), 0, 1), 0.0)
                    names = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                    ["_row", "language", "score"],
                )

    told = packed.mapInArrow(run, schema)
    return told.select(*(F.col("_row")[c].alias(c) for c in others), F.struct("language", "score").alias("language_id"))


def held_out(row_id: str) -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_languages(df: DataFrame, text: str = "text", language: str = "lang", row_id: str = "doc_id") -> LanguageModel | None:
    return fit_kernel_model(training_sample(df.filter(~held_out(row_id)), text, language, row_id))
