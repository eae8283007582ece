"""Token ids in ORC files (operator 6).

Ids are an array column: ORC stores integers run-length encoded, in stripes that tasks read in parallel, with a row
index per ``INDEX_ROWS`` rows and Bloom filters on the document id, so a look-up by id skips stripes and row groups from
their metadata. Documents are in ascending id order over the files (column ``seq`` counts along it).

Null text is empty and has the end id alone; a null document id sorts first; repeated ids are ordered by their texts;
other columns are not stored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cautela.llm.common import SPACE, WordMemory, slices, utf8, vocabulary_file
from cautela.llm.token_counts import byte_stand_ins

STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 64 << 20, 1000, 0.01
SCHEMA = "seq long, doc_id long, ids array<int>"
#: Marks that, at a word's end, are a pre-token of their own.
MARKS = ".,;:!?"
#: The vocabulary's printable stand-ins of bytes.
PRINTABLE = dict(enumerate(byte_stand_ins()))
GAP = PRINTABLE[ord(" ")]
#: Words encoded in one call.
CALL_WORDS = 2_000
#: Bytes of ASCII letters, and of ASCII characters that are neither letters nor white space.
LETTERS = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
OTHERS = ~LETTERS & ~SPACE & (np.arange(256) < 128)


class WordEncoder(WordMemory):
    """Encodes texts with the tokenizers library, each different word once.

    The pre-tokenizer of byte-level vocabularies always cuts before a single space and around a single line break
    that stand between other characters, and between a letter (here: an ASCII one) and what is neither a letter nor white
    space. Texts with no other white space and no added token are cut there; the rest go in whole. Texts are cut, their
    different pieces found and the ids put together as arrays; Python sees each different piece of a slice once.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_file(path))
        #: Added tokens, which the library finds in a text before it is cut into words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)  # each word comes once, looking it up is in vain
        self.marks = dict(zip(MARKS, self._ids(list(MARKS)), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _word(self, letters: str) -> bytes:
        """A single pre-token of letters and perhaps a space before them, which needs the model only."""
        if letters.isascii():  # letters stand for themselves
            printable = GAP + letters[1:] if letters[0] == " " else letters
        else:
            printable = letters.encode().decode("latin-1").translate(PRINTABLE)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(printable)]).tobytes()

    def learn(self, words: list[str]) -> None:
        rest, known, marks = [], self.known, self.marks
        for word in words:
            letters = word[1:] if word[0] == " " else word
            if letters.isalpha():
                if word not in known:
                    known[word] = self._word(word)
            elif letters[-1:] in marks and letters[:-1].isalpha():  # the pre-tokenizer cuts between letters and marks
                stem = word[:-1]
                ids = known.get(stem)
                if ids is None:
                    ids = known[stem] = self._word(stem)
                known[word] = ids + marks[word[-1]]
            else:
                rest.append(word)
        for start in range(0, len(rest), CALL_WORDS):
            part = rest[start : start + CALL_WORDS]
            known.update(zip(part, self._ids(part), strict=True))

    def whole(self, text: str) -> bytes:
        return self._ids([text])[0]

    def cuttable(self, text: str) -> bool:
        """Whether the text has single spaces and line breaks between other characters only, and no added token."""
        flat = text.replace("\n", " ")
        if not flat.isprintable() or "  " in flat or flat[:1] == " " or flat[-1:] == " ":
            return False  # a space is the only white space that counts as printable
        return not any(token in text for token in self.added)

    def column_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after the other, and how many each text has.

        The words of a text that can be cut, each with the space before it, what follows their letters, and line breaks are
        pieces; so is any other text as a whole.
        """
        data, offsets = utf8(column)
        if not data.size:
            return np.empty(0, "<u4"), np.zeros(len(column), np.int64)
        filled = np.flatnonzero(np.diff(offsets))
        whole = np.array([i for i in filled if not self.cuttable(column[i].as_py())], np.int64)
        breaks = data == ord("\n")
        cut = breaks | (data == ord(" "))
        cut[1:] |= breaks[:-1] | (LETTERS[data[:-1]] & OTHERS[data[1:]])
        for i in whole:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[filled]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, data.size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        of, different = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        apart = set(of[np.searchsorted(starts, offsets[whole])].tolist())
        if apart:
            found = iter(self.fetch([w for n, w in enumerate(different) if n not in apart]))
            encoded = [self.whole(w) if n in apart else next(found) for n, w in enumerate(different)]
        else:
            encoded = self.fetch(different)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        store = np.frombuffer(b"".join(encoded), "<u4")
        begins, counts = np.cumsum(sizes) - sizes, sizes[of]
        ends = np.cumsum(counts)
        ids = store[np.repeat(begins[of] - ends + counts, counts) + np.arange(ends[-1])]
        # Ids before a text are those of the pieces that begin before it.
        before = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids, np.diff(before)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.column_ids(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_ids(df: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """seq, doc_id and ids (with the end id) of rows (seq, doc_id, text), in the rows' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in slices(batches, "text"):
            found, counts = encoder.column_ids(batch.column("text"))
            values = np.insert(found, np.cumsum(counts), end_id).view(np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("doc_id"), ids], ["seq", "doc_id", "ids"])

    return df.select("seq", "doc_id", "text").mapInArrow(run, SCHEMA)


def encoded_lengths(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and length (number of ids with the end id) of rows (doc_id, text), as ``encode_ids`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in slices(batches, "text"):
            _, counts = encoder.column_ids(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts + 1)], ["doc_id", "length"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, length long")


def write_token_files(
    df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0
) -> None:
    """Encode every text and write the files; each holds a range of document ids."""
    named = df.select(df[doc_id].cast("long").alias("doc_id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    numbered = ordered.withColumn("seq", F.monotonically_increasing_id())
    writer = encode_ids(numbered, tokenizer, end_id).write.option("orc.bloom.filter.columns", "doc_id")
    writer = writer.option("orc.bloom.filter.fpp", str(BLOOM_FPP)).option("orc.row.index.stride", str(INDEX_ROWS))
    writer.option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """seq, doc_id, ids; filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    Starts add up within a file's range of documents; the totals of the ranges, one row each, are added up first.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("seq"), batch.column("doc_id"), counts, pa.array(crc, pa.int64())],
                ["seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    part, stored = F.shiftright("seq", 33).alias("part"), read_token_files(spark, path)
    rows = stored.mapInArrow(digest, "seq long, doc_id long, n_tokens long, ids_crc32 long").select("*", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored.groupBy(part).agg(F.sum(F.size("ids").cast("long")).alias("total"))
    offsets = ranges.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return counted.join(offsets, "part").select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
