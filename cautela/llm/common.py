"""What the operators share: input tables, tables handed over in the shared folder, Arrow text slices."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.session import checkpoint_root

#: Text worked on at once inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20
#: White space of the word contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file on the machine that asks; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in the folder that the cluster shares; a lost executor re-reads them instead of recomputing.

    Results are lazy and may still read these tables, so the run does not delete them; ``drop`` is for
    a table that later ones have replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/t{self.count}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def release(self) -> None:
        """Have the shuffle files of finished writes deleted: Spark does so when the driver's memory of them is collected,
        which a job of many writes and few objects otherwise waits for until the disks are full."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for saved in tables:
            self._drop(saved)

    def _drop(self, saved: DataFrame) -> None:
        location = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved._scratch_path)
        location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


#: Bits of a pre-filter, in pages of 2^15; 16 MB as arrays of words, however many keys it has seen.
FILTER_BITS = 1 << 26


def prefilter(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``keys`` (one column of the same name): few false ones, no misses.

    The keys' hashes set bits of a bitmap of fixed size, the only thing broadcast, so that a join that follows
    shuffles little more than what it keeps. With very many keys it lets more rows through and stays right.
    """
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    bitmaps = keys.select(F.shiftright(place, 15).alias("_page"), place.bitwiseAND((1 << 15) - 1).alias("_bit"))
    bitmaps = bitmaps.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    # Each page as 32-bit words, so that a look-up is one array access; within a word the first byte is the highest.
    words = F.transform(
        F.sequence(F.lit(0), F.lit((1 << 10) - 1)),
        lambda i: F.conv(F.hex(F.substr(F.col("_bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("long"),
    )
    bitmaps = bitmaps.select("_page", words.alias("_words"))
    shift = F.expr("cast(24 - 8 * (shiftright(_at, 3) & 3) + (_at & 7) as int)")
    word = F.get(F.col("_words"), F.shiftright("_at", 5).cast("int"))
    hit = F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1)) == 1
    marked = df.withColumn("_page", F.shiftright(place, 15)).withColumn("_at", place.bitwiseAND((1 << 15) - 1))
    bitmaps = F.broadcast(bitmaps.withColumnRenamed("_page", "_its_page"))
    met = marked.join(bitmaps, (F.col("_page") == F.col("_its_page")) & hit)
    return met.select(*(df[c] for c in df.columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that each piece has about ``limit`` bytes of text or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run without white space; runs end where a text ends."""
    if not data.size:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    cuts = offsets[:-1][offsets[:-1] < data.size]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


#: Bytes that a remembered word takes beside its letters and ids, and bytes in each of the two generations that a worker remembers.
ENTRY_BYTES, REMEMBERED_BYTES = 180, 128 << 20


class WordMemory:
    """Encodes texts word by word, each different word once; subclasses say how texts are cut and words encoded."""

    #: Most bytes of a generation.
    most = REMEMBERED_BYTES

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def cut(self, text: str) -> list[str] | None:
        """Words whose encodings make up the text's; None if it has to be encoded in one."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def learn(self, words: list[str]) -> None:
        """Put the words' encodings into ``known``."""
        raise NotImplementedError

    def fetch(self, words: list[str]) -> list[bytes]:
        """Encodings of different words."""
        if self.held > self.most:  # words that come again move over from the older generation
            self.older, self.known, self.held = self.known, {}, 0
        found = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        missing = []
        for i in new:
            ids = self.older.get(words[i])
            if ids is None:
                missing.append(words[i])
            else:
                self.known[words[i]] = ids
        self.learn(missing)
        for i in new:
            found[i] = self.known[words[i]]
            self.held += ENTRY_BYTES + len(words[i]) + len(found[i])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        needed = list(set().union(*(words for words in cut if words is not None)))
        known = dict(zip(needed, self.fetch(needed), strict=True)).__getitem__
        return [
            self.whole(text) if words is None else b"".join(map(known, words)) for text, words in zip(texts, cut, strict=True)
        ]
