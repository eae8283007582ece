"""Best-fit packing into sequences of several permitted lengths (operator 10).

Documents, longest first, go into the open bin that they fill best. Where none has room, a bin of the size is opened whose
cost per token that can still fill it is least. At the end each bin shrinks to the smallest permitted size that holds its
contents. How large bins are opened at most is decided jointly: every permitted size is tried as that limit, and the
packing with the least total cost is taken. A longer document is cut into full sequences and a rest; no token is dropped.

Documents are dealt at random over shards of about ``SHARD_ITEMS`` pieces, packed independently; only a shard's last bins
are worse for it. The number of shards follows from the number of pieces.

A text takes the ids that operator 6 writes for it, its end id among them, so cuts and capacities hold for the encoded text
and null and empty texts take one place; rows without id are packed as well;
repeated rows are packed each; equal lengths go in the order of the stored lengths. Other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cautela.llm.common import Scratch
from cautela.llm.token_files import encoded_lengths

SIZES = (1024, 2048, 4096, 8192)
#: Cost of a sequence: its length, its square over SQUARE_OVER (what attention adds) and a fixed part.
SQUARE_OVER, FIXED = 32_768, 128
SHARD_ITEMS = 40_000
RESULT = "doc_id long, piece int, n_tokens long, bin_id long, start long, capacity long"


def cost(size: int) -> float:
    return size + size * size / SQUARE_OVER + FIXED


def pack_once(lengths: list[int], sizes: tuple[int, ...], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each item (lengths descending), and the final size of each bin; opens up to ``limit`` if it can."""
    bins, starts, filled = [], [], []
    free: dict[int, list[int]] = {}  # bins by the room that is left in them
    rooms = 0  # bit r: some bin has room r
    left = sum(lengths)
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            at, wide = len(filled), [s for s in sizes if s >= length]
            allowed = [s for s in wide if s <= limit] or wide[:1]
            room = min(allowed, key=lambda s: (cost(s) / min(s, left), s))
            filled.append(0)
        bins.append(at)
        starts.append(filled[at])
        filled[at] += length
        left -= length
        if room > length:
            free.setdefault(room - length, []).append(at)
            rooms |= 1 << (room - length)
    return bins, starts, [next(s for s in sizes if s >= f) for f in filled]


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings over all limits; lengths descending, none above the largest size."""
    return min((pack_once(lengths, sizes, limit) for limit in sizes), key=lambda found: sum(map(cost, found[2])))


def pack_lengths(lengths: DataFrame, scratch: Scratch, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Pieces of rows (doc_id, length) with their bins; lengths are at least 1."""
    sizes = tuple(sorted(sizes))
    top = F.lit(sizes[-1])
    saved = scratch.save(lengths.select("doc_id", "length"))
    # Read from files, a row has the same number at every reading.
    rows = saved.withColumn("row", F.monotonically_increasing_id())
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / top) - 1).cast("int"))))
    total = saved.agg(F.sum(F.ceil(F.col("length") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_ITEMS))
    pieces = pieces.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("long").alias("shard"),
        "row",
        "doc_id",
        "piece",
        F.least(top.cast("long"), F.col("length") - F.col("piece").cast("long") * top).alias("n_tokens"),
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("row", "ascending"), ("piece", "ascending")])
        bins, starts, capacities = pack(table.column("n_tokens").to_pylist(), sizes)
        at = np.array(bins, np.int64)
        first = int(table.column("shard")[0].as_py()) << 32
        columns = [table.column(c) for c in ("doc_id", "piece", "n_tokens")]
        columns += [pa.array(first + at), pa.array(starts, pa.int64()), pa.array(np.array(capacities, np.int64)[at])]
        return pa.table(columns, ["doc_id", "piece", "n_tokens", "bin_id", "start", "capacity"])

    return pieces.groupBy("shard").applyInArrow(run, RESULT)


def pack_documents(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES
) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, start (within the bin) and capacity of every piece of every whole text."""
    named = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return pack_lengths(encoded_lengths(named, tokenizer), Scratch(df.sparkSession, "packing"), sizes)
