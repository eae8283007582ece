"""Vector tables as bounded blocks, and the block join of a query set with all rows.

Vectors lie near one of a fixed number of pivots; rows of one pivot are dealt over ``SALTS`` streams and cut into
blocks, so that a block is a compact region and no pivot, however popular, is one task's work. A group of the join is
one block of queries with at most ``SHARD_BLOCKS`` blocks of data; it returns only its best ``k`` per query.

Rows without id, and vectors that are null, empty or hold null or non-finite components, take no part. Vectors meet
only vectors of their own length. A candidate with the query's id is the query itself; repeated rows are candidates
each; queries that share an id are answered once, for the greatest of their vectors. Columns other than id and vector
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cautela.llm.common import Scratch

PIVOTS, SALTS = 64, 16
BLOCK_ROWS, QUERY_ROWS, SHARD_BLOCKS = 2048, 1024, 8


def usable(vector: Column, zero: bool = True) -> Column:
    """All components present and finite; with ``zero=False`` some component differs from 0."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf))
    found = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return found if zero else found & F.exists(vector, lambda x: x != 0)


def prepared(df: DataFrame, row_id: str, vector: str, zero: bool) -> DataFrame:
    """Columns id (long) and vec (array of double) of the rows that take part."""
    named = df.select(df[row_id].cast("long").alias("id"), df[vector].alias("vec"))
    return named.filter(F.col("id").isNotNull() & usable(F.col("vec"), zero)).select(
        "id", F.col("vec").cast("array<double>").alias("vec")
    )


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column that all have ``dim`` entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """At most ``PIVOTS`` vectors, chosen by hash; they only shape the blocks, results do not depend on them."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    found: dict[int, list] = {}
    for row in sample:
        found.setdefault(len(row.vec), []).append(row.vec)
    return {dim: np.array(vectors, dtype=np.float64) for dim, vectors in found.items()}


def pack(rows: DataFrame, pivots: dict[int, np.ndarray], size: int, arrange: Callable | None = None) -> DataFrame:
    """One row per block: dim, ids, vecs and tree (bytes). ``arrange(ids, vecs)`` may reorder and add the tree."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("vec").offsets.to_numpy())
            cell = np.full(batch.num_rows, -1, np.int32)
            for dim in np.unique(lengths):
                if int(dim) in pivots:
                    at = np.flatnonzero(lengths == dim)
                    x, p = matrix(batch.column("vec").take(pa.array(at)), int(dim)), pivots[int(dim)]
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[at] = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, axis=1)
            columns = [batch.column("id"), batch.column("vec"), pa.array(lengths.astype(np.int32)), pa.array(cell)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "dim", "cell"])

    placed = rows.mapInArrow(place, "id long, vec array<double>, dim int, cell int")
    dealt = placed.repartition(F.col("dim"), F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions(
        "dim", "cell", "id"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, ids, vecs, held = None, [], [], 0

        def flush():
            i, v = np.concatenate(ids), np.concatenate(vecs)
            i, v, tree = arrange(i, v) if arrange else (i, v, b"")
            names = ["dim", "ids", "vecs", "tree"]
            values = [[int(dim)], [i.astype("<i8").tobytes()], [v.astype("<f8").tobytes()], [tree]]
            types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], names)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            start = 0
            while start < batch.num_rows:
                if held and (held >= size or dims[start] != dim):
                    yield flush()
                    ids, vecs, held = [], [], 0
                dim = dims[start]
                same = int(np.searchsorted(dims, dim, "right"))
                stop = min(same, start + size - held)
                piece = batch.slice(start, stop - start)
                ids.append(piece.column("id").to_numpy())
                vecs.append(matrix(piece.column("vec"), int(dim)))
                held += stop - start
                start = stop
        if held:
            yield flush()

    return dealt.select("dim", "id", "vec").mapInArrow(cut, "dim int, ids binary, vecs binary, tree binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vecs"], "<f8").reshape(len(ids), row["dim"])


def block_join(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    search: Callable[[list[dict], list[dict]], tuple[np.ndarray, np.ndarray, np.ndarray]],
    score_type: str,
    arrange: Callable | None = None,
) -> DataFrame:
    """``search(query blocks, data blocks)`` gives (query ids, vec ids, scores); the best ``k`` of all groups are kept."""
    scratch = Scratch(rows.sparkSession, "blocks")
    pivots = _pivots(rows)
    single = queries.groupBy("id").agg(F.max("vec").alias("vec"))
    numbered = []
    for frame, size in ((rows, BLOCK_ROWS), (single, QUERY_ROWS)):
        blocks = scratch.save(pack(frame, pivots, size, arrange))
        # The table is read back file by file, so a block has the same number at every reading.
        numbered.append(blocks.withColumn("no", F.monotonically_increasing_id()))
    data, asked = numbered
    n_data = data.count()
    shards = max(1, -(-n_data // SHARD_BLOCKS))
    # A hash deals blocks to shards; the query blocks' numbers are one small column.
    data = data.withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int"))
    asked_shards = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumnRenamed("no", "q_no")
    numbers = [r.no for r in asked.select("no").collect()]  # one number per QUERY_ROWS queries
    data_asked = data.withColumn("q_no", F.explode(F.lit(numbers).cast("array<long>")))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), kind]
        by_dim: dict[int, tuple[list, list]] = {}
        for side, part in enumerate((left, right)):
            for row in part.select(["dim", "ids", "vecs", "tree"]).to_pylist():
                by_dim.setdefault(row["dim"], ([], []))[side].append(row)
        found = [search(q, d) for q, d in by_dim.values() if q and d]
        columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3)]
        return pa.table([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names)

    best = asked_shards.groupBy("q_no", "shard").cogroup(data_asked.groupBy("q_no", "shard")).applyInArrow(
        run, f"query_id long, vec_id long, score {score_type}"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The best ``k`` (score, smaller id first) of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int, dtype):
        self.ids, self.k = ids, k
        self.scores: list[np.ndarray] = [np.empty(0, dtype)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.kth = np.full(len(ids), -np.inf)

    def add(self, query: int, scores: np.ndarray, found: np.ndarray) -> None:
        s = np.concatenate([self.scores[query], scores])
        i = np.concatenate([self.found[query], found])
        keep = np.lexsort((i, -s))[: self.k]
        self.scores[query], self.found[query] = s[keep], i[keep]
        if len(keep) == self.k:
            self.kth[query] = self.scores[query][-1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(x) for x in self.found]
        return np.repeat(self.ids, n), np.concatenate(self.found), np.concatenate(self.scores)
