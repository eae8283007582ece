"""Near-duplicate documents by MinHash with sequential Bayesian verification (operator 9).

1. Signatures: one pass gives each text's distinct word shingles as 64-bit hashes, of which it keeps the count, two sums
   that identify the set, and ``HASHES`` minima. Texts with the same set are one class from here on.
2. Candidates: classes that share a band of the signature. Every member of a bucket is paired with its smallest id only,
   so a large group of copies costs as many pairs as it has members, not their square.
3. Verification: signatures are compared batch by batch; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below ``MISS``. Survivors are compared on their full shingle sets.
4. Components of the links. Buckets that still hold different components are gone through again: members of the
   bucket's largest component meet only those outside it, small buckets as pairs, large ones in blocks inside tasks, so
   that no link between different texts is lost.

A null text, or one without words, has no shingles and is linked with nothing. A text with fewer words than a shingle
has all of them as one. Documents with the same id are one node; rows without id are linked with nothing and kept, with
a null component. Repeated rows each get a result row. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cautela.llm.common import Scratch, prefilter, slices, utf8, word_bounds
from cautela.llm.components import components

WORDS = 5
#: The threshold as a fraction: linked when PARTS * intersection >= NEEDED * union.
PARTS, NEEDED = 100, 75
HASHES, BAND_ROWS = 128, 4
BATCH = 32
MISS = 1e-7
#: Buckets up to this size are paired by a join, larger ones in blocks of BLOCK rows.
SMALL_BUCKET, BLOCK = 48, 1024

_RANDOM = np.random.default_rng(20_240_917)
BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0  # white space adds nothing to the word before it
BYTE_CODES[ord("A") : ord("Z") + 1] = BYTE_CODES[ord("a") : ord("z") + 1]
STEP = _RANDOM.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    first = int(starts[0])
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(first, len(data)) - np.repeat(starts, spans)
    powers = np.multiply.accumulate(np.full(int((ends - starts).max()) + 1, STEP, np.uint64))
    codes = BYTE_CODES[data[first:]] * powers[np.minimum(place, len(powers) - 1)]
    return mixed(np.add.reduceat(codes, starts - first) + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, rows = word_bounds(data, offsets)
    hashes, n = word_hashes(data, starts, ends), len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    together = max(0, len(hashes) - words + 1)
    total = np.zeros(together, np.uint64)
    for k in range(words):
        total += hashes[k : k + together] * PLACES[k]
    shingles = mixed(total)
    out = []
    for i in range(n):
        a, m = first[i], counts[i]
        if m >= words:
            out.append(np.unique(shingles[a : a + m - words + 1]))
        elif m:
            short = (hashes[a : a + m] * PLACES[words : words + m]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short + np.uint64(m)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` 32-bit minima per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(((flat * FACTORS[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document; ``set_a``, ``set_b`` and the count are the same for texts with the same shingle set."""
    named = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*utf8(batch.column("text")))
            filled = [s for s in sets if len(s)]
            found = iter(minima(filled)) if filled else iter(())
            rows = [(len(s), s.sum(dtype=np.uint64), mixed(s + PLACES[-1]).sum(dtype=np.uint64)) for s in sets]
            numbers = np.array(rows, np.uint64).reshape(-1, 3).astype(np.int64)
            kept = pa.array([next(found).tobytes() if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(numbers[:, i]) for i in range(3)), kept],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )

    return named.mapInArrow(run, SIGNATURE)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return utf8_binary(column).view("<u4").reshape(-1, HASHES)


def utf8_binary(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty(0, np.uint8)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def band_keys(signature: DataFrame) -> DataFrame:
    """key, id for every band of every signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = HASHES // BAND_ROWS
        for batch in batches:
            values = _matrix(batch.column("signature")).astype(np.uint64).reshape(-1, bands, BAND_ROWS)
            keys = mixed((values * PLACES[:BAND_ROWS]).sum(axis=2, dtype=np.uint64) + PLACES[:bands])
            ids = np.repeat(batch.column("id").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).ravel()), pa.array(ids)], ["key", "id"])

    return signature.select("id", "signature").mapInArrow(run, "key long, id long")


def fewest_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of hashes compared, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the chance of at most m heads in n + 1 throws at t.
    """
    found = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def surviving(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions of the row pairs that no batch of hashes has ruled out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, m in least.items():
        same = left[alive, n - BATCH : n] == right[alive, n - BATCH : n]
        matches[alive] += same.sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


def probable(pairs: DataFrame, signature: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures leave them a chance."""
    least = fewest_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = surviving(_matrix(batch.column("x")), _matrix(batch.column("y")), least)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    x = signature.select(F.col("id").alias("a"), F.col("signature").alias("x"))
    y = signature.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, df: DataFrame, parts: int, needed: int, scratch: Scratch) -> DataFrame:
    """The pairs that reach the threshold on their full shingle sets, made again from the texts of the ids involved."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(*utf8(batch.column("text")))]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["id", "shingles"])

    wanted = prefilter(df, ids, "doc_id").join(ids, "doc_id", "left_semi")
    sets = scratch.save(wanted.mapInArrow(run, "id long, shingles array<long>"))
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    united = F.size("x") + F.size("y") - common
    return pairs.join(x, "a").join(y, "b").filter(parts * common >= needed * united).select("a", "b").distinct()


def _remaining(
    members: DataFrame, signature: DataFrame, labels: DataFrame, threshold: float, miss: float, scratch: Scratch
) -> DataFrame:
    """Probable pairs of different components within a bucket, each component's inner pairs left out."""
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")
    )
    mixed_buckets = buckets.filter(F.col("parts") > 1).select(
        "key", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.n")).alias("outside")
    )
    rows = labelled.join(mixed_buckets, "key").withColumn("outer", F.col("component") != F.col("main"))
    rows = scratch.save(rows.select("key", "id", "component", "outer", "n", "outside"))
    small, large = rows.filter(F.col("n") <= SMALL_BUCKET), rows.filter(F.col("n") > SMALL_BUCKET)
    right = small.filter("outer").select("key", F.col("id").alias("other"), F.col("component").alias("other_component"))
    pairs = small.join(right, "key").filter(
        (F.col("component") != F.col("other_component")) & (~F.col("outer") | (F.col("id") < F.col("other")))
    )
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    few = probable(pairs, signature, threshold, miss)

    left_blocks, right_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "outside"))
    large = large.join(signature.select("id", "signature"), "id")
    block = F.pmod(F.xxhash64("id", "key"), left_blocks)
    left = large.withColumn("l", block).withColumn("r", F.explode(F.sequence(F.lit(0), right_blocks - 1)))
    other = large.filter("outer").withColumn("r", F.pmod(F.xxhash64("id", "key"), right_blocks))
    other = other.withColumn("l", F.explode(F.sequence(F.lit(0), left_blocks - 1)))
    least = fewest_matches(threshold, miss)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _matrix(left.column("signature")), _matrix(right.column("signature"))
        ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
        parts, other_parts = left.column("component").to_numpy(), right.column("component").to_numpy()
        outer = left.column("outer").to_numpy(zero_copy_only=False)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i in range(len(ids) if len(others) else 0):
            at = np.flatnonzero((other_parts != parts[i]) & (~outer[i] | (ids[i] < others)))
            at = at[surviving(np.broadcast_to(x[i], (len(at), HASHES)), y[at], least)] if len(at) else at
            found.append((np.full(len(at), ids[i]), others[at]))
        a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    keys = ("key", "l", "r")
    # Both sides come from one table: aliases keep their columns apart.
    columns = [F.col(c).alias(c) for c in (*keys, "id", "component", "outer", "signature")]
    many = left.select(*columns).groupBy(*keys).cogroup(other.select(*columns).groupBy(*keys))
    return few.union(many.applyInArrow(run, "a long, b long")).distinct()


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = PARTS, needed: int = NEEDED, miss: float = MISS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    scratch, threshold = Scratch(df.sparkSession, "near-dedup"), needed / parts
    named = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    rows = scratch.save(signatures(named))
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same_set = ["n_shingles", "set_a", "set_b"]
    classes = known.groupBy(*same_set).agg(F.min("doc_id").alias("id"))
    membership = known.select("doc_id", *same_set).join(classes, same_set).select("doc_id", "id").distinct()
    # Copies hang on their class's smallest id; only that one has bands.
    hanging = scratch.save(membership.filter(F.col("doc_id") != F.col("id")).select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    heads = known.join(classes.withColumnRenamed("id", "doc_id"), [*same_set, "doc_id"], "left_semi")
    signature = scratch.save(heads.select(F.col("doc_id").alias("id"), "signature").distinct())

    keys = band_keys(signature)
    shared = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last")
    shared = scratch.save(shared.select("key", "lead"))
    members = scratch.save(prefilter(keys, shared.select("key"), "key").join(shared, "key"))
    stars = members.filter(F.col("id") > F.col("lead")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tried = scratch.save(probable(stars, signature, threshold, miss))
    scratch.release()
    links = scratch.save(verified(tried, named, parts, needed, scratch).union(hanging))
    labels = components(links, scratch)
    scratch.release()

    rest = _remaining(members.select("key", "id"), signature, labels, threshold, miss, scratch)
    rest = scratch.save(rest.join(tried, ["a", "b"], "left_anti"))
    scratch.release()
    if not rest.isEmpty():
        more = scratch.save(verified(rest, named, parts, needed, scratch))
        if not more.isEmpty():
            labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch)
    result = rows.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return result.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
