"""Fuzzy line deduplication by MinHash (operator 7).

A line is compared in lower case with its white space collapsed. Its shingles are the ``SHINGLE`` characters from each
character on, so every part of a line counts. Their hashes, sorted, fall into 64 ranges; the smallest of each range
is the signature (one permutation), neighbouring ranges together are a band. Two lines that share a band are compared with each
other exactly; links of a Jaccard similarity of at least ``SIMILARITY`` make components by distributed union-find, and of
each component only the first line - lowest document id, then line number - stays.

* Members of a band meet its smallest line first; what is then still in different components meets in a second round,
  leaving out pairs inside a component and pairs whose sizes rule the similarity out.
* Copies of a line have one hash and are one node: a line that makes up a third of all rows is one key, pre-aggregated
  before each shuffle. Line texts are not shuffled but for those that a candidate pair needs.
* Lines are cut, joined, grouped and linked by DataFrame operations. Two steps over single rows are numpy over Arrow batches:
  the hashes of a line's shingles with its bands, and the common shingles of a candidate pair. As column functions (UTF-32
  slices in higher-order functions) they missed the limits of time and disk; the README has the figures.

A null text stays null and has no lines; blank lines stay; lines of fewer than ``LEAST`` characters are alike only if they
are equal; rows without id keep all their lines; rows that repeat both id and text count as one and are treated alike; ids that repeat with other
texts are different documents. Extra columns are passed through. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from cautela.llm.common import Scratch, prefilter, slices, utf8
from cautela.llm.components import components
from cautela.llm.near_dedup import mixed

SHINGLE, LEAST = 9, 10
SIMILARITY_PARTS, SIMILARITY_NEEDED = 100, 80
#: The top six bits of a hash are its range. Layouts of bands over the ranges: 2 to the power of what makes a band, by how many
#: ranges the bands are shifted, and from and below how many shingles a line uses the layout. Short lines have few hashes per
#: range, so they get wider bands; a band with a single hash says little and counts only for lines of up to SINGLE shingles.
RANGE_BITS, RANGES = 6, 64
LAYOUTS = ((2, 0, 40, None), (3, 0, 0, 64), (4, 0, 0, 40), (4, 8, 0, 16))
SINGLE = 7
#: Bits of a hash that the signature keeps, beside the number of its line in a slice; the exact check keeps all 64.
KEPT_BITS = 44
#: Bytes of lines, or of pairs of lines, worked on at once; a longer line is a slice of its own. Line ids that a task remembers.
LINE_SLICE, REMEMBERED = 1 << 20, 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)


def normal_line(line: Column) -> Column:
    odd = reduce(lambda a, b: a | b, (line.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each place of the lines of at least ``LEAST`` characters, and the line's number."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) != len(data):  # characters before each byte: all but the bytes that go on with a character
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    lengths = np.diff(offsets)
    counts = np.where(lengths >= LEAST, lengths - SHINGLE + 1, 0)
    lines = np.repeat(np.arange(len(counts)), counts)
    if not len(lines):
        return np.empty(0, np.uint64), lines
    # A polynomial over SHINGLE characters, from those over a part of them.
    power, width, part = STEP, 1, codes
    total, taken, factor = np.zeros(len(codes) - SHINGLE + 1, np.uint64), 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while taken < SHINGLE:
            if SHINGLE & width:
                total += part[taken : taken + len(total)] * factor
                taken, factor = taken + width, factor * power
            if taken < SHINGLE:
                part = part[:-width] + part[width:] * power
                power, width = power * power, 2 * width
        starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(lines))
        return mixed(total[starts]), lines


def _lines(df: DataFrame) -> DataFrame:
    """doc, text_key, no and normalised line of every line that takes part."""
    # Normalised inside the array: as a column it would be computed again by the filter and by all that uses it.
    split = F.transform(F.split("text", "\n"), normal_line)
    rows = df.filter(F.col("doc").isNotNull()).select("doc", "text_key", F.posexplode(split).alias("no", "line"))
    return rows.filter("line != ''")


def band_keys(hashes: np.ndarray, lines: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of different shingles of each line; keys of its bands and where each line's keys begin."""
    kept = np.uint64(KEPT_BITS)
    ordered = np.sort((lines.astype(np.uint64) << kept) | (hashes >> (np.uint64(64) - kept)))
    ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered
    n = np.bincount((ordered >> kept).astype(np.int64), minlength=n_lines)
    places = ordered >> (kept - np.uint64(RANGE_BITS))
    least = ordered[np.concatenate([[True], places[1:] != places[:-1]])] if len(ordered) else ordered
    line = (least >> kept).astype(np.int64)
    value = least & np.uint64((1 << KEPT_BITS) - 1)
    spot = (value >> (kept - np.uint64(RANGE_BITS))).astype(np.int64)
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for number, (width, shift, from_, below) in enumerate(LAYOUTS):
        used = (n >= from_) & (n < below) if below is not None else n >= from_
        inside = used[line]
        if not inside.any():
            continue
        of, band = line[inside], (spot[inside] + shift) >> width
        begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (band[1:] != band[:-1])]))
        size = np.diff(np.append(begins, len(of)))
        together = np.add.reduceat(mixed(value[inside] + STEP), begins)
        key = mixed(together + (band[begins] + number * 2 * RANGES + 1).astype(np.uint64) * STEP)
        enough = (size > 1) | (n[of[begins]] <= SINGLE)
        keys.append(key[enough])
        owners.append(of[begins][enough])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return n, np.concatenate(keys)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_lines))])


def _signed(lines: DataFrame) -> DataFrame:
    """Line id (64-bit hash), number of shingles and band keys instead of the line.

    Of a line that a task has met before, ``n`` is 0 and there are no keys: one row with them is enough.
    """
    named = lines.select("doc", "text_key", "no", F.xxhash64("line").alias("id"), "line")
    schema = StructType([f for f in named.schema if f.name != "line"])
    schema = schema.add("n", IntegerType()).add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "line", LINE_SLICE):
            new = []
            for at, i in enumerate(batch.column("id").to_pylist()):
                if i not in seen:
                    seen.add(i)
                    new.append(at)
            if len(seen) > REMEMBERED:
                seen.clear()
            n, sizes = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            keys = np.empty(0, np.uint64)
            if new:
                hashes, owner = shingles(*utf8(batch.column("line").take(pa.array(new))))
                n[new], keys, begins = band_keys(hashes, owner, len(new))
                sizes[new] = np.diff(begins)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
            kept = [batch.column(c) for c in ("doc", "text_key", "no", "id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), bands], schema.names)

    return named.mapInArrow(run, schema)


def _fits(x: Column, y: Column) -> Column:
    """Set sizes that allow the similarity."""
    return SIMILARITY_PARTS * F.least(x, y) >= SIMILARITY_NEEDED * F.greatest(x, y)


def line_sets(lines: pa.Array) -> list[np.ndarray]:
    """Sorted different shingles of each line."""
    hashes, of = shingles(*utf8(lines))
    sets = []
    for part in np.split(hashes, np.cumsum(np.bincount(of, minlength=len(lines)))[:-1]):
        part = np.sort(part)
        sets.append(np.concatenate([part[:1], part[1:][part[1:] != part[:-1]]]))
    return sets


def common_shingles(first: pa.Array, second: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of lines, the numbers of different shingles of both and of those in common."""
    count, whole = len(first), pa.chunked_array([first, second]).cast(pa.large_string()).combine_chunks()
    different = whole.dictionary_encode()
    sets = line_sets(different.dictionary)
    of, common = different.indices.to_numpy(), np.zeros(count, np.int64)
    for i in range(count):
        both = np.concatenate([sets[of[i]], sets[of[count + i]]])
        both.sort()
        common[i] = np.count_nonzero(both[1:] == both[:-1])
    n = np.array([len(x) for x in sets], np.int64)[of]
    return n[:count], n[count:], common


def _pair_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that each piece has about ``LINE_SLICE`` bytes of lines or one pair."""
    for batch in batches:
        ends = utf8(batch.column("x"))[1][1:] + utf8(batch.column("y"))[1][1:]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + LINE_SLICE, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of line ids that reach the similarity on their full shingle sets.

    Pairs meet lines, not sets, which are eight times as large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pair_slices(batches):
            n_x, n_y, common = common_shingles(batch.column("x"), batch.column("y"))
            linked = SIMILARITY_PARTS * common >= SIMILARITY_NEEDED * (n_x + n_y - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked & (common > 0)))

    x = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _texts(members: DataFrame, df: DataFrame, scratch: Scratch) -> DataFrame:
    """id and line of all lines that share a band with another; pairs of both rounds are among them.

    A line's id is its hash, so the lines are known where they stand: only those are shuffled, once each per task.
    """
    ids = scratch.save(members.select("id").distinct())
    lines = _lines(df).select(F.xxhash64("line").alias("id"), "line")
    read = prefilter(lines, ids, "id").groupBy("id").agg(F.first("line").alias("line"))
    texts = scratch.save(read.join(ids, "id", "left_semi"))
    scratch.drop(ids)
    return texts


def line_components(df: DataFrame, signed: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component of the lines that are linked to a smaller line id; the table ``signed`` is used up."""
    rows = signed.select(F.explode("bands").alias("key"), "id", "n")
    # Two numbers per key, not structs: they are added up in a hash table, without sorting, and are small to shuffle.
    shared = rows.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"))
    shared = scratch.save(shared.filter(F.col("lead") < F.col("last")).select("key", "lead"))
    scratch.release()
    # Joined first, so that copies of a line meet without another shuffle.
    members = scratch.save(prefilter(rows, shared.select("key"), "key").join(shared, "key").distinct())
    scratch.drop(signed)
    stars = members.filter(F.col("id") > F.col("lead"))
    tried = scratch.save(stars.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    scratch.drop(shared)
    scratch.release()
    texts = _texts(members, df, scratch)
    scratch.release()
    links = scratch.save(_alike(tried, texts))
    labels = components(links, scratch)
    scratch.drop(links)
    scratch.release()

    # Second round: bands with lines of several components. Those of the largest component do not meet each other.
    labelled = members.select("key", "id", "n").join(labels, "id", "left")
    labelled = labelled.select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("rows"))
    mixed_bands = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "component")).alias("top"))
    mixed_bands = mixed_bands.filter(F.col("parts") > 1).select("key", F.col("top.component").alias("main"))
    rest = scratch.save(labelled.join(mixed_bands, "key").withColumn("outer", F.col("component") != F.col("main")))
    other = rest.filter("outer").select("key", *(F.col(c).alias(f"other_{c}") for c in ("id", "n", "component")))
    pairs = rest.join(other, "key").filter(
        (F.col("component") != F.col("other_component"))
        & (~F.col("outer") | (F.col("id") < F.col("other_id")))
        & _fits(F.col("n"), F.col("other_n"))
    )
    pairs = pairs.select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b")).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    more = scratch.save(_alike(pairs, texts))
    scratch.drop(members, tried, rest, texts)
    scratch.release()
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch)


def removed_lines(df: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, text_key and the sorted numbers (from 0) of the lines that go, for rows (doc, text_key, text)."""
    signed = scratch.save(_signed(_lines(df)))
    places = scratch.save(signed.select("doc", "text_key", "no", "id"))
    labels = line_components(df, signed, scratch)
    placed = places.join(labels, "id", "left")
    placed = scratch.save(placed.select("doc", "text_key", "no", F.coalesce("component", "id").alias("component")))
    place = F.struct("doc", "no", "text_key")
    first = placed.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = first.filter(F.col("first") < F.col("last")).select("component", "first")
    gone = placed.join(repeated, "component").filter(place != F.col("first"))
    return gone.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df`` with the repeated lines taken out of ``text``, and a struct ``line_dedup`` (n_lines, n_removed)."""
    scratch = Scratch(df.sparkSession, "line-dedup")
    packed = df.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    )
    gone = scratch.save(removed_lines(packed.select("doc", "text_key", "text"), scratch))
    cut = packed.join(gone, ["doc", "text_key"], "left").withColumn("lines", F.split("text", "\n"))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda i: i + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    runs = F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda run: F.slice(F.col("lines"), run["start"] + 1, run["end"] - run["start"]),
    )
    rebuilt = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    counts = F.struct(
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
    return cut.select(*(rebuilt.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns), counts.alias("line_dedup"))
