"""Delimited text files whose quoted fields may hold line breaks, read in as many tasks as the files have slices.

A slice may begin inside a quoted field. So a first pass tells for each slice where it ends if it begins outside quotes and
where if it begins inside; these answers, one small row per slice, are chained along each file. The second pass
then knows every slice's start and joins its lines to records. A record that lies over several slices comes out in pieces, a
few per slice, which are put together by a shuffle of the pieces alone.

Every reader has two outputs: rows that fit, and what does not, as (source_file, raw, reason).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cautela.session import cut_lineage

REJECTED = "source_file string, raw string, reason string"
#: A record in pieces that is longer than this has lost a quote somewhere: its pieces are set aside one by one.
LONGEST_RECORD = 16 << 20
MARK = "﻿"
_PIECES = "file string, block long, place long, piece string, record string"


@dataclass(frozen=True)
class FileRows:
    """What a reader makes of its files."""

    rows: DataFrame
    rejected: DataFrame


def no_rejects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REJECTED)


def closes_inside(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether a line ends inside a quoted field. A quote opens at the start of a field only; doubled, it is a character."""
    at = 0
    while True:
        if not inside:
            if line.startswith(quote, at):
                at, inside = at + 1, True
            else:
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
        at = line.find(quote, at)
        if at < 0:
            return True
        if line.startswith(quote, at + 1):
            at += 2
            continue
        inside, at = False, line.find(sep, at + 1) + 1
        if not at:
            return False


def _slice_lines(batches: Iterator) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """((file, block), lines, whether the slice goes on from the call before) in the order of the files."""
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "block")), strict=True))
        lines = batch.column("value").to_pylist()
        start = 0
        while start < len(keys):
            key, stop = keys[start], start + 1
            while stop < len(keys) and keys[stop] == key:
                stop += 1
            yield key, lines[start:stop], key == last
            last, start = key, stop


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    # Only "\n" parts lines here: a "\r" before it may belong to a quoted text.
    text = spark.read.option("lineSep", "\n").text(list(paths))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _starts_inside(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """(file, block, inside, opener) of the slices that begin inside a quoted field; ``opener`` is the slice where that began."""

    def ends(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[tuple[str, int], list] = {}
        for key, some, _ in _slice_lines(batches):
            # End state for either start, and whether some line started outside quotes, for either start.
            state = found.setdefault(key, [False, True, True, False])
            for line in some:
                state[3] |= not state[1]
                if quote in line:
                    state[0], state[1] = (closes_inside(line, s, sep, quote) for s in state[:2])
        if found:
            columns = list(zip(*((*k, *s) for k, s in found.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "block", "if_out", "if_in", "_", "opens"])

    slices = lines.mapInArrow(ends, "file string, block long, if_out boolean, if_in boolean, _ boolean, opens boolean")
    # Chained along a file: a slice that ends the same way from either start sets the state, one that swaps it turns it.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.col("if_out") == F.col("if_in"), (F.col("if_out") & ~F.col("if_in")).cast("int")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    turned = slices.withColumn("turns", F.sum(swaps).over(upto))
    known = F.last(F.when(fixed, F.struct("if_out", "turns")), ignorenulls=True).over(before)
    turns = F.coalesce(F.sum(swaps).over(before), F.lit(0))
    states = turned.withColumn("known", known).withColumn("turned", turns)
    base, since = F.coalesce("known.if_out", F.lit(False)), F.col("turned") - F.coalesce("known.turns", F.lit(0))
    states = states.withColumn("inside", F.when(since % 2 == 1, ~base).otherwise(base))
    # An open record began in the last slice before that has a line outside quotes.
    begins = F.when(~F.col("inside") | F.col("opens"), F.col("block"))
    states = states.withColumn("opener", F.last(begins, ignorenulls=True).over(before))
    return states.filter("inside").select("file", "block", "opener")


def records(spark: SparkSession, paths: Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """(file, block, place, piece, record): a row per record, ``piece`` null, in as many tasks as slices.

    ``place`` numbers the records of a slice from 0. Records that never end, or get longer than ``LONGEST_RECORD`` over several
    slices, come as their pieces with ``piece`` set.
    """
    lines = _lines(spark, paths)
    # At most one entry per slice of the input, and few of them: line breaks inside quotes at a slice's edge.
    inside = {(r.file, r.block): r.opener for r in _starts_inside(lines, sep, quote).collect()}
    handed = spark.sparkContext.broadcast(inside)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[str] = []
        key, state, place, out = None, False, 0, []

        def put(piece: str | None) -> None:
            nonlocal held, place
            out.append((*key, place, piece, "\n".join(held)))
            held, place = [], place + 1

        def batch():
            nonlocal out
            columns, out = list(zip(*out, strict=True)), []
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["file", "block", "place", "piece", "record"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def finish() -> None:
            if held:
                put("middle" if place == 0 and key in handed.value else "tail")

        for slice_key, some, goes_on in _slice_lines(batches):
            if not goes_on:
                finish()
                key, place, state = slice_key, 0, slice_key in handed.value
            for line in some:
                held.append(line)
                if quote in line:
                    state = closes_inside(line, state, sep, quote)
                if not state:
                    put("head" if place == 0 and key in handed.value else None)
            if out:
                yield batch()
        finish()
        if out:
            yield batch()

    pieces = lines.mapInArrow(run, _PIECES)
    whole = pieces.filter("piece is null")
    if not inside:  # no record lies over two slices; a last one may still be open
        return pieces
    openers = spark.createDataFrame([(f, b, o) for (f, b), o in inside.items()], "file string, block long, opener long")
    parts = cut_lineage(pieces.filter("piece is not null")).join(F.broadcast(openers), ["file", "block"], "left")
    # A tail belongs to its own slice, a head or middle to the slice where its record began.
    owner = F.when(F.col("piece") == "tail", F.col("block")).otherwise(F.col("opener"))
    parts = parts.withColumn("owner", owner)
    sizes = parts.groupBy("file", "owner").agg(
        F.sum(F.octet_length("record")).alias("size"),
        F.max(F.col("piece") == "head").alias("ended"),
        F.max(F.when(F.col("piece") == "tail", F.col("place"))).alias("owner_place"),
    )
    sizes = sizes.withColumn("joined", F.col("ended") & (F.col("size") <= LONGEST_RECORD))
    parts = parts.join(sizes, ["file", "owner"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
    joined = parts.filter("joined").groupBy("file", "owner", "owner_place").agg(F.array_join(ordered, "\n").alias("record"))
    joined = joined.select(
        "file", F.col("owner").alias("block"), F.coalesce("owner_place", F.lit(0)).alias("place"), F.lit(None).cast("string").alias("piece"), "record"
    )
    return whole.union(joined).union(parts.filter("not joined").select(*whole.columns))


def _header_names(header: Column, sep: str) -> Column:
    bare = F.regexp_replace(F.rtrim(header, F.lit("\r")), f"^{MARK}", "")
    return F.transform(F.split(bare, f"\\Q{sep}\\E"), lambda x: F.trim(F.btrim(x, F.lit('"'))))


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], schema: str, header: bool = True, sep: str = ",", what: str = "The file"
) -> FileRows:
    """Rows of the schema, with what does not fit it set aside.

    With a header its names have to be the schema's, in order; another header is an error. A byte order mark is left out, as
    are empty lines. A record is set aside for its number of fields, for an open quote, or for a value that is not of its
    column's type; the reason names the column.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    fields = T._parse_datatype_string(schema).fields
    found = records(spark, paths, sep)
    first = (F.col("block") == 0) & (F.col("place") == 0)
    if header:
        wanted = F.array(*(F.lit(f.name) for f in fields))
        message = F.concat(F.lit(f"{what} has other columns than {[f.name for f in fields]}: "), F.col("file"))
        known = F.when(_header_names(F.col("record"), sep) == wanted, F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
        found = found.filter(F.when(first, known).otherwise(F.lit(True)))
    else:
        bare = F.regexp_replace("record", f"^{MARK}", "")
        found = found.withColumn("record", F.when(first, bare).otherwise(F.col("record")))
    found = found.withColumn("record", F.regexp_replace("record", "\r\\z", "")).filter("record != ''")
    text = ", ".join([*(f"{f.name} string" for f in fields), "_bad string"])
    options = {"sep": sep, "escape": '"', "columnNameOfCorruptRecord": "_bad"}
    parsed = found.select("file", "piece", "record", F.from_csv("record", F.lit(text), options).alias("p"))
    typed = [F.col(f"p.{f.name}").try_cast(f.dataType).alias(f.name) for f in fields]
    reasons = [F.when(F.col("piece").isNotNull(), "open_quote"), F.when(F.col("p._bad").isNotNull(), "number_of_fields")]
    reasons += [
        F.when(F.col(f"p.{f.name}").isNotNull() & F.col(f"p.{f.name}").try_cast(f.dataType).isNull(), f"bad_{f.name}")
        for f in fields
        if not isinstance(f.dataType, T.StringType)
    ]
    judged = parsed.select(
        "file", F.col("record").alias("raw"), reduce(lambda a, b: F.coalesce(a, b), reasons).alias("reason"), F.struct(*typed).alias("row")
    )
    rejected = judged.filter(F.col("reason").isNotNull()).select(F.col("file").alias("source_file"), "raw", "reason")
    return FileRows(judged.filter(F.col("reason").isNull()).select("row.*"), rejected)


def missing_input(spark: SparkSession, path: str) -> DataFrame:
    """An optional input that does not exist, as a row of the rejects."""
    return spark.createDataFrame([(path, None, "missing_input")], REJECTED)


def is_missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"
