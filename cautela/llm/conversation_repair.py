"""Repair of the turn structure of conversations by alignment with a grammar (operator 11).

A sound conversation is empty, or an optional system turn followed by pairs of a user's and an assistant's turn: its role
initials match ``(s?(ua)+)?``. The rows of a conversation are aligned with the grammar's string of each feasible length (a
length has one string, so the lengths are the targets) by Wagner-Fischer edit distance:

* Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit of a blank or duplicate row), Insert an empty user or
  assistant turn 5; a truncated row that is not deleted adds 5.
* Lengths are tried in the order of the least that they can cost. A table holds only the cells of an Ukkonen band: those
  whose costs so far and the least still to come stay within the incumbent. The first incumbent is the least cost plus a
  slack, doubled until a target is reached; each target that is reached lowers it.
* Each target's table is traced back to its ASCII-least cheapest audit (initials of the edits); audits of equal cost from
  different targets are compared as strings.

Rows of a conversation are read as a sorted stream, ``CHUNK`` rows at a time: longer conversations keep, per grammar
state, the cheapest audit up to there (a shortest path over chunks, exact since equal cost and state make no audit a
prefix of another). So a conversation of any length takes bounded memory but for its audit, one character per edit. Only its
digest needs all its rows in one stream, since a SHA-256 is sequential.

Nulls: a null role or text is one space, so is a null id or turn in the damage's key; a null id is a conversation of its
own, null turns come first. Ties: rows of one turn are ordered by role, then by the SHA-256 of their text; repeated rows are
rows each, the first of them being no duplicate. A role whose initial is none of ``s u a``, or that is empty, can be reroled
or deleted only. Texts of any length are hashed whole. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cautela.llm.common import Scratch

WHITE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: Rows aligned at once; the first slack of the incumbent.
CHUNK, SLACK = 512, 8
#: Rows as symbols: a row that has to go, and role initials, as capitals if the text is truncated; ``o`` is any other role.
GONE, ROLES = "x", {"s": "s", "u": "u", "a": "a"}
NAMES = {"u": "user", "a": "assistant"}
#: Grammar states: at the start, after the system turn, after a user's turn, after a pair.
STEPS = {("S", "s"): "T", ("S", "u"): "A", ("T", "u"): "A", ("U", "u"): "A", ("A", "a"): "U"}
ENDS = {"S": "STAU", "T": "TAU", "A": "AU", "U": "AU"}
ACCEPTED = "SU"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@lru_cache(maxsize=4096)
def target(start: str, end: str, length: int) -> str | None:
    """The grammar's string of that length between two states; no more than one exists."""
    for lead in ("", "s") if start == "S" else ("",):
        body = length - len(lead)
        if body >= 0:
            string = lead + (("au" if start == "A" else "ua") * (body // 2 + 1))[:body]
            state = start
            for role in string:
                state = STEPS[state, role]
            if state == end:
                return string
    return None


def _least(rows: int, sound: int, gone: int, places: int) -> int:
    """The least that ``rows`` rows that may stay (``sound`` of them whole) and ``gone`` others cost against some places."""
    kept = min(rows, places)
    return DELETE * (gone + rows - kept) + INSERT * (places - kept) + TRUNCATED * max(0, kept - sound)


def _cost(symbol: str, role: str) -> int | None:
    """What it costs to let a row stand for a role."""
    if symbol == GONE:
        return None
    extra, initial = TRUNCATED * symbol.isupper(), symbol.lower()
    return extra if initial == role else None if role == "s" else REROLE + extra


def banded(symbols: str, places: str, limit: int) -> tuple[int, str] | None:
    """Least cost and its ASCII-least audit against one target, if it is within ``limit``."""
    n, size = len(symbols), len(places)
    gone, sound = ([0, *accumulate(map(int, marks))] for marks in (
        [s == GONE for s in symbols], [s != GONE and s.islower() for s in symbols]
    ))
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row = {size: 0} if i == n else {}
        for j, rest in table[i + 1].items() if i < n else ():
            row[j] = min(rest + DELETE, row.get(j, limit + 1))
            if j and (step := _cost(symbols[i], places[j - 1])) is not None:
                row[j - 1] = min(rest + step, row.get(j - 1, limit + 1))
        kept: dict[int, int] = {}
        waiting = sorted(row)
        while waiting:
            j = waiting.pop()
            rest = row[j]
            if rest + _least(i - gone[i], sound[i], gone[i], j) <= limit:
                kept[j] = rest
                if j and places[j - 1] != "s":
                    if j - 1 not in row:
                        waiting.append(j - 1)
                    row[j - 1] = min(rest + INSERT, row.get(j - 1, limit + 1))
        table[i] = kept
    if 0 not in table[0]:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < size:
        rest = table[i][j]
        step = _cost(symbols[i], places[j]) if i < n and j < size else None
        if i < n and table[i + 1].get(j, -DELETE - 1) + DELETE == rest:
            audit.append("D")
            i += 1
        elif j < size and places[j] != "s" and table[i].get(j + 1, -INSERT - 1) + INSERT == rest:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if symbols[i].lower() == places[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


def align(symbols: str, start: str, end: str) -> tuple[int, str] | None:
    """The cheapest, then ASCII-least audit that takes the grammar from one state to another; None if there is none."""
    if end == "T" and start != "T" and not ("s" in symbols or "S" in symbols):
        return None
    gone = symbols.count(GONE)
    rows = len(symbols) - gone
    sound = sum(s != GONE and s.islower() for s in symbols)
    base, slack = _least(rows, sound, gone, sound), SLACK
    while True:
        limit, best = base + slack, None
        tried = {sound}
        waiting = [(base, sound)]
        while waiting:
            waiting.sort()
            least, length = waiting.pop(0)
            if least > limit:
                break
            for other in (length - 1, length + 1):
                if other >= 0 and other not in tried:
                    tried.add(other)
                    waiting.append((_least(rows, sound, gone, other), other))
            places = target(start, end, length)
            found = banded(symbols, places, limit) if places is not None else None
            if found and (best is None or found < best):
                best, limit = found, found[0]
        if best:
            return best
        slack *= 2


_remembered = lru_cache(maxsize=100_000)(align)


def _align(symbols: str, start: str, end: str) -> tuple[int, str] | None:
    return (_remembered if len(symbols) <= 24 else align)(symbols, start, end)


class Repair:
    """Counts, cost and audit of one conversation from its rows in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = 0
        self.last: str | None = None
        self.symbols: list[str] = []
        self.held = 0
        self.settled: list[str] = []
        self.live = {"S": (0, "")}

    def add(self, turn: int | None, initial: str, blank: bool, ended: bool, first: bool, rows: int) -> None:
        """``rows`` equal rows; ``first`` if no earlier row has their role and text."""
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += rows - 1
        self.last = initial
        if blank:
            self.blank += rows
            self._push(GONE, rows)
            return
        self.duplicate += rows - first
        if first:
            self.truncated += not ended
            symbol = ROLES.get(initial, "o")
            self._push(symbol if ended else symbol.upper(), 1)
        self._push(GONE, rows - first)

    def _push(self, symbol: str, rows: int) -> None:
        while rows:
            if self.held == CHUNK:  # more follows: the states after this chunk are all that counts of it
                self._advance("".join(self.symbols), None)
                self.symbols, self.held = [], 0
            some = min(rows, CHUNK - self.held)
            self.symbols.append(symbol * some)
            self.held, rows = self.held + some, rows - some

    def _advance(self, chunk: str, ends: str | None) -> None:
        best: dict[str, tuple[int, str]] = {}
        for start, (cost, audit) in self.live.items():
            for end in ENDS[start]:
                found = _align(chunk, start, end) if ends is None or end in ends else None
                if found:
                    way = cost + found[0], audit + found[1]
                    best[end] = min(best.get(end, way), way)
        shared = os.path.commonprefix([audit for _, audit in best.values()])
        self.settled.append(shared)
        self.live = {end: (cost, audit[len(shared) :]) for end, (cost, audit) in best.items()}

    def result(self) -> tuple[int, int, int, int, int, int, str]:
        self._advance("".join(self.symbols), ACCEPTED)
        cost, audit = min(self.live.values())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit


def damage_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv, turn, role, text and copies (adjacent equal rows) of the rows that are left after the damage."""
    rows = df.select(
        df[conv_id].alias("conv"),
        df[turn].cast("long").alias("turn"),
        F.coalesce(df[role].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(df[text].cast("string"), F.lit(" ")).alias("text"),
    )
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).filter("kind != 0")
    damaged = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        damaged.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _key() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")


def audits(rows: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, the counts of ``STATS`` and audit of every row of ``conversations`` (conv), from rows as the damage gives them."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    light = rows.select("conv", "turn", "role", _key(), (last == "").alias("blank"), last.isin(*".!?").alias("ended"), "copies")
    # Equal rows become one before they are shuffled; texts stay where they are.
    light = light.groupBy("conv", "turn", "role", "key").agg(
        F.max("blank").alias("blank"), F.max("ended").alias("ended"), F.sum("copies").alias("rows")
    )
    earlier = Window.partitionBy("conv", "role", "key").orderBy(F.col("turn").asc_nulls_first())
    light = light.withColumn("first", F.row_number().over(earlier) == 1)
    light = light.select("conv", "turn", "role", F.substring("role", 1, 1).alias("initial"), "key", "blank", "ended", "first", "rows")
    # One row without turns for each conversation, so that those of which nothing is left are there as well.
    known = conversations.distinct()
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in light.schema.fields[1:-1]]
    together = light.unionByName(known.select("conv", *empty, F.lit(0).cast("long").alias("rows")))
    ordered = together.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "key")
    fields = ("conv", "turn", "initial", "blank", "ended", "first", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, repair, done = None, None, []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if done and (last or len(done) >= 2_000):
                columns = list(zip(*done, strict=True))
                arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1])]
                done.clear()
                yield pa.RecordBatch.from_arrays(arrays, ["conv", *STATS, "audit"])

        kind = None
        for batch in batches:
            kind = batch.column("conv").type
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if repair is None or conv != known:
                    if repair is not None:
                        done.append((known, *repair.result()))
                        yield from flush(False)
                    known, repair = conv, Repair()
                if row[-1]:
                    repair.add(*row)
        if repair is not None:
            done.append((known, *repair.result()))
        yield from flush(True)

    schema = T.StructType(
        [rows.schema["conv"], *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("audit", T.StringType())]
    )
    return scratch.save(ordered.select(*fields).mapInArrow(run, schema))


def _applied(audit: str, row: int, role: str, text: str, lead: bool, place: int) -> Iterator[tuple[int, int, str | None, str]]:
    """Yields (position in the audit, place, role, text) of what an audit makes of a row and the insertions before it."""
    while audit[row] == "I":
        yield row + 1, place + 1, NAMES["ua"[(place - lead) % 2]], ""
        row, place = row + 1, place + 1
    edit = audit[row]
    if edit != "D":
        role = role if edit == "K" else NAMES["ua"[(place - lead) % 2]]
        place += 1
    yield row + 1, place, None if edit == "D" else role, text


def _repaired(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """("open", header), ("turn", place, role, text) ... and ("close",) of each conversation of a sorted stream."""
    audit, at, place, lead, opened = "", 0, 0, False, False

    def close():
        spot = place
        for _ in audit[at:]:  # only insertions can follow the last row
            yield "turn", spot, NAMES["ua"[(spot - lead) % 2]], ""
            spot += 1
        yield ("close",)

    for batch in batches:
        for conv, *header, role, text, copies in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if header[-1] is not None:
                if opened:
                    yield from close()
                audit, at, place, opened = header[-1], 0, 0, True
                lead = (len(audit) - audit.count("D")) % 2 == 1
                yield "open", (conv, *header)
                continue
            for _ in range(copies):
                for at, after, name, words in _applied(audit, at, role, text, lead, place):
                    if name is not None:
                        yield "turn", place, name, words
                    place = after
    if opened:
        yield from close()


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, one conversation after the other within a partition."""
    turns = rows.select("conv", "turn", "role", "text", "copies", _key())
    headers = [F.lit(None).cast("long").alias(c) for c in STATS] + [F.lit(None).cast("string").alias("audit")]
    turns = turns.select("conv", *headers, "turn", "role", "text", "copies", "key")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in turns.schema.fields[len(STATS) + 2 :]]
    both = turns.unionByName(found.select("conv", *STATS, "audit", *none))
    order = ("conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "key")
    return both.repartition("conv").sortWithinPartitions(*order).select("conv", *STATS, "audit", "role", "text", "copies")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, place (from 0), role and text of the repaired conversations, from rows and their ``audits``."""
    stream = _stream(rows, found)
    names = tuple(stream.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, size, conv = None, [], 0, None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.column("conv").type
                yield batch

        def flush():
            columns = list(zip(*held, strict=True))
            types = (kind, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "place", "role", "text"])

        for event, *rest in _repaired(typed(), names):
            if event == "open":
                conv = rest[0][0]
            elif event == "turn":
                held.append((conv, *rest))
                size += len(rest[-1])
                if len(held) >= 10_000 or size > 4 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    schema = T.StructType(
        [rows.schema["conv"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    )
    return stream.mapInArrow(run, schema)


def repair_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, the counts, audit and the SHA-256 of the repaired ``role:text`` lines."""
    stream = _stream(rows, found)
    names = tuple(stream.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, header, digest, first, done = None, None, None, True, []

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.column("conv").type
                yield batch

        def flush():
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-2])]
            arrays += [pa.array(c, pa.string()) for c in columns[-2:]]
            return pa.RecordBatch.from_arrays(arrays, ["conv", *STATS, "audit", "repaired_sha256"])

        for event, *rest in _repaired(typed(), names):
            if event == "open":
                header, digest, first = rest[0], hashlib.sha256(), True
            elif event == "turn":
                digest.update(f"{'' if first else chr(10)}{rest[1]}:{rest[2]}".encode("utf-8", "surrogatepass"))
                first = False
            else:
                done.append((*header, digest.hexdigest()))
                if len(done) >= 2_000:
                    yield flush()
                    done = []
        if done:
            yield flush()

    schema = T.StructType(
        [
            rows.schema["conv"],
            *(T.StructField(c, T.LongType()) for c in STATS),
            T.StructField("audit", T.StringType()),
            T.StructField("repaired_sha256", T.StringType()),
        ]
    )
    return stream.mapInArrow(run, schema)
