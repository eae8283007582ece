"""Conversation repair against all edit sequences of small cases and a plain reading of the rules."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from cautela.llm import conversation_repair as repair
from cautela.llm.common import Scratch, table
from cautela.llm.queries import QUERIES

GRAMMAR = {("S", "s"): "T", ("S", "u"): "A", ("T", "u"): "A", ("U", "u"): "A", ("A", "a"): "U"}


def best(rows, start="S", ends="SU"):
    """Least (cost, audit) over all edit sequences; rows are (initial, has to go, truncated)."""

    @lru_cache(maxsize=None)
    def rest(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ends else []

        def add(cost, letter, after):
            if after:
                found.append((cost + after[0], letter + after[1]))

        if i < len(rows):
            initial, gone, truncated = rows[i]
            add(2, "D", rest(i + 1, state, 0))
            if not gone:
                for role in "sua":
                    to = GRAMMAR.get((state, role))
                    if to and role == initial:
                        add(5 * truncated, "K", rest(i + 1, to, 0))
                    elif to and role in "ua":
                        add(1 + 5 * truncated, "R", rest(i + 1, to, 0))
        if inserted < 3:
            for role in "ua":
                if to := GRAMMAR.get((state, role)):
                    add(5, "I", rest(i, to, inserted + 1))
        return min(found, default=None)

    return rest(0, start, 0)


def symbols(rows):
    return "".join("x" if gone else (i if i in "sua" else "o").upper() if cut else (i if i in "sua" else "o") for i, gone, cut in rows)


def some_rows(pick, most):
    return tuple((pick.choice("ssuuuaaaz"), pick.random() < 0.2, pick.random() < 0.25) for _ in range(pick.randint(0, most)))


@pytest.mark.parametrize("seed", range(12))
def test_alignment_is_the_least_of_all(seed):
    pick = random.Random(seed)
    for _ in range(10):
        rows = some_rows(pick, 12)
        expected = best(rows)
        assert min(filter(None, (repair.align(symbols(rows), "S", end) for end in "SU"))) == expected
        for start, ends in repair.ENDS.items():
            for end in ends:
                assert repair.align(symbols(rows), start, end) == best(rows, start, end), (rows, start, end)


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_chunks_do_not_change_the_result(monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    pick = random.Random(chunk)
    for _ in range(80):
        rows, one = some_rows(pick, 30), repair.Repair()
        for turn, (initial, gone, cut) in enumerate(rows):
            one.add(turn, initial, gone, not cut, True, 1)
        assert one.result()[-2:] == best(rows), rows


def test_long_conversations():
    pick, one = random.Random(1), repair.Repair()
    rows = tuple(("ua"[i % 2] if pick.random() < 0.9 else "u", pick.random() < 0.1, pick.random() < 0.1) for i in range(3_000))
    for turn, (initial, gone, cut) in enumerate(rows):
        one.add(turn, initial, gone, not cut, True, 1)
    cost, audit = one.result()[-2:]
    # Least cost by a plain pass over the grammar's states.
    costs = {"S": 0}
    close = lambda c: {s: min([c.get(s, 9e9)] + [c[p] + 5 * n for p in c for n, q in ((1, GRAMMAR.get((p, "u"))), (1, GRAMMAR.get((p, "a")))) if q == s]) for s in "STAU"}
    for initial, gone, cut in rows:
        costs = close(close(costs))
        after = {s: c + 2 for s, c in costs.items()}
        for (state, role), to in GRAMMAR.items():
            if not gone and role != "s":
                after[to] = min(after.get(to, 9e9), costs[state] + (role != initial) + 5 * cut)
        costs = after
    costs = close(close(costs))
    assert cost == min(costs["S"], costs["U"]) and len(audit) - audit.count("I") == 3_000


def plain(rows):
    """Results of all conversations from (conv, turn, role, text) rows, read off the rules."""
    spaced = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in left:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in left if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]  # noqa: B905
        cost, audit = best(tuple((role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(left, faults, strict=True)))
        lead, made, at = (len(audit) - audit.count("D")) % 2, [], 0
        for edit in audit:
            if edit != "D":
                name = ("user", "assistant")[(len(made) - lead) % 2]
                made.append(f"{name}:" if edit == "I" else f"{left[at][1] if edit == 'K' else name}:{left[at][2]}")
            at += edit != "I"
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def results(frame, name="conv_id"):
    return {r[name]: (*(r[c] for c in repair.STATS), r.audit, r.repaired_sha256) for r in frame.collect()}


def test_query(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
        found = results(QUERIES["op11_conversation_repair"](spark, folder))
        assert found == plain(rows)
        assert any("K" in r[6] and "D" in r[6] for r in found.values())


def odd_rows():
    rows = [(c, t, r, x) for c in range(6) for t, r, x in ((0, "system", "Be kind."), (1, "user", "Hello?"), (2, "assistant", "Hi.\n"))]
    rows += [(7, None, "user", "first?"), (7, None, None, "odd."), (7, 4, "assistant", None), (7, 4, "", "no role."), (7, 9, "tool", "x!")]
    rows += [(8, 1, "user", "same."), (8, 1, "user", "same."), (8, 1, "assistant", "same."), (8, 1, "user", "other"), (8, None, None, None)]
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none at all."), (9, 3, "user", " \t\n"), (10, 1, "User", "A.")]
    rows += [(11, t, "ua"[t % 2], f"{t}." + "long " * 20_000 * (t == 3)) for t in range(9)] + [(12, -5, "system", "s."), (12, 5, "system", "s.")]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    schema = "conv_id long, turn long, role string, text string, key string, conv long, audit string"
    frame = spark.createDataFrame([(*r, "k", 1, "a") for r in rows], schema)
    left = repair.damage_conversations(frame)
    found = repair.audits(left, frame.select(F.col("conv_id").alias("conv")), Scratch(spark, "test"))
    expected = plain(rows)
    assert results(repair.repair_digests(left, found), "conv") == expected
    turns = {}
    for r in repair.repaired_turns(left, found).collect():
        turns.setdefault(r.conv, []).append((r.place, f"{r.role}:{r.text}"))
    for conv, (*_, digest) in expected.items():
        lines = sorted(turns.get(conv, []))
        assert [p for p, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest() == digest


def test_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    left = repair.damage_conversations(frame)
    found = repair.audits(left, frame.select(F.col("conv_id").alias("conv")), Scratch(spark, "test"))
    assert found.count() == repair.repair_digests(left, found).count() == repair.repaired_turns(left, found).count() == 0
