"""Quality measures against plain counting, the binomial bound against exact fractions, cutoffs against all thresholds."""

import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cautela.llm.common import table
from cautela.llm.quality_rules import (
    BANDS,
    CHANCE,
    FALSE_REJECTIONS,
    RULES,
    TOP,
    choose,
    cutoffs,
    measure,
    measures,
    most_rejections,
    verdicts,
)
from cautela.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 900 else None
    if covered is None:
        places = {}
        for i, w in enumerate(windows):
            places.setdefault(w, []).append(i)
        covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counting():
    pick = random.Random(2)
    parts = ["a", "b", "é", "中文", "😀", "#", "<b>", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", " ", " ", "|", "a b a b"]
    for _ in range(1_500):
        text = "".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(pick.randint(0, 30)))
        assert measures(text) == plain(text), repr(text)
    for text in ("", "one", "a a a", "a a a a", "a b c a b c", "x " * 50_000, "\n".join(map(str, range(30_000))), "l\n" * 9):
        assert measures(text) == plain(text), text[:20]


@pytest.mark.parametrize("limit,level", [(0.005, 0.05 / 12), (0.02, 0.05), (0.3, 0.2)])
def test_bound_is_the_exact_binomial(limit, level):
    p = Fraction(limit)
    for n in (1, 7, 60, 400, 1_100, 1_500):
        chance, k = Fraction(0), -1
        while k < n:
            chance += comb(n, k + 1) * p ** (k + 1) * (1 - p) ** (n - k - 1)
            if chance > Fraction(level):
                break
            k += 1
        assert most_rejections(n, limit, level) == k, n
    large = most_rejections(10**9, 0.005, 0.004)
    assert 5e6 - 4 * 5e6**0.5 < large < 5e6 - 2 * 5e6**0.5


def test_choice_is_the_best_certified_cutoff():
    rng = np.random.default_rng(5)
    for _ in range(60):
        good, bad = rng.multinomial(3_000, np.exp(-np.arange(12)) / np.exp(-np.arange(12)).sum()), rng.integers(0, 30, 12)
        allowed, best = most_rejections(3_000, 0.005, 0.004), None
        for cutoff in range(11, -1, -1):
            rejected, caught = int(good[cutoff:].sum()), int(bad[cutoff:].sum())
            lead = Fraction(caught, int(bad.sum())) - Fraction(rejected, 3_000)
            if rejected <= allowed and lead > 0 and (best is None or lead > best[0]):
                best = lead, cutoff, rejected, caught
        assert choose(good, bad, 0.005, 0.004) == (best and best[1:])
    assert choose(np.zeros(3), np.ones(3), 0.1, 0.1) is None and choose(np.ones(3), np.zeros(3), 0.1, 0.1) is None


def test_promise_is_kept():
    """Over many samples of labels, the true rate of false rejections is above its limit in at most the level's share."""
    rng, limit, level = np.random.default_rng(6), 0.02, 0.05
    weights = np.exp(-np.arange(20) / 2)
    weights /= weights.sum()
    true_from, broken = np.cumsum(weights[::-1])[::-1], 0
    for _ in range(2_000):
        chosen = choose(rng.multinomial(1_500, weights), np.ones(20, int), limit, level)
        broken += chosen is not None and true_from[chosen[0]] > limit
    assert broken <= 1.5 * level * 2_000


def judged(rows, labels):
    """doc_id -> (base_failed, kept) by trying every threshold in plain loops."""
    found = {i: plain(t) for i, t in rows}
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    failed = {i: m[0] < 50 or 100 * m[5] > 50 * m[0] for i, m in found.items()}

    def step(m, rule):
        part, whole, scale = RULES[rule]
        values = dict(zip(names, m, strict=True))
        return min(TOP, scale * values[part] // values[whole]) if values[whole] else 0

    band = lambda m: max(k for k, first in enumerate(BANDS) if m[0] >= first)
    rejected = set()
    for s in range(len(BANDS)):
        for rule in RULES:
            inside = [(i, step(m, rule)) for i, m in found.items() if band(m) == s and not failed[i]]
            good, bad = ([x for i, x in inside if labels.get(i) == q] for q in (1, 0))
            allowed = most_rejections(len(good), FALSE_REJECTIONS / len(RULES), CHANCE / len(RULES) / len(BANDS))
            best = None
            for cutoff in range(TOP, -1, -1):
                a, b = sum(x >= cutoff for x in good), sum(x >= cutoff for x in bad)
                if good and bad and a <= allowed and b * len(good) > a * len(bad):
                    lead = b * len(good) - a * len(bad)
                    best = max(best or (0, 0), (lead, cutoff))
            if best:
                rejected |= {i for i, x in inside if x >= best[1]}
    return {i: (failed[i], not failed[i] and i not in rejected) for i in found}


def test_verdicts_of_a_table(spark):
    pick, rows, labels = random.Random(7), [], []
    for i in range(2_600):
        bad = i % 13 == 0
        words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 8))) + "$#" * (bad and pick.random() < 0.6) for _ in range(60)]
        rows.append((i, " ".join(words) + "\nline" * (bad * pick.randint(0, 2))))
        labels += [(i, 0 if bad else 1)] * (1 + (i % 50 == 0))
    rows += [(9_000 + i, t) for i, t in enumerate([None, "", "few words", "again and again " * 40, "$$$ " * 2 + "w x y z " + " ".join(map(str, range(90)))])]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _id string")
    known = spark.createDataFrame([(*x, "k") for x in labels] + [(5, None, "k"), (None, 0, "k")], "doc_id long, quality int, rule string")
    measured = measure(frame)
    assert {r.doc_id: tuple(r)[1:] for r in measured.collect()} == {i: plain(t) for i, t in rows}
    found = cutoffs(measured, known)
    assert {c.rule for c in found} >= {"symbols"} and all(c.good_rejected <= 0.02 * c.good for c in found)
    got = {r.doc_id: (r.base_failed, r.kept) for r in verdicts(measured, found).collect()}
    assert got == judged(rows, dict(labels))
    assert sum(not got[i][1] for i, q in dict(labels).items() if q == 0) > 80


def test_odd_rows(spark, odd, none):
    measured = measure(odd, keep=("doc_id", "row", "source"))
    assert measured.columns[:3] == ["doc_id", "row", "source"] and measured.count() == odd.count()
    wanted = sorted(((r.doc_id, *plain(r.text)) for r in odd.collect()), key=str)
    assert sorted(((r[0], *r[3:]) for r in measured.collect()), key=str) == wanted
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert cutoffs(measured, empty) == [] == cutoffs(measure(none), empty)
    assert verdicts(measured, []).filter(F.col("kept") == F.col("base_failed")).isEmpty()
    assert measure(none).count() == 0


def test_query(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        n, chars, symbols, _, dup, repeat = plain(r.text)
        found = rows[r.doc_id]
        assert tuple(found)[1:6] == (n, chars, symbols, dup, repeat)
        assert found.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (found.kept and found.base_failed)
