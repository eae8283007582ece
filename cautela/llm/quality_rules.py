"""Quality rules with risk-controlled cutoffs (operator 13).

Base rules fail texts with fewer than ``LEAST_WORDS`` words or with more than half of their words in repeated
three-word windows. Of the rest, each of ``RULES`` rejects a text whose measure, in whole steps from 0 to ``TOP``, reaches a
cutoff of the text's stratum (bands of text length). The cutoffs come from labelled documents:

* A cutoff rejects some of the n good ones of a stratum. It is certified if the exact binomial bound says so: were its
  true rate of false rejections above the limit, the chance of as few as were seen would be at most the level.
* The limit of a stratum, ``FALSE_REJECTIONS``, is shared equally by its rules, so all of them together keep it. Cutoffs of one
  rule and stratum are tested from the top down until the first that fails (a fixed sequence needs no correction);
  over rules and strata the level is ``CHANCE`` divided by their number (Bonferroni). So with probability 1 - CHANCE no
  stratum loses more than the limit of its good documents.
* Among certified cutoffs any choice keeps that promise. The one with the greatest lead of rejected bad over rejected good
  documents (as shares) is taken, the highest of equal ones; without a lead, or with too few labels, the rule rests.

Counts behind the cutoffs are made of all labelled rows; what reaches the driver is a histogram of fixed size.

A null text has no words. Lines and words are compared exactly. A document whose labels disagree is bad; null labels and ids
say nothing; repeated rows are measured and counted each. Texts of any length are measured whole; columns outside ``keep``
are not read; an empty table gives no rows, empty labels leave the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cautela.llm.common import slices

LEAST_WORDS, REPEATED_PARTS, REPEATED_MOST = 50, 100, 50
WINDOW, SYMBOLS, WHITE = 3, "#*$%&|<>", " \t\n\x0b\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Each rule is a ratio of two measures in steps of so many per unit.
RULES = {
    "word_length": ("word_chars", "n_words", 50),
    "symbols": ("n_symbols", "n_words", 250),
    "duplicate_lines": ("n_dup_lines", "n_lines", 1000),
    "repetition": ("n_repeat_words", "n_words", 1000),
}
TOP = 1000
#: First word counts of the strata; the first band has all shorter texts.
BANDS = (0, 200, 1000)
#: Most good documents that a stratum may lose, and the chance that some stratum loses more.
FALSE_REJECTIONS, CHANCE = 0.02, 0.05


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) > n - 2:
        return 0
    windows = ids
    for k in range(1, WINDOW):
        # Windows of one word more, numbered again so that a pair of numbers fits a long.
        windows, counts = np.unique(windows[:-1] * len(numbers) + ids[k:], return_inverse=True, return_counts=True)[1:]
    at = np.flatnonzero(counts[windows] > 1)
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[at + k] = True
    return int(inside.sum())


def measures(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words, seen, lines = raw.split(), set(), 0  # bytes split at exactly the contract's white space
    for line in raw.split(b"\n"):
        if line.strip():
            seen.add(line)
            lines += 1
    characters = len(text) - sum(map(text.count, WHITE))
    return len(words), characters, sum(map(text.count, SYMBOLS)), lines, lines - len(seen), repeated_words(words)


def measure(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``MEASURES`` of every whole text. One pass, no shuffle."""
    source, names = df.select(*keep, df[text].cast("string").alias("_text")), list(keep)
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [measures(t or "") for t in batch.column("_text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in np.array(found, np.int64).reshape(-1, len(MEASURES)).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *MEASURES])

    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        REPEATED_PARTS * F.col("n_repeat_words") > REPEATED_MOST * F.col("n_words")
    )


def step(rule: str) -> Column:
    """A rule's measure in whole steps; 0 where there is nothing to measure."""
    part, whole, scale = RULES[rule]
    return F.coalesce(F.least(F.expr(f"({scale} * {part}) div nullif({whole}, 0)"), F.lit(TOP)), F.lit(0)).cast("int")


def stratum() -> Column:
    return sum(((F.col("n_words") >= first).cast("int") for first in BANDS[1:]), F.lit(0))


def most_rejections(n: int, limit: float, level: float) -> int:
    """The most of ``n`` that a certified cutoff may reject: the largest k with P(Binomial(n, limit) <= k) <= level."""
    middle = n * limit
    # Chances more than 60 deviations below the mean add nothing to the sum.
    first = max(0, int(middle - 60 * np.sqrt(middle) - 60))
    k = np.arange(first, int(middle) + 2, dtype=np.float64)
    start = _log_choose(n, first) + first * np.log(limit) + (n - first) * np.log1p(-limit)
    steps = np.log(np.maximum(n - k[:-1], 1)) - np.log(k[1:]) + np.log(limit) - np.log1p(-limit)
    total = np.cumsum(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)])))
    within = np.flatnonzero((total <= level) & (k <= n))
    return int(k[within[-1]]) if len(within) else first - 1 if first else -1


def _log_choose(n: int, k: int) -> float:
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


@dataclass(frozen=True)
class Cutoff:
    """Where a rule starts to reject in a stratum, with the good and bad labelled documents it rejects there."""

    stratum: int
    rule: str
    cutoff: int
    good: int
    good_rejected: int
    bad: int
    bad_rejected: int


def choose(good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> tuple[int, int, int] | None:
    """Cutoff, good and bad rejected from the counts per step; None if no certified cutoff leads."""
    good_from, bad_from = (np.cumsum(x[::-1])[::-1] for x in (good, bad))
    n, m = int(good.sum()), int(bad.sum())
    if not n or not m:
        return None
    certified = good_from <= most_rejections(n, limit, level)
    lead = bad_from * n - good_from * m if n * m < 1 << 62 else bad_from / m - good_from / n
    lead = np.where(certified, lead, 0)
    best = len(lead) - 1 - int(np.argmax(lead[::-1]))
    return (best, int(good_from[best]), int(bad_from[best])) if lead[best] > 0 else None


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    label: str = "quality",
    limit: float = FALSE_REJECTIONS,
    chance: float = CHANCE,
) -> list[Cutoff]:
    """The certified cutoffs; labels are 1 for good and 0 for bad documents."""
    marked = labels.select(labels[doc_id].alias("_id"), labels[label].cast("int").alias("_good"))
    marked = marked.filter(F.col("_id").isNotNull() & F.col("_good").isNotNull()).groupBy("_id").agg(F.min("_good").alias("_good"))
    steps = F.array(*(F.struct(F.lit(i).alias("rule"), step(rule).alias("step")) for i, rule in enumerate(RULES)))
    tried = measured.filter(~base_failed()).select(F.col(doc_id).alias("_id"), stratum().alias("stratum"), steps.alias("steps"))
    rows = tried.join(marked, "_id").select("stratum", (F.col("_good") > 0).alias("good"), F.explode("steps").alias("s"))
    counts = rows.groupBy("stratum", "s.rule", "s.step").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    histogram = np.zeros((len(BANDS), len(RULES), 2, TOP + 1), np.int64)
    for r in counts.collect():  # at most a row per stratum, rule and step
        histogram[r.stratum, r.rule, :, r.step] = r.good, r.bad
    families, found = len(BANDS) * len(RULES), []
    for s in range(len(BANDS)):
        for i, rule in enumerate(RULES):
            good, bad = histogram[s, i]
            chosen = choose(good, bad, limit / len(RULES), chance / families)
            if chosen:
                found.append(Cutoff(s, rule, chosen[0], int(good.sum()), chosen[1], int(bad.sum()), chosen[2]))
    return found


def verdicts(measured: DataFrame, found: list[Cutoff]) -> DataFrame:
    """All columns, ``base_failed``, ``rejected_by`` (rules of the method, in order) and ``kept``."""

    def hit(rule: str) -> Column:
        own = [(stratum() == c.stratum) & (step(rule) >= c.cutoff) for c in found if c.rule == rule]
        return F.when(reduce(lambda a, b: a | b, own, F.lit(False)), rule)

    rejected = F.array_compact(F.array(*map(hit, RULES)))
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
