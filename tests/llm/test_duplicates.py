"""Near-duplicates, fuzzy lines and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cautela.llm.common import Scratch, prefilter, table
from cautela.llm.components import components
from cautela.llm.line_dedup import common_shingles, dedup_lines, line_sets
from cautela.llm.near_dedup import fewest_matches, near_duplicates, shingle_sets, surviving

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(sets, parts, needed):
    where = defaultdict(list)
    for key, values in sets.items():
        for v in values:
            where[v].append(key)
    found = Union({k: k for k in sets})
    for key, values in sets.items():
        common = defaultdict(int)
        for v in values:
            for other in where[v]:
                common[other] += 1
        for other, n in common.items():
            if other != key and parts * n >= needed * (len(values) + len(sets[other]) - n):
                found.join(key, other)
    return found


def families(n=60):
    """Texts with copies, edits of growing size, chains, and a passage that many share."""
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [pick.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(3, 150))]
        if pick.random() < 0.4:
            words = words[:40] + passage
        for _ in range(pick.randint(1, 5)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(pick.randint(0, max(1, len(words) // 20))):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
    return [(i * 3, t) for i, t in enumerate(texts)]


def check_near(rows, frame):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i] |= shingles(t)
    found = linked(sets, 100, 75)
    for r in frame.collect():
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (found.find(r.doc_id), found.find(r.doc_id) == r.doc_id), r
        else:
            assert (r.component_id, r.kept) == (None, True)


def test_near_duplicates_of_families(spark):
    rows = families()
    frame = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_shingles for r in frame.collect()} == {i: len(shingles(t)) for i, t in rows}
    check_near(rows, frame)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    frame = near_duplicates(odd)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert frame.count() == len(rows)
    check_near(rows, frame)
    found = {r.doc_id: r for r in frame.collect()}
    assert found[2].component_id == 1 == found[3].component_id and found[7].component_id == 6
    assert [found[i].n_shingles for i in (4, 5, 11)] == [0, 0, 0] and found[4].kept and found[5].kept
    assert near_duplicates(none).count() == 0


def test_sequential_comparison_keeps_what_it_should():
    least = fewest_matches(0.75, 1e-7)
    assert list(least) == [32, 64, 96, 128] and all(0 < m < n * 0.75 for n, m in least.items())
    x = np.arange(256).reshape(2, 128)
    assert surviving(x, x, least).tolist() == [0, 1] and surviving(x, x + 1000, least).tolist() == []


def test_shingle_hashes_tell_sets_apart():
    texts = ["A b c d e f", "a B c d e f", "a b c d e g", "a b", "ab", "a  b\n", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    sets = [tuple(s.tolist()) for s in shingle_sets(data, offsets)]
    assert sets[0] == sets[1] != sets[2] and sets[3] == sets[5] != sets[4] and sets[6] == ()


def test_components_of_chains_and_hubs(spark):
    pick = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)] + [(i, i) for i in range(5)] + [(None, 3)]
    edges += [(pick.randrange(200, 400), pick.randrange(200, 400)) for _ in range(120)]
    found = Union()
    for a, b in edges:
        if a is not None:
            found.join(a, b)
    frame = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r.id: r.component for r in frame.collect()} == {n: found.find(n) for n in found if found.find(n) != n}


def test_prefilter_misses_nothing(spark):
    rows, keys = spark.range(5_000), spark.range(0, 5_000, 50)
    found = {r.id for r in prefilter(rows, keys, "id").collect()}
    assert found >= set(range(0, 5_000, 50)) and len(found) < 200


def normal(line):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()


def test_line_dedup(spark, sf):
    documents = table(spark, sf, "documents")
    frame = dedup_lines(documents)
    assert frame.columns == [*documents.columns, "line_dedup"]
    check_whole_lines([(r.doc_id, r.text) for r in documents.collect()], frame)


def test_line_dedup_of_odd_rows(odd, none):
    rows = sorted({(r.doc_id, r.text) for r in odd.filter("doc_id is not null").collect()}, key=lambda r: r[0])
    frame = dedup_lines(odd)
    assert frame.count() == odd.count() and frame.select("row", "gone", "key", "id").distinct().count() == 1
    check_whole_lines(rows, frame.filter("doc_id is not null"))
    assert frame.filter("doc_id is null and text is not null").first().text.startswith("a row without")
    assert dedup_lines(none).count() == 0


def whole_line_sets(rows):
    """All character n-grams of every line that takes part; a short line is alike only to its equals."""
    lines, sets = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate(text.split("\n") if text is not None else []):
            key = normal(line)
            if key:
                lines.append((i, no, key))
                sets.setdefault(key, {key[at : at + 9] for at in range(len(key) - 8)} if len(key) >= 10 else {(key,)})
    return lines, sets


def check_whole_lines(rows, frame):
    lines, sets = whole_line_sets(rows)
    found, kept = linked(sets, 100, 80), {}
    for i, no, key in lines:
        kept.setdefault(found.find(key), (i, no))
    gone = {(i, no) for i, no, key in lines if kept[found.find(key)] != (i, no)}
    texts = dict(rows)
    for r in frame.collect():
        if texts[r.doc_id] is None:
            assert r.text is None and tuple(r.line_dedup) == (0, 0)
            continue
        whole = texts[r.doc_id].split("\n")
        expected = [x for no, x in enumerate(whole) if (r.doc_id, no) not in gone]
        assert r.text == "\n".join(expected), r.doc_id
        assert tuple(r.line_dedup) == (len(whole), len(whole) - len(expected))
    return gone


def test_every_character_of_a_line_counts(spark, sf):
    japanese = "今日はとても良い天気ですから、"
    texts = [
        "https://example.org/a/report-2021.html\n2024-01-01t00:00:01z\n" + japanese + "公園まで散歩に行きました。",
        "https://example.org/b/other.html\n2024-01-09t17:45:59z\n" + japanese + "家で本を読むことにします。",
        "https://example.org/a/report-2021.html\n" + "x" * 60 + " a\n" + "the same long line of words stands here and there, " * 3,
        "😀" * 12 + " and a tail\n" + "the same long line of words stands here and there, " * 3 + "x",
    ]
    rows = list(enumerate(texts))
    gone = check_whole_lines(rows, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert gone == {(2, 0), (3, 1)}
    documents = table(spark, sf, "documents").select("doc_id", "text")
    check_whole_lines([(r.doc_id, r.text) for r in documents.collect()], dedup_lines(documents))


def test_long_lines_at_the_similarity_meet(spark):
    pick, alphabet, lines = random.Random(3), [chr(0x4E00 + i) for i in range(5_000)], []
    for _ in range(400):
        line = [pick.choice(alphabet) for _ in range(208)]
        other = line[:180] + [pick.choice(alphabet) for _ in range(20)]
        lines += ["".join(line[:200]), "".join(other)]
    rows = [(0, "\n".join(lines))]
    assert len(check_whole_lines(rows, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))) >= 400


def test_short_lines_are_alike_if_equal(spark):
    rows = [(1, "Yes.\n\n  \nNo\n123456789\n1234567890"), (2, "yes.\n\nyes\nNO \n1 2 3\n1111111111"), (3, "\n1  2 3\nyes,\n111111111\n")]
    found = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].text for i in (1, 2, 3)] == [rows[0][1], "\nyes\n1 2 3\n1111111111", "\nyes,\n111111111\n"]
    assert [found[i].line_dedup.n_removed for i in (1, 2, 3)] == [0, 2, 1]


def test_common_shingles():
    pick = random.Random(5)
    lines = ["".join(pick.choice("ab é今😀") for _ in range(pick.randrange(0, 60))) for _ in range(80)] + ["", "x" * 40, "123456789"]
    sets = [{x[at : at + 9] for at in range(len(x) - 8)} if len(x) >= 10 else set() for x in lines]
    found = line_sets(pa.array(lines))
    assert [len(x) for x in found] == [len(x) for x in sets]
    n, m, common = common_shingles(pa.array(lines), pa.array(lines[::-1]))
    expected = [(len(x), len(y), len(x & y)) for x, y in zip(sets, sets[::-1], strict=True)]
    assert list(zip(n.tolist(), m.tolist(), common.tolist(), strict=True)) == expected


def test_large_bands_of_several_components(spark):
    """Many lines with one half in common, too little for a link, and near copies of some of them: all links are found."""
    pick, lines = random.Random(11), []
    half = "".join(pick.choice("abcdefghijklmnop ") for _ in range(90))
    for _ in range(220):
        rest = "".join(pick.choice("abcdefghijklmnop ") for _ in range(40))
        lines += [half + rest, half + rest[:-3] + "xyz"]
    pick.shuffle(lines)
    rows = [(i, "\n".join(lines[i::7])) for i in range(7)]
    gone = check_whole_lines(rows, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(gone) >= 220
