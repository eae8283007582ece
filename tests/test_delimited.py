"""Quoted text files cut into many slices, against the csv module."""

import csv
import io
import random

import pytest

from cautela.sources import delimited
from cautela.sources.delimited import closes_inside, read_delimited, records
from cautela.sources.labelled import read_labelled_csv
from cautela.sources.schemas import LABELLED_COLUMNS


@pytest.fixture
def small_slices(spark):
    """A session that cuts files every 90 bytes."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "90")
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


BITS = ['"', ",", "\n", "\r\n", "a", "bc", " ", "é", "'", "line\nof\ntext", '""', "x" * 40]


def some_rows(seed, n):
    pick = random.Random(seed)
    text = lambda most: "".join(pick.choice(BITS) for _ in range(pick.randint(0, most)))
    return [[f"r{i}", text(12) if pick.random() < 0.9 else text(120), str(pick.randint(0, 9))] for i in range(n)]


def written(rows, path, header=("id", "words", "n"), end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    writer.writerows(([header] if header else []) + rows)
    path.write_text(out.getvalue(), encoding="utf-8", newline="")


@pytest.mark.parametrize("seed,end,quoting", [(1, "\n", csv.QUOTE_MINIMAL), (2, "\r\n", csv.QUOTE_MINIMAL), (3, "\n", csv.QUOTE_ALL)])
def test_records_equal_the_csv_module(small_slices, tmp_path, seed, end, quoting):
    expected = []
    for n in range(3):  # several files, each cut on its own
        rows = some_rows(seed * 10 + n, 60)
        written(rows, tmp_path / f"{n}.csv", end=end, quoting=quoting)
        expected += rows
    found = read_delimited(small_slices, str(tmp_path), "id string, words string, n int")
    assert records(small_slices, [str(tmp_path)]).select("file", "block").distinct().count() > 60
    got = sorted([r.id, r.words or "", str(r.n)] for r in found.rows.collect())
    assert got == sorted(expected) and found.rejected.count() == 0


def test_whole_slices_inside_a_quote(small_slices, tmp_path):
    long = "no end\n" * 100 + 'of "it"'
    rows = [["a", long, "1"], ["b", "short", "2"], ["c", long, "3"], ["d", "", "4"]]
    written(rows, tmp_path / "x.csv")
    found = read_delimited(small_slices, str(tmp_path / "x.csv"), "id string, words string, n int")
    assert sorted([r.id, r.words or "", str(r.n)] for r in found.rows.collect()) == rows


def test_rejects_carry_record_file_and_reason(small_slices, tmp_path, monkeypatch):
    path = tmp_path / "odd.csv"
    bad = ['a,"two\nlines",x', "b,c", "d,e,1,f", 'g,5" disk,2.5']
    good = ['h,5" disk,3', "", "i,,4"]
    path.write_text("﻿" + "\r\n".join(['id,"words", n', bad[0], good[0], bad[1], good[1], bad[2], good[2], bad[3], 'k,"never closed,5\nl,m,6\n']))
    found = read_delimited(small_slices, str(path), "id string, words string, n int")
    assert sorted(tuple(r) for r in found.rows.collect()) == [("h", '5" disk', 3), ("i", None, 4)]
    rejected = [(r.reason, r.raw) for r in found.rejected.collect()]
    assert all(r.source_file.endswith("/odd.csv") for r in found.rejected.collect())
    assert sorted(x for x in rejected if x[0] != "open_quote") == [
        ("bad_n", bad[0]), ("bad_n", bad[3]), ("number_of_fields", bad[1]), ("number_of_fields", bad[2]),
    ]
    assert "".join(x[1] for x in rejected if x[0] == "open_quote").startswith('k,"never closed')
    monkeypatch.setattr(delimited, "LONGEST_RECORD", 100)
    written([["a", "word\n" * 60, "1"], ["b", "c", "2"]], tmp_path / "long.csv")
    found = read_delimited(small_slices, str(tmp_path / "long.csv"), "id string, words string, n int")
    assert [r.id for r in found.rows.collect()] == ["b"] and {r.reason for r in found.rejected.collect()} == {"open_quote"}


def test_headers_are_checked(spark, tmp_path):
    written([["1", "x", "2"]], tmp_path / "x.csv", header=("id", "n", "words"))
    with pytest.raises(Exception, match="other columns"):
        read_delimited(spark, str(tmp_path / "x.csv"), "id string, words string, n int").rows.collect()
    written([], tmp_path / "none.csv")
    found = read_delimited(spark, str(tmp_path / "none.csv"), "id string, words string, n int")
    assert found.rows.count() == found.rejected.count() == 0
    row = {c: "x" for c in LABELLED_COLUMNS} | {"is_synthetic": "maybe", "created_at": "2026-07-10"}
    dated = row | {"is_synthetic": "False", "created_at": "10 July"}
    written([list(row.values()), list(dated.values())], tmp_path / "labelled.csv", header=LABELLED_COLUMNS)
    found = read_labelled_csv(spark, str(tmp_path / "labelled.csv"))
    assert sorted(r.reason for r in found.rejected.collect()) == ["bad_created_at", "bad_is_synthetic"]


def test_quotes_open_at_field_starts_only():
    assert [closes_inside(x, False) for x in ('a,"b', 'a,"b"', 'a,b"c', '"a""', '"a"" ,', '"a"x,"', '""', '"",""",')] == [
        True, False, False, True, True, True, False, True,
    ]
    assert [closes_inside(x, True) for x in ("a", 'a"', 'a""', '","', '",x')] == [True, False, True, True, False]
