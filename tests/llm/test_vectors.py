"""Both vector searches against a full product, and the tree's and tiles' bounds on their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cautela.llm.tile_search import Rounded, nearest, tile_bounds
from cautela.llm.tree_search import NODE, cover_tree, exact_top_k


def block(vecs):
    return {"dim": vecs.shape[1], "ids": np.arange(len(vecs)).astype("<i8").tobytes(), "vecs": vecs.astype("<f8").tobytes()}


def test_cover_tree_covers_and_nests():
    rng = np.random.default_rng(1)
    vecs = np.concatenate([rng.normal(c, 0.3, (300, 5)) for c in (0, 4, 9)])
    order, nodes = cover_tree(vecs)
    assert sorted(order) == list(range(len(vecs))) and len(nodes) > 3 and nodes.dtype == NODE
    for n in nodes:
        rows = vecs[order[n["start"] : n["end"]]]
        assert np.linalg.norm(rows - rows[0], axis=1).max() <= n["radius"] + 1e-6
        if n["children"]:
            kids = nodes[n["child"] : n["child"] + n["children"]]
            assert kids[0]["start"] == n["start"] and kids[-1]["end"] == n["end"]


def test_tile_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 64)), rng.normal(size=(80, 64)) * 50
    product, error = tile_bounds(Rounded(block(a)), Rounded(block(b)), slice(0, 60), slice(0, 80))
    assert (np.abs(a @ b.T - product) <= error).all()


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.2, 8)], "x") for i in range(400)]
    rows += [(1000 + i, [0.5] * 8, "x") for i in range(40)]  # ties
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [float("nan")]), (2060, [1.0] * 7 + [None]), (2080, [float("inf")] * 8)]
    rows += [(i, v, "x") for i, v in bad] + [(None, [1.0] * 8, "x"), (2100, [], "x"), (2120, [1.0, 2.0], "x"), (2121, [3.0, 1.0], "x")]
    rows += [rows[7], rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")


def expected(rows, every, k, change, zero):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    good = [(i, change(v)) for i, v in good if zero or v.any()]
    out = []
    for q, x in dict((i, v) for i, v in good if i % every == 0).items():
        scores = sorted((-float(x @ y), i) for i, y in good if i != q and len(x) == len(y))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["tree", "tiles"])
def test_search_equals_full_product(spark, kind):
    table = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    if kind == "tree":
        found = exact_top_k(table, F.col("id") % 20 == 0, 5)
        wanted = expected(rows, 20, 5, lambda v: np.floor(256 * v), True)
    else:
        found, wanted = nearest(table, F.col("id") % 20 == 0, 7), expected(rows, 20, 7, lambda v: v, False)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], rtol=1e-12)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(empty, F.col("id") % 2 == 0, 3).count() == 0 and nearest(empty, F.col("id") % 2 == 0, 3).count() == 0
