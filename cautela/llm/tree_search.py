"""Exact top-k inner products by dual-tree search over cover trees (operator 2).

Every block of data and of queries carries a cover tree: a node is a run of rows whose first row is its centre, its
radius covers all of them, and its children's centres are further apart than the children's target radius. A pair of
nodes is dropped when no product between them can reach the worst k-th score of the queries below the query node; pairs
are taken in the order of their bounds, and the scores carry over from block to block of a group.

Handling of nulls, odd vectors, repeated rows and empty tables: see ``vector_blocks``. Equal scores go to the smaller id.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.llm.vector_blocks import Best, block_join, prepared, unpacked

#: Radius of a node over the target radius of its children; rows of the largest leaf that is not split at all.
BASE, LEAF_ROWS = 1.4, 48
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def cover_tree(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order and nodes. A node whose cover would need more than a quarter of its rows stays a leaf."""
    squares = np.einsum("ij,ij->i", vecs, vecs)

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[rows] + squares[centre] - 2 * (vecs[rows] @ vecs[centre]), 0))

    order: list[np.ndarray] = [np.arange(len(vecs))]
    nodes: list[list] = [[0, len(vecs), 0, 0, 0.0]]
    rows_of = order[0].copy()
    at = 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        rows = rows_of[start:end]
        near = distances(rows, rows[0])
        radius = float(near.max())
        nodes[at][4] = radius
        if len(rows) > LEAF_ROWS and radius > 0:
            owner, centres = np.zeros(len(rows), np.int64), [0]
            while near.max() > radius / BASE and len(centres) <= len(rows) // 4:
                far = int(near.argmax())
                other = distances(rows, rows[far])
                closer = other < near
                closer[far] = True
                owner[closer], near = len(centres), np.minimum(near, other)
                near[far] = 0
                centres.append(far)
            if 1 < len(centres) <= len(rows) // 4:
                first = np.ones(len(rows), bool)
                first[centres] = False  # a centre comes first in its child's run
                rows_of[start:end] = rows[np.lexsort((first, owner))]
                edges = start + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(centres)))])
                nodes[at][2:4] = [len(nodes), len(centres)]
                nodes += [[int(a), int(b), 0, 0, 0.0] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        at += 1
    return rows_of, np.array([tuple(n) for n in nodes], NODE)


def with_tree(ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    order, nodes = cover_tree(vecs)
    return ids[order], vecs[order], nodes.tobytes()


class Tree:
    def __init__(self, row: dict):
        self.ids, self.vecs = unpacked(row)
        nodes = np.frombuffer(row["tree"], NODE)
        self.start, self.end, self.child, self.children = (nodes[x].tolist() for x in ("start", "end", "child", "children"))
        # Rounding of the distances must not let a row stick out.
        self.radius = nodes["radius"] * (1 + 1e-9) + 1e-9
        self.centre = self.vecs[nodes["start"]]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.centre, self.centre))
        self.largest = float(np.abs(self.vecs).max(initial=0))


def dual_search(queries: Tree, data: Tree, best: Best) -> int:
    """Update ``best`` with ``data``; returns the number of row pairs that were scored."""
    exact = queries.largest * data.largest * max(1, data.vecs.shape[1]) < 2**52
    tie, scored = count(), 0
    heap: list[tuple] = []

    def bounds(q, d) -> np.ndarray:
        centre = np.einsum("ij,ij->i", np.atleast_2d(queries.centre[q]), np.atleast_2d(data.centre[d]))
        rq, rd = queries.radius[q], data.radius[d]
        top = centre + rq * data.norm[d] + rd * queries.norm[q] + rq * rd
        return top + 1e-9 * np.abs(top)

    def push(q: np.ndarray, d: np.ndarray) -> None:
        for bound, a, b in zip(bounds(q, d).tolist(), q.tolist(), d.tolist(), strict=True):
            heapq.heappush(heap, (-bound, next(tie), a, b))

    push(np.array([0]), np.array([0]))
    while heap:
        bound, _, q, d = heapq.heappop(heap)
        qs, qe, ds, de = queries.start[q], queries.end[q], data.start[d], data.end[d]
        if -bound < best.kth[qs:qe].min():
            continue
        q_kids, d_kids = queries.children[q], data.children[d]
        if q_kids and (not d_kids or queries.radius[q] > data.radius[d]):
            first = queries.child[q]
            push(np.arange(first, first + q_kids), np.full(q_kids, d))
        elif d_kids:
            first = data.child[d]
            push(np.full(d_kids, q), np.arange(first, first + d_kids))
        else:
            left, right = queries.vecs[qs:qe], data.vecs[ds:de]
            scores = (left @ right.T).astype(np.int64) if exact else left.astype(np.int64) @ right.astype(np.int64).T
            scored += scores.size
            ids = data.ids[ds:de]
            wanted = (scores >= best.kth[qs:qe, None]) & (ids[None, :] != queries.ids[qs:qe, None])
            for i in np.flatnonzero(wanted.any(axis=1)):
                at = wanted[i]
                best.add(qs + int(i), scores[i, at], ids[at])
    return scored


def search_trees(k: int):
    def search(query_blocks: list[dict], data_blocks: list[dict]):
        trees = [Tree(d) for d in data_blocks]
        found = []
        for block in query_blocks:
            queries = Tree(block)
            best = Best(queries.ids, k, np.int64)
            for data in trees:
                dual_search(queries, data, best)
            found.append(best.result())
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    return search


def exact_top_k(df: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and integer score of each query's ``k`` best; components are floored to 1/256."""
    rows = prepared(df, row_id, vector, zero=True).withColumn(
        "vec", F.transform("vec", lambda x: F.floor(x * 256).cast("double"))
    )
    return block_join(rows, rows.filter(is_query), k, search_trees(k), "long", with_tree)
