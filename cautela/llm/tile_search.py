"""Nearest neighbours by a block matrix join with int8 product tiles (operator 8).

Each vector is rounded to int8 with its own scale; the norm of what rounding took off is kept. A tile is one matrix
product of two rounded blocks, and ``|<x,y> - <x',y'>| <= |x-x'| |y| + |x'| |y-y'|`` bounds its error. Pairs whose upper
bound stays below the k-th best lower bound are dropped, the rest are computed again in double precision and go
through one heap per query. Since the bound holds for every pair, nothing that belongs in the result is lost.

Handling of nulls, odd vectors, repeated rows and empty tables: see ``vector_blocks``; zero vectors take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame

from cautela.llm.vector_blocks import block_join, prepared, unpacked

#: Rows of a tile on either side.
TILE = 1024


class Rounded:
    """A block with its int8 form, kept as float32 so that one BLAS product of it is exact (64 x 127^2 < 2^24)."""

    def __init__(self, row: dict):
        self.ids, self.vecs = unpacked(row)
        self.scale = np.abs(self.vecs).max(axis=1) / 127
        safe = np.where(self.scale > 0, self.scale, 1)
        codes = np.rint(self.vecs / safe[:, None]).astype(np.int8)
        self.wide = codes.shape[1] * 127**2 >= 2**24
        self.codes = codes.astype(np.float64 if self.wide else np.float32)
        near = codes * self.scale[:, None]
        self.norm = np.linalg.norm(self.vecs, axis=1)
        self.near_norm = np.linalg.norm(near, axis=1)
        self.error = np.linalg.norm(self.vecs - near, axis=1)


def tile_bounds(left: Rounded, right: Rounded, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Products of the rounded rows, and the bound of their error."""
    product = (left.codes[a] @ right.codes[b].T).astype(np.float64)
    product *= left.scale[a, None] * right.scale[None, b]
    error = left.error[a, None] * right.norm[None, b] + left.near_norm[a, None] * right.error[None, b]
    return product, error * (1 + 1e-9) + 1e-12 * left.norm[a, None] * right.norm[None, b]


def search_tiles(k: int):
    def search(query_blocks: list[dict], data_blocks: list[dict]):
        data = [Rounded(d) for d in data_blocks]
        out: list[tuple[int, int, float]] = []
        for block in query_blocks:
            queries = Rounded(block)
            heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
            kth = np.full(len(queries.ids), -np.inf)
            for part in data:
                for a0 in range(0, len(queries.ids), TILE):
                    for b0 in range(0, len(part.ids), TILE):
                        _tile(queries, part, slice(a0, a0 + TILE), slice(b0, b0 + TILE), k, heaps, kth)
            out += [(int(q), -i, s) for q, heap in zip(queries.ids, heaps, strict=True) for s, i in heap]
        kinds = (np.int64, np.int64, np.float64)
        return tuple(np.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))

    return search


def _tile(queries: Rounded, data: Rounded, a: slice, b: slice, k: int, heaps: list, kth: np.ndarray) -> None:
    product, error = tile_bounds(queries, data, a, b)
    own = queries.ids[a, None] == data.ids[None, b]
    product[own] = -np.inf
    floor = kth[a]
    if product.shape[1] >= k:
        lower = np.where(own, -np.inf, product - error)
        floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
    rows, columns = np.nonzero((product + error >= floor[:, None]) & ~own)
    scores = np.einsum("ij,ij->i", queries.vecs[a][rows], data.vecs[b][columns])
    ids = data.ids[b][columns]
    for row, score, found in zip((rows + a.start).tolist(), scores.tolist(), ids.tolist(), strict=True):
        heap = heaps[row]
        if len(heap) < k:
            heapq.heappush(heap, (score, -found))
        elif (score, -found) > heap[0]:
            heapq.heapreplace(heap, (score, -found))
        if len(heap) == k:
            kth[row] = heap[0][0]


def nearest(df: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision) of each query's ``k`` nearest."""
    rows = prepared(df, row_id, vector, zero=False)
    return block_join(rows, rows.filter(is_query), k, search_tiles(k), "double")
