"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

With M the largest norm, the points (x, sqrt(M^2 - |x|^2)) and the query (q, 0) have squared
distance |q|^2 + M^2 - 2 q.x, so the nearest point has the largest inner product and triangle
inequalities hold. A subtree is skipped when its lower bound exceeds factor * the k-th distance:
factor 1 is exact, smaller factors skip more.

Every row is in a tree; only blocks of queries are sent to the shards, never the whole set to
one task. Defined cases: rows of one vec_id count once (the smallest row); rows without vec_id,
null, empty or zero vectors and vectors with null or non-finite components take no part; only
vectors of equal length are compared; fewer candidates than k give them all; equal scores go to
the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.embedding_dedup import matrices
from lodeframe.llm.tables import one_per_id, written

#: Candidates in a shard's tree, queries in a block, points in a leaf.
SHARD, QUERIES, LEAF = 8192, 2048, 256


class VantageTree:
    """Median-split vantage-point tree over the rows of `points` (already augmented)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        centre, rest = rows[0], rows[1:]
        gap = np.sqrt(((self.points[rest] - self.points[centre]) ** 2).sum(axis=1))
        order = np.argsort(gap, kind="stable")
        half = len(rest) // 2
        sides = [(gap[part[0]], gap[part[-1]], self._build(rest[part])) for part in (order[:half], order[half:])]
        return int(centre), sides


def search(tree: VantageTree, queries: np.ndarray, originals: np.ndarray, ids: np.ndarray, own: np.ndarray, reach: float, k: int, factor: float):
    """Arrays (query row, id, score): the k best of the tree for each query, exact for factor 1."""
    scale = np.einsum("ij,ij->i", queries, queries)
    padded = np.hstack([queries, np.zeros((len(queries), 1))])
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(active: np.ndarray, rows: np.ndarray) -> None:
        floor = best[active, -1]
        near = queries[active] @ originals[rows].T
        a, c = np.nonzero(near >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None])
        a, c = a[ids[rows[c]] != own[active[a]]], c[ids[rows[c]] != own[active[a]]]
        if not len(a):
            return
        exact = np.einsum("ij,ij->i", queries[active[a]], originals[rows[c]])
        hit = np.unique(a)
        q = np.concatenate([a, np.repeat(hit, k)])
        s = np.concatenate([exact, best[active[hit]].ravel()])
        i = np.concatenate([ids[rows[c]], best_id[active[hit]].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        best[active[q[keep]], place[keep]] = s[keep]
        best_id[active[q[keep]], place[keep]] = i[keep]

    def visit(node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                offer(active, node)
            return
        centre, sides = node
        offer(active, np.array([centre]))
        gap = np.sqrt(np.maximum(0, ((padded[active] - tree.points[centre]) ** 2).sum(axis=1)))
        inner_first = np.abs(gap - sides[0][0]) + np.abs(gap - sides[0][1]) <= np.abs(gap - sides[1][0]) + np.abs(gap - sides[1][1])
        for first in (True, False):
            for number, (low, high, child) in enumerate(sides):
                mine = inner_first == ((number == 0) == first)
                bound = np.maximum(0, np.maximum(gap - high, low - gap))
                limit = np.sqrt(np.maximum(0, scale[active] + reach * reach - 2 * best[active, -1]))
                visit(child, active[mine & ~(bound > factor * limit + 1e-7 * (1 + reach))])

    visit(tree.root, np.arange(len(queries)))
    at, place = np.nonzero(np.isfinite(best))
    return at, best_id[at, place], best[at, place]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("raw", pa.binary())])
    for batch in batches:
        for rows, values in matrices(batch.column("embedding")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), values.shape[1], np.int32)), pa.array(np.sqrt((values**2).sum(axis=1))), pa.array([x.tobytes() for x in values])],
                schema=schema,
            )


def _searched(reach: float, k: int, factor: float):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        table = table.sort_by([("asks", "ascending"), ("vec_id", "ascending")])
        ids = table["vec_id"].to_numpy()
        values = np.frombuffer(b"".join(table["raw"].to_pylist()), np.float64).reshape(len(ids), dim)
        cut = int((~table["asks"].to_numpy(zero_copy_only=False)).sum())
        if cut == 0 or cut == len(ids):
            return out.empty_table()
        points = values[:cut]
        rest = np.sqrt(np.maximum(0, reach * reach - np.einsum("ij,ij->i", points, points)))
        tree = VantageTree(np.hstack([points, rest[:, None]]))
        at, found, score = search(tree, values[cut:], points, ids[:cut], ids[cut:], reach, k, factor)
        return pa.table([pa.array(ids[cut:][at]), pa.array(found), pa.array(score)], schema=out)

    return run


def nearest(vectors: DataFrame, asks: str, k: int = 20, factor: float = 1.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """vectors (vec_id, embedding); `asks` is the SQL condition for query rows -> query_id, rank, vec_id, score."""
    base = one_per_id(vectors.select(F.col("vec_id").cast("long"), "embedding"), "vec_id").where("embedding is not null")
    usable = written(base.mapInArrow(_usable, "vec_id long, dim int, norm double, raw binary"))
    asked = usable.where(asks)
    total, reach, queries = usable.agg(F.count(F.lit(1)), F.coalesce(F.max("norm"), F.lit(0.0)), F.count_if(F.expr(asks))).first()
    shards, blocks = max(1, -(-total // shard)), max(1, -(-queries // block))
    key = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = usable.select("vec_id", "dim", "raw", F.lit(False).alias("asks"), key(shards).alias("shard"), every(blocks).alias("block"))
    asking = asked.select("vec_id", "dim", "raw", F.lit(True).alias("asks"), every(shards).alias("shard"), key(blocks).alias("block"))
    found = stored.unionByName(asking).groupBy("dim", "shard", "block").applyInArrow(_searched(reach, k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
