"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.tables import written


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component, for pairs among n nodes of one task."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def chains(label: np.ndarray, ids: np.ndarray, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as chains of ascending ids: (id, the id before it) for all but the first of each."""
    at = np.flatnonzero(touched)
    at = at[np.lexsort((ids[at], label[at]))]
    same = label[at][1:] == label[at][:-1]
    return ids[at][1:][same], ids[at][:-1][same]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (src, dst) -> (id, component): the smallest id reachable, for every id that has an edge.

    Every step is a partial aggregate and an equi-join on long ids; a hub's neighbours are never
    gathered, only their minimum is. Loops and repeated edges don't matter; no edges give no rows.
    """
    current = written(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
