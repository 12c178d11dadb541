"""Near-duplicate embeddings by int8 tile products with error bounds.

Each unit vector u is stored as scale * q (q int8) with its quantisation error e = |u - scale*q|.
For two vectors |u.v - su*sv*(qu.qv)| <= eu + ev*(1 + eu), so a pair whose integer product plus
that bound stays below the threshold is proven to be no link; the others are recomputed in double
precision from the original components. The result is exact.

Defined cases: rows of one vec_id count once (the smallest row), rows without vec_id are left
out; null labels, null, empty or zero vectors and vectors with null or non-finite components
link with nothing; vectors of different lengths never link. Empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.components import chains, connected_components, forest
from lodeframe.llm.tables import one_per_id, written

THRESHOLD = 0.98
#: Vectors of one label in a tile; a task holds two tiles.
TILE = 2048
#: Vectors in one matrix product.
BLOCK = 1024


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, double matrix) by vector length, of the rows that can be compared."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        values = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        if good.any():
            yield rows[good], values[good]


def unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and an upper bound of each vector's quantisation error."""
    scale = np.abs(units).max(axis=1) / 127.0
    codes = np.rint(units / scale[:, None])
    rest = units - codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-9) + 1e-12


QUANTISED = "vec_id long, label int, dim int, codes binary, scale double, error double, raw binary"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("dim", pa.int32()), ("codes", pa.binary()), ("scale", pa.float64()), ("error", pa.float64()), ("raw", pa.binary())])
    for batch in batches:
        for rows, values in matrices(batch.column("embedding")):
            codes, scale, error = quantise(unit(values))
            raw = values.astype(np.float32)
            raw = raw if np.array_equal(raw, values) else values  # single precision where it holds every bit
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)), pa.array(np.full(len(rows), values.shape[1], np.int32)), pa.array([x.tobytes() for x in codes]), pa.array(scale), pa.array(error), pa.array([x.tobytes() for x in raw])],
                schema=schema,
            )


def _doubles(raw: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in raw]).astype(np.float64)


def tile_links(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) with cosine >= threshold; right None: pairs within left."""
    other = left if right is None else right
    dim = left["codes"].shape[1]
    kind = np.float32 if 127 * 127 * dim < 2**24 else np.float64  # integer products stay exact
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(left["scale"]), BLOCK):
        qa = left["codes"][a : a + BLOCK].astype(kind)
        for b in range(a if right is None else 0, len(other["scale"]), BLOCK):
            qb = other["codes"][b : b + BLOCK].astype(kind)
            ea, eb = left["error"][a : a + BLOCK, None], other["error"][None, b : b + BLOCK]
            product = (qa @ qb.T).astype(np.float64) * left["scale"][a : a + BLOCK, None] * other["scale"][None, b : b + BLOCK]
            i, j = np.nonzero(product + (ea + eb * (1 + ea)) >= threshold - 1e-9)
            i, j = i + a, j + b
            if right is None:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                exact = np.einsum("ij,ij->i", left["unit"][p], other["unit"][q]) >= threshold
                found.append((p[exact], q[exact]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _compared(threshold: float):
    out = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("before", pa.int64())])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        dim, same = key[1].as_py(), key[2].as_py() == key[3].as_py()
        table = table.sort_by([("side", "ascending"), ("vec_id", "ascending")])
        ids = table["vec_id"].to_numpy()
        cut = len(ids) if same else int((table["side"].to_numpy() == key[2].as_py()).sum())
        whole = {
            "codes": np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(len(ids), dim),
            "scale": table["scale"].to_numpy(), "error": table["error"].to_numpy(), "unit": unit(_doubles(table["raw"].to_pylist(), dim)),
        }
        left = {k: v[:cut] for k, v in whole.items()}
        i, j = tile_links(left, None if same else {k: v[cut:] for k, v in whole.items()}, threshold)
        j = j if same else j + cut
        links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        later, before = chains(forest(i, j, len(ids)), ids, links > 0)
        known = dict(zip(later.tolist(), before.tolist(), strict=True))
        hit = ids[links > 0]
        return pa.table([pa.array(hit), pa.array(links[links > 0]), pa.array([known.get(x) for x in hit.tolist()], pa.int64())], schema=out)

    return compare


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    base = one_per_id(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding"), "vec_id")
    codes = written(base.where("label is not null and embedding is not null").mapInArrow(_quantised, QUANTISED))
    tiles = codes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = (
        codes.join(tiles, ["label", "dim"])
        .withColumn("side", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("i", F.least("side", "other"))
        .withColumn("j", F.greatest("side", "other"))
        .drop("tiles", "other")
    )
    pairs = written(placed.groupBy("label", "dim", "i", "j").applyInArrow(_compared(threshold), "vec_id long, links long, before long"))
    links = pairs.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = connected_components(pairs.where("before is not null").select(F.col("vec_id").alias("src"), F.col("before").alias("dst")))
    return (
        base.select("vec_id")
        .join(links, "vec_id", "left")
        .join(groups.select(F.col("id").alias("vec_id"), F.col("component").alias("component_id")), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
