"""Repeated windows of `width` symbols (bytes or words) across a corpus, in three exact steps.

1. Anchors. In every window the k-gram of the smallest hash is an anchor, so equal windows have
   equal anchors at equal offsets and about two in width - k positions are anchors at all. The
   context of an anchor holds every window around it; its fingerprint is its class.
2. Classes. Anchors meet by the hash of their k-gram, copies within a task having been folded
   before the shuffle. Members of a class that come after its first are repeats as a whole.
   First members can only match in part, and only those that share half of a context with
   another class are passed on.
3. Parts. Their contexts meet by the shared half and are compared symbol by symbol.

Fingerprints are pairs of 64-bit hashes (k-gram and context).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.tables import free_name, written

U = np.uint64
ODD, OTHER = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Symbols hashed at once; anchors folded at once within a task.
PIECE, FOLD = 1 << 20, 750_000

ANCHOR = pa.schema([(c, pa.int64()) for c in ("h", "c", "x", "doc", "at")])
ANCHOR_SQL = "h long, c long, x long, doc long, at long"
FOUND = pa.schema([(c, pa.int64()) for c in ("doc", "lo", "hi", "key", "side")])
FOUND_SQL = "doc long, lo long, hi long, key long, side long"


@dataclass(frozen=True)
class Shape:
    """Window width, k-gram length, the power of two that contexts are hashed by, and whether only other documents count."""

    width: int
    gram: int
    block: int
    others_only: bool

    @property
    def reach(self) -> int:
        return self.width - self.gram

    @property
    def half(self) -> int:
        return self.reach // 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sliding(values: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over each run of `size` values; shorter than values by size - 1."""
    have = 1
    while have * 2 <= size:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (size - have)], values[size - have :]) if size > have else values


def hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` symbols from each position on, 0 where the array ends before."""
    have, h, factor = 1, mix(symbols + ODD), int(ODD)
    while have * 2 <= length:
        h = h[:-have] * U(factor) + h[have:]
        have, factor = have * 2, (factor * factor + 2) % (1 << 64)
        h ^= h >> U(32)
    if length > have:
        h = h[: len(h) - (length - have)] * OTHER + h[length - have :]
    out = np.zeros(len(symbols), U)
    out[: len(h)] = h
    return out


def anchors(symbols: np.ndarray, lengths: np.ndarray, docs: np.ndarray, shape: Shape, at: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Anchors of documents laid end to end: h, c, x, doc, at (place * 256 + symbols to the context's end).

    at: places to take instead of the k-grams that are smallest in a window.
    """
    ends = np.cumsum(lengths)
    if len(symbols) < shape.width:
        return {c: np.zeros(0, np.int64) for c in ANCHOR.names}
    gram = mix(hashes(symbols, shape.gram))
    if at is None:
        at = picked(gram, ends, lengths, shape)
    owner = np.searchsorted(ends, at, side="right")
    end, start = ends[owner], ends[owner] - lengths[owner]
    left, right = np.minimum(shape.reach, at - start), np.minimum(shape.width, end - at)
    whole = left + right >= shape.width
    at, owner, end, start, left, right = (x[whole] for x in (at, owner, end, start, left, right))
    block = hashes(symbols, shape.block)

    def around(offsets: list[int], seed: int) -> np.ndarray:
        total = np.full(len(at), seed, U)
        for off in offsets:
            total = total * OTHER + block[np.clip(at + off, start, end - shape.block)]
            total ^= total >> U(29)
        return mix(total)

    b, half = shape.block, shape.half
    spread = lambda low, high: sorted({*range(low, high - b, b), high - b})
    context = around(spread(-shape.reach, 0) + spread(0, shape.width), 1) + left.astype(U) * ODD + right.astype(U) * OTHER
    before = np.where(left >= half, around(spread(-half, 0) if half >= b else [-half], 2) >> U(33), U(0))
    after = np.where(right >= shape.width - half + 1, around(spread(0, shape.width - half + 1), 3) >> U(33), U(0))
    return {
        "h": gram[at].view(np.int64), "c": mix(context).view(np.int64), "x": ((before << U(32)) | after).view(np.int64),
        "doc": docs[owner], "at": (at - start) * 256 + right,
    }


def picked(gram: np.ndarray, ends: np.ndarray, lengths: np.ndarray, shape: Shape) -> np.ndarray:
    keys = np.maximum((gram >> U(32)).astype(np.uint32), np.uint32(1))
    size = shape.reach + 1
    lows = sliding(keys, size, np.minimum)
    room = np.repeat(ends, lengths) - np.arange(len(keys))
    lows = np.where(room[: len(lows)] >= shape.width, lows, np.uint32(0))
    pad = np.zeros(size - 1, np.uint32)
    highs = sliding(np.concatenate([pad, lows, pad]), size, np.maximum)[: len(keys)]
    return np.flatnonzero(highs == keys)


def folded(rows: dict[str, np.ndarray], shape: Shape) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sorted by (h, c, doc, at), and which of them repeat their class's first member."""
    order = np.lexsort((rows["at"], rows["doc"], rows["c"], rows["h"]))
    rows = {k: v[order] for k, v in rows.items()}
    new = np.ones(len(order), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    if shape.others_only:
        lead = rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
        return rows, rows["doc"] > lead
    return rows, ~new


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    run = np.cumsum(first)
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + run * span) - run * span
    new = first.copy()
    new[1:] |= lo[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return doc[starts], lo[starts], np.maximum.reduceat(hi, starts)


def spans_of(rows: dict[str, np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, right = rows["at"] >> 8, rows["at"] & 255
    return merged(rows["doc"], np.maximum(0, place - shape.reach), place + right)


def fold_rows(pieces: Iterator[dict[str, np.ndarray]], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Anchors of a task for the shuffle: repeats within the task leave as finished spans (at = -1)."""
    held: list[dict[str, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        rows, again = folded({k: np.concatenate([x[k] for x in held]) for k in ANCHOR.names}, shape)
        doc, lo, hi = spans_of({k: v[again] for k, v in rows.items()}, shape)
        out = {"h": mix(doc.astype(U) + ODD).view(np.int64), "c": lo, "x": hi, "doc": doc, "at": np.full(len(doc), -1)}
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rows[k][~again], out[k]])) for k in ANCHOR.names], schema=ANCHOR)

    size = 0
    for rows in pieces:
        held.append(rows)
        size += len(rows["h"])
        if size >= FOLD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def classes(anchor_rows: DataFrame, shape: Shape) -> DataFrame:
    """Anchors -> finished spans (doc, lo, hi; key null) and first members to compare in part (lo = at, key, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), ANCHOR)  # one of the partitions that the shuffle made
        rows = {k: table[k].to_numpy() for k in ANCHOR.names}
        done = rows["at"] < 0
        parts = [(rows["doc"][done], rows["c"][done], rows["x"][done])]
        rows, again = folded({k: v[~done] for k, v in rows.items()}, shape)
        parts.append(spans_of({k: v[again] for k, v in rows.items()}, shape))
        doc, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(3))
        none = pa.nulls(len(doc), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi), none, none], schema=FOUND)
        first = {k: v[~again] for k, v in rows.items()}
        for side in (0, 1):
            shared = (first["x"].view(U) >> U(32)) if side == 0 else (first["x"].view(U) & U(0xFFFFFFFF))
            key = mix(first["h"].view(U) * OTHER + (shared << U(1)) + U(side))
            kept = np.flatnonzero(shared != 0)
            kept = kept[np.lexsort((first["c"][kept], key[kept]))]
            k, c = key[kept], first["c"][kept]
            head = np.ones(len(k), bool)
            head[1:] = k[1:] != k[:-1]
            starts = np.flatnonzero(head)
            if not len(starts):
                continue
            several = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
            kept = kept[np.repeat(several, np.diff(np.append(starts, len(k))))]
            yield pa.RecordBatch.from_arrays([pa.array(first["doc"][kept]), pa.array(first["at"][kept]), pa.nulls(len(kept), pa.int64()), pa.array(key[kept].view(np.int64)), pa.array(np.full(len(kept), side))], schema=FOUND)

    return anchor_rows.repartition("h").mapInArrow(run, FOUND_SQL)


def part(at: int, side: int, size: int, shape: Shape) -> tuple[int, int]:
    """First and end symbol of the context that one side compares, in a document of `size` symbols."""
    place = at >> 8
    low, high = (place - shape.reach, place + shape.width - shape.half) if side == 0 else (place - shape.half + 1, place + shape.width)
    return max(0, low), min(size, high)


def capped_ranks(symbols: np.ndarray, width: int, starts: np.ndarray, packed: bool) -> np.ndarray:
    """Ranks of the suffixes at `starts`, cut after `width` symbols: suffix order by prefix doubling."""
    have, rank = 1, symbols.astype(np.int64)
    if packed and width >= 8 and len(symbols) >= 8:  # bytes: the first eight in one number
        have = 8
        wide = np.zeros(len(symbols) - 7, U)
        for k in range(8):
            wide = (wide << U(8)) | symbols[k : len(symbols) - 7 + k].astype(U)
        rank = np.unique(wide, return_inverse=True)[1].astype(np.int64)
    while have * 2 <= width:
        pair = rank[:-have] * (int(rank.max()) + 1) + rank[have:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have *= 2
    pair = rank[starts] * (int(rank.max()) + 1) + rank[starts + width - have]
    return np.unique(pair, return_inverse=True)[1]


def previous(rank: np.ndarray, doc: np.ndarray, place: np.ndarray, others_only: bool) -> np.ndarray:
    """Whether a suffix has an earlier one that is equal over the capped length.

    In suffix order with equal capped suffixes by text position, the previous smaller position of
    a suffix is its neighbour, whose common prefix reaches the cap: the capped longest previous
    factor. The next smaller position is never nearer than that.
    """
    order = np.lexsort((place, doc, rank))
    r, d, p = rank[order], doc[order], place[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    earlier = (d > d[lead]) if others_only else ((d > d[lead]) | (p > p[lead]))
    out = np.zeros(len(r), bool)
    out[order] = earlier
    return out


def compared(contexts: DataFrame, shape: Shape, symbols_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], packed: bool) -> DataFrame:
    """contexts (key, doc, lo, content) -> finished spans (doc, lo, hi)."""
    fields = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def groups(table: pa.Table) -> Iterator[pa.Table]:
        """Whole keys, about PIECE symbols at once."""
        keys = table["key"].to_numpy()
        starts = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys))
        a = 0
        for b in starts[1:]:
            if b - a >= PIECE // shape.width or b == len(keys):
                yield table.slice(a, b - a)
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held)
        for some in groups(table.sort_by([("key", "ascending")])):
            symbols, lengths = symbols_of(some["content"].to_pylist())
            windows = np.maximum(0, lengths - shape.width + 1)
            owner = np.repeat(np.arange(len(lengths)), windows)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            if not len(owner):
                continue
            rank = capped_ranks(symbols, shape.width, (np.cumsum(lengths) - lengths)[owner] + within, packed)
            doc, place = some["doc"].to_numpy()[owner], some["lo"].to_numpy()[owner] + within
            again = previous(rank, doc, place, shape.others_only)
            spans = merged(doc[again], place[again], place[again] + shape.width)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], schema=fields)

    return contexts.repartition("key").mapInArrow(run, "doc long, lo long, hi long")


def by_document(found: DataFrame) -> DataFrame:
    """Spans gathered per document: doc_id, lo, hi (arrays in matching order)."""
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    return spans.select(F.col("doc").alias("doc_id"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def union_spans(lo: list[int] | None, hi: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs, ascending."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo or (), hi or (), strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def text_documents(documents: DataFrame) -> DataFrame:
    """doc_id and text, one row per doc_id (of several the smallest text), without rows that have no doc_id."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return rows.groupBy("doc_id").agg(F.min("text").alias("text")) if twice else rows


def keyed(documents: DataFrame, key: str) -> DataFrame:
    """documents with a key of its own for every row, in order of doc_id (null last).

    Unique doc_ids are their own keys. Otherwise rows are sorted by ranges of doc_id, a hash of all
    columns and a distributed number, numbered in that order and written once.
    """
    doc_id = F.col("doc_id").cast("long")
    groups = documents.select(doc_id.alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not groups.where("n > 1 or doc_id is null").limit(1).count():
        return documents.withColumn(key, doc_id)
    spark = documents.sparkSession
    whole = free_name(documents.withColumn(key, F.lit(0)), "_all")
    rows = documents.withColumn(whole, F.xxhash64(*documents.columns)).withColumn(key, F.monotonically_increasing_id())
    order = [doc_id.asc_nulls_last(), F.col(whole), F.col(key)]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return written(rows.withColumn(key, F.monotonically_increasing_id()).drop(whole))


def keyed_texts(rows: DataFrame, key: str) -> DataFrame:
    """doc_id (the key) and text of every row."""
    return rows.select(F.col(key).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
