"""Packing by cutting-stock column generation.

Documents become token ids (byte-level BPE, then the end id) and are cut into full sequences and
one remainder. Piece lengths are rounded up to classes of `GRAIN` tokens; the histogram of classes
is at most CAPACITY / GRAIN numbers, whatever the input. A linear program over patterns (how many
pieces of each class share a sequence) is solved by the revised simplex method; a knapsack dynamic
program over the duals prices new patterns. Whole parts of the solution are used, the rest is
filled greedily from the longest class. Pieces, ranked within their class, find their sequence by
a join with the table of patterns, which is as small as the histogram.

The ids are those of the tokenizers file; they are computed by tiktoken from that file's own
vocabulary, which is several times faster. Defined cases: a null text is an empty one and gives
the end id alone; repeated or null doc_ids are packed row by row; a long text is encoded as a whole and cut into pieces; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.tables import numbered, written

CAPACITY, GRAIN, END = 2048, 8, 1
NUMBERED = 4000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoding(path: str):
    """The byte-level BPE of a tokenizers file, as a tiktoken encoding."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocabulary, special = whole["model"]["vocab"], {t["content"]: t["id"] for t in whole["added_tokens"]}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(letters[c] for c in word): rank for word, rank in vocabulary.items() if word not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def document_ids(text: str | None, path: str) -> np.ndarray:
    ids = encoding(path).encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END)).astype("<u4")


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    out = pa.schema([*kinds, *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in out]
            known: dict[str, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cuts = known.get(text) if text else None
                if cuts is None:
                    ids = document_ids(text, path)
                    cuts = [(a, len(part := ids[a : a + capacity]), zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if with_ids else [])) for a in range(0, len(ids), capacity)]
                    if text:
                        known[text] = cuts
                for cut in cuts:
                    for column, value in zip(columns, (doc_id, *cut), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, fields)


def priced(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern for the duals: an unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        value = np.where(fits, best[c - np.minimum(sizes, c)] + duals, -np.inf)
        k = int(value.argmax())
        best[c], pick[c] = (value[k], k) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), pattern


def plan(demand: dict[int, int], room: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """demand: pieces by size (1 to room) -> (pattern: pieces by size, how many sequences), covering it exactly."""
    sizes = np.array(sorted((s for s, n in demand.items() if n > 0), reverse=True), np.int64)
    need = np.array([demand[int(s)] for s in sizes], np.int64)
    if not len(sizes):
        return []
    patterns = np.diag(room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    amount = inverse @ need
    for _ in range(rounds):
        value, column = priced(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.maximum(step, 1e-9), np.inf)
        row = int(ratio.argmin())
        patterns[:, row] = column
        inverse[row] /= step[row]
        amount[row] = max(0.0, ratio[row])
        others = np.arange(len(sizes)) != row
        inverse[others] -= np.outer(step[others], inverse[row])
        amount[others] = np.maximum(0, amount[others] - step[others] * amount[row])
    whole = np.floor(amount + 1e-7).astype(np.int64)
    left = need - patterns @ whole
    while (left < 0).any():  # rounding noise: give back a sequence
        short = int(np.flatnonzero(left < 0)[0])
        given = int(np.flatnonzero((patterns[short] > 0) & (whole > 0))[0])
        whole[given] -= 1
        left += patterns[:, given]
    chosen = [(patterns[:, k], int(n)) for k, n in enumerate(whole) if n]
    while left.any():
        pattern, space = np.zeros(len(sizes), np.int64), room
        for k in np.flatnonzero(left):
            take = min(space // int(sizes[k]), int(left[k]))
            pattern[k], space = take, space - take * int(sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        chosen.append((pattern, times))
        left -= pattern * times
    return [({int(s): int(a) for s, a in zip(sizes, p, strict=True) if a}, n) for p, n in chosen]


def _places(spark: SparkSession, chosen: list[tuple[dict[int, int], int]]) -> DataFrame:
    """A row for each pattern and class: ranks [low, high) of the class go, `each` a sequence, to the sequences from `first` on."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in chosen:
        for size, each in pattern.items():
            low = used.get(size, 0)
            used[size] = low + each * times
            rows.append((size, low, used[size], each, first))
        first += times
    return spark.createDataFrame(rows, "class int, low long, high long, each long, first long")


def packed(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """pieces -> the same with sequence_id and offset, gapless in every sequence."""
    cut = written(cut.withColumn("class", F.ceil(F.col("length") / grain).cast("int")))
    histogram = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity / grain rows at most
    rows = sum(histogram.values())
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "length")]
    ranked = numbered(cut, ["class"], order, "rank", max(4, -(-rows // (max(1, len(histogram)) * NUMBERED))))
    places = F.broadcast(_places(cut.sparkSession, plan(histogram, capacity // grain)))
    placed = ranked.join(places, (ranked["class"] == places["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    before = Window.partitionBy("sequence_id").orderBy(ranked["class"].desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .select(*(c for c in cut.columns if c != "class"), F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    )


def pack(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    return packed(pieces(documents, path or default_tokenizer(), with_ids=with_ids))
