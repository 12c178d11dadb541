"""Exact substring dedup by longest-previous-factor arrays over a sharded suffix order.

Every byte covered by a `WIDTH`-byte string that also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed; the first occurrence stays. Strings are judged on the
input and never cross documents. Passages that can't repeat never reach the suffix arrays: see
`windows` for the anchors that find the shards. In a shard the suffixes of all contexts are ranked
by prefix doubling up to WIDTH bytes, and the previous smaller position in suffix order tells
whether a string occurs earlier. The result is exact, whatever the sizes.

Defined cases: a null text is empty; texts shorter than WIDTH lose nothing; of several rows with
one doc_id the one with the smallest text counts; rows without doc_id are left out; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import windows as W
from lodeframe.llm.tables import written

WIDTH = 100


def shape_for(width: int) -> W.Shape:
    gram = 1 << max(1, (width // 3).bit_length() - 1) if width >= 12 else max(1, width // 2)
    block = 1
    while block * 2 <= min(gram, (width - gram) // 2 or 1):
        block *= 2
    return W.Shape(width, gram, block, False)


def _pieces(batches: Iterator[pa.RecordBatch], shape: W.Shape) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        a, size = 0, 0
        for b in range(len(texts) + 1):
            if b == len(texts) or (size and size + len(texts[b]) > W.PIECE):
                long = [k for k in range(a, b) if len(texts[k]) >= shape.width]
                if long:
                    symbols = np.frombuffer(b"".join(texts[k] for k in long), np.uint8).astype(np.uint64)
                    yield W.anchors(symbols, np.array([len(texts[k]) for k in long]), ids[long], shape)
                a, size = b, 0
            if b < len(texts):
                size += len(texts[b])


def _bytes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(contents), np.uint8), np.array([len(x) for x in contents])


def _contexts(batches: Iterator[pa.RecordBatch], shape: W.Shape) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        rows = []
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for x in asked:
                low, high = W.part(x["lo"], x["side"], len(text), shape)
                if high - low >= shape.width:
                    rows.append((x["key"], doc, low, text[low:high]))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def repeated_spans(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """texts (doc_id, text) -> doc, lo, hi: spans of bytes that occur earlier; they may overlap."""
    shape = shape_for(width)
    found = written(W.classes(texts.mapInArrow(lambda b: W.fold_rows(_pieces(b, shape), shape), W.ANCHOR_SQL), shape))
    asked = found.where("key is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "side", "lo")).alias("asked"))
    contexts = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(lambda b: _contexts(b, shape), "key long, doc long, lo long, content binary")
    parts = W.compared(contexts, shape, _bytes, packed=True)
    return found.where("key is null").select("doc", "lo", "hi").unionByName(parts)


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def suffix_dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = W.text_documents(documents)
    rows = texts.join(W.by_document(repeated_spans(texts, width)), "doc_id", "left").select("doc_id", "text", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests = [], [], [], []
            for text, lo, hi in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs = W.union_spans(lo, hi)
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
                digests.append(hashlib.sha256(cut(text, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
