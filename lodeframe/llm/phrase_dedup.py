"""Substring dedup by repeated-phrase automata.

A window of `WIDTH` words is a repeat if its word sequence also starts in a document with a
smaller doc_id; every word that such a window covers is removed.

1. Confirm: the 10-word phrases that every window must contain (see `windows`) are counted over
   the corpus; a phrase recurs if its smallest and largest doc_id differ.
2. Compile: the confirmed phrases, spelt in words, go to every shard of documents (about
   `SHARD_BYTES` each) that holds one of them; the shard compiles them into Aho-Corasick automata
   once, `PHRASES` to an automaton.
3. Stream: the documents of the shard run through all its automata, which alone report where
   confirmed phrases occur.
4. Check: occurrences with their contexts are compared across the corpus, so that a window is
   removed exactly if it is a repeat.

Words are compared by 64-bit hashes, inside phrases by 32 bits each; results are exact up to hash collisions. Defined cases: a null text has no words; texts of fewer than
WIDTH words lose nothing; of several rows with one doc_id the one with the smallest text counts;
rows without doc_id are left out; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import windows as W
from lodeframe.llm.tables import free_name, parts_for, written

WIDTH = 50
SHARD_BYTES, PHRASES = 8 << 20, 50_000
U = np.uint64
LETTERS = W.mix(np.arange(1, 257, dtype=U) * W.ODD)
PHRASE = pa.schema([*((c, pa.int64()) for c in ("h", "shard", "low", "high")), ("spelt", pa.binary())])
PART = 16 << 20


def shape_for(width: int) -> W.Shape:
    gram = max(1, width // 5)
    block = 1
    while block * 2 <= min(gram, max(1, (width - gram) // 2)):
        block *= 2
    return W.Shape(width, gram, block, True)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.flatnonzero(~gap)
    ends = np.cumsum([len(x) + 1 for x in texts])
    if not len(inside):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    first = np.ones(len(inside), bool)
    first[1:] = np.diff(inside) > 1
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(inside)))
    within = np.arange(len(inside)) - np.repeat(starts, size)
    factors = W.mix(np.arange(size.max(), dtype=U) + W.OTHER) | U(1)
    total = np.add.reduceat(LETTERS[raw[inside]] * factors[within], starts)
    counts = np.diff(np.searchsorted(inside[starts], ends), prepend=0)
    return W.mix(total + size.astype(U)), counts


def text_pieces(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    a, size = 0, 0
    for b in range(len(texts) + 1):
        if b == len(texts) or (size and size + len(texts[b]) > W.PIECE):
            if b > a:
                yield np.arange(a, b), texts[a:b]
            a, size = b, 0
        if b < len(texts):
            size += len(texts[b])


def _phrases(batches: Iterator[pa.RecordBatch], shape: W.Shape) -> Iterator[pa.RecordBatch]:
    """A row for each phrase and shard of the task: h, shard, smallest and largest doc_id, its words."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        h, shard, doc, words = (np.concatenate([x[k] for x in held]) for k in range(4))
        order = np.lexsort((doc, shard, h))
        h, shard, doc = h[order], shard[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h)) - 1 if len(at) else at
        spelt = words[order[at]]
        offsets = np.arange(len(at) + 1, dtype=np.int32) * (4 * shape.gram)
        column = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spelt))])
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (h[at], shard[at], doc[at], doc[last])), column], schema=PHRASE)

    for batch in batches:
        ids, shards = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for rows, texts in text_pieces(ids, batch.column(1).cast(pa.binary()).to_pylist()):
            symbols, counts = word_hashes(texts)
            if len(symbols) < shape.width:
                continue
            gram, ends = W.mix(W.hashes(symbols, shape.gram)), np.cumsum(counts)
            at = W.picked(gram, ends, counts, shape)
            owner = rows[np.searchsorted(ends, at, side="right")]
            held.append((gram[at].view(np.int64), shards[owner], ids[owner], short(symbols)[at[:, None] + np.arange(shape.gram)]))
            size += len(at)
            if size >= W.FOLD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), PHRASE)  # one of the partitions that the shuffle made
    h, shard, low, high = (table[c].to_numpy() for c in PHRASE.names[:4])
    order = np.lexsort((shard, h))
    h, shard, low, high = h[order], shard[order], low[order], high[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if len(at):
        several = np.repeat(np.minimum.reduceat(low, at) < np.maximum.reduceat(high, at), np.diff(np.append(at, len(h))))
        several &= np.append(True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1]))
        order, shard = order[several], shard[several]
    spelt = table["spelt"].combine_chunks() if len(h) else pa.array([], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(shard), spelt.take(pa.array(order))], names=["shard", "spelt"])


def short(symbols: np.ndarray) -> np.ndarray:
    """32 bits of every word's hash."""
    return (symbols >> U(32)).astype("<u4")


def written_as(codes: np.ndarray) -> str:
    """Numbers from 1 on as letters, without surrogates."""
    return np.where(codes >= 0xD800, codes + 0x800, codes).astype("<u4").tobytes().decode("utf-32-le")


def compiled(phrases: np.ndarray) -> Iterator[tuple[np.ndarray, object]]:
    """phrases (a row of words each) -> for every PHRASES of them the words that have a letter, and the automaton."""
    import ahocorasick

    length = phrases.shape[1]
    for k in range(0, len(phrases), PHRASES):
        alphabet, spelt = np.unique(phrases[k : k + PHRASES], return_inverse=True)
        automaton = ahocorasick.Automaton()
        whole = written_as(spelt.ravel() + 1)
        for a in range(0, len(whole), length):
            automaton.add_word(whole[a : a + length], 1)
        automaton.make_automaton()
        yield alphabet, automaton


def located(symbols: np.ndarray, counts: np.ndarray, automata: list[tuple[np.ndarray, object]], length: int) -> np.ndarray:
    """Places in documents laid end to end where the automata report a phrase."""
    found, words = [np.zeros(0, np.int64)], short(symbols)
    starts = np.cumsum(counts) - counts
    for alphabet, automaton in automata:
        near = np.minimum(np.searchsorted(alphabet, words), len(alphabet) - 1)
        stream = written_as(np.where(alphabet[near] == words, near + 1, 0))
        for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
            if count >= length:
                ends = np.fromiter((end for end, _ in automaton.iter(stream, start, start + count)), np.int64)
                found.append(ends - length + 1)
    return np.unique(np.concatenate(found))


def _streamed(shape: W.Shape):
    def run(key: tuple, phrases: pa.Table, documents: pa.Table) -> pa.Table:
        spelt = np.frombuffer(b"".join(phrases["spelt"].to_pylist()), "<u4").reshape(-1, shape.gram)
        automata = list(compiled(spelt))  # once for all documents of the shard
        documents = documents.sort_by([("doc_id", "ascending")])
        ids, texts = documents["doc_id"].to_numpy(), documents["text"].cast(pa.binary()).to_pylist()

        def pieces() -> Iterator[dict[str, np.ndarray]]:
            for rows, some in text_pieces(ids, texts) if automata else ():
                symbols, counts = word_hashes(some)
                if len(symbols) >= shape.width:
                    at = located(symbols, counts, automata, shape.gram)
                    if len(at):
                        yield W.anchors(symbols, counts, ids[rows], shape, at=at)

        return pa.Table.from_batches(list(W.fold_rows(pieces(), shape)), W.ANCHOR)

    return run


def _words(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    symbols, counts = word_hashes(contents)
    return np.unique(symbols, return_inverse=True)[1], counts


def _contexts(batches: Iterator[pa.RecordBatch], shape: W.Shape) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        rows = []
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            for x in asked:
                low, high = W.part(x["lo"], x["side"], len(words), shape)
                if high - low >= shape.width:
                    rows.append((x["key"], doc, low, b" ".join(words[low:high])))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def repeated_words(texts: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """texts (doc_id, text) -> doc, lo, hi: spans of words that occur in an earlier document; they may overlap."""
    shape = shape_for(width)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-total // shard_bytes)))).alias("shard"))
    phrases = dealt.mapInArrow(lambda b: _phrases(b, shape), "h long, shard long, low long, high long, spelt binary")
    recurring = phrases.repartition(parts_for(texts.sparkSession, total, PART), "h").mapInArrow(_recurring, "shard long, spelt binary")
    occurrences = recurring.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_streamed(shape), W.ANCHOR_SQL)
    found = written(W.classes(occurrences, shape))
    asked = found.where("key is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "side", "lo")).alias("asked"))
    contexts = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(lambda b: _contexts(b, shape), "key long, doc long, lo long, content binary")
    return found.where("key is null").select("doc", "lo", "hi").unionByName(W.compared(contexts, shape, _words, packed=False))


def kept_words(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    words, kept, at = text.split(), [], 0
    for a, b in runs:
        kept += words[at:a]
        at = b
    return len(words), kept + words[at:]


def phrase_dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    texts = W.text_documents(documents)
    rows = texts.join(W.by_document(repeated_words(texts, width)), "doc_id", "left").select("doc_id", "text", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests = [], [], []
            for text, lo, hi in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                count, kept = kept_words(text, W.union_spans(lo, hi))
                sizes.append(count)
                removed.append(count - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of documents; texts that repeat passages of earlier rows keep their other words, joined by one space.

    Rows are ordered by doc_id, null last; those that share a doc_id or have none are documents of
    their own. A text that loses nothing stays as it is, one that loses every word leaves.
    """
    row, low, high = (free_name(documents, name) for name in ("_row", "_lo", "_hi"))
    keyed = W.keyed(documents, row)
    spans = W.by_document(repeated_words(W.keyed_texts(keyed, row), width))
    rows = keyed.join(spans.select(F.col("doc_id").alias(row), F.col("lo").alias(low), F.col("hi").alias(high)), row, "left")
    place = documents.columns.index("text")
    rows = rows.select(*documents.columns, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, stays = [], []
            los, his = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for text, lo, hi in zip(batch.column(place).to_pylist(), los, his, strict=True):
                if lo:
                    text = b" ".join(kept_words(text.encode(), W.union_spans(lo, hi))[1]).decode()
                new.append(text)
                stays.append(not lo or bool(text))
            out = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).set_column(place, "text", pa.array(new, pa.string()))
            yield out.filter(pa.array(stays, pa.bool_()))

    return rows.mapInArrow(run, documents.schema)
