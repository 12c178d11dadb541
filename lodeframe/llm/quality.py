"""Supervised subword embeddings: a quality score for every whole text.

A text becomes hashed tokens: its words, the character 3- to 5-grams of each word between its
boundaries, its word pairs, and a mark for a word that repeats the one before. Every kind of
token is averaged by itself, the learned vectors of all kinds are averaged per document, and a
softmax layer gives the probability of label 1. numpy stochastic gradient descent trains both
layers on at most `SAMPLE` labelled documents (the smallest hashes of doc_id). Because the output
is linear in the averaged vectors, scoring reads one number per bucket and is exact.

Only rows whose crc32 of doc_id as text is no multiple of 5 are learned from; labels, lang,
source and doc_id are no inputs of a score. Defined cases: a null or empty text has no tokens and
gets the score of the bias; documents of conflicting or null labels are not learned from; with
labels of one class or none, every score is the share of label 1 after one half of an example of
each class is added (0.5 without labels). Repeated
or null doc_ids are scored like any row (a null one isn't held out). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodeframe.llm.tables import free_name

#: Documents learned from at most, hash buckets, vector length, passes.
SAMPLE, BUCKETS, WIDTH, EPOCHS = 2000, 1 << 18, 12, 4
#: Starting rates: a token's share of an average is small, so its vector moves faster.
RATE_VECTORS, RATE_OUTPUT, RATE_BIAS = 90.0, 3.0, 0.1
ACCEPT = 0.3
#: Characters that are hashed at once; a longer text is a piece of its own.
PIECE = 1 << 20
KINDS = 4
ODD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def tokens(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, document numbers ascending, buckets) of all tokens of the texts."""
    joined = " " + " ".join(texts) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts])
    gap = (chars <= 32) | (chars == 0xA0) | (chars == 0x3000)
    code = np.where(gap, np.uint32(32), chars).astype(np.uint64)
    document = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    document = np.concatenate([document[:1] if len(document) else np.zeros(1, np.int32), document])[: len(chars)]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    stop = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    # words, by the difference of prefix sums of scrambled (character, place in word)
    length = stop - start
    scrambled = (code * ODD) ^ (code << np.uint64(21))
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    at = np.repeat(start, length) + within
    letters = scrambled[at] * (np.uint64(2) * within.astype(np.uint64) + np.uint64(3)) * ODD
    letters ^= letters >> np.uint64(31)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * ODD)])
    words = total[np.cumsum(length)] - total[np.cumsum(length) - length]
    owner = document[start]
    yield 0, owner, _mixed(words, 1)
    pair = owner[1:] == owner[:-1]
    same = words[1:] == words[:-1]
    yield 1, owner[1:][pair], np.where(same, np.int32(0), _mixed(words[:-1] * STEP + words[1:], 2))[pair]
    # character n-grams: boundaries only at their ends
    walls = np.concatenate([[0], np.cumsum(gap)])
    gram = code.copy()
    for n in (2, 3, 4, 5):
        gram = gram[:-1] * STEP + code[n - 1 :]
        if n > 2:
            first = np.flatnonzero(walls[n - 1 : len(code)][: len(gram)] == walls[1 : len(gram) + 1])
            yield 2 if n == 3 else 3, document[np.minimum(first + 1, len(document) - 1)], _mixed(gram[first], n + 10)


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) so that a piece has about PIECE characters."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text) + 1
    if texts:
        yield first, texts[first:]


def averaged(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Per text, the mean over the kinds it has of its tokens' mean weight."""
    out = np.zeros(len(texts))
    for first, part in pieces(texts):
        total, kinds = np.zeros((KINDS, len(part))), np.zeros((KINDS, len(part)))
        for kind, owner, bucket in tokens(part):
            total[kind] += np.bincount(owner, weights[bucket], len(part))
            kinds[kind] += np.bincount(owner, minlength=len(part))
        there = kinds > 0
        out[first : first + len(part)] = np.where(there, total / np.maximum(kinds, 1), 0).sum(0) / np.maximum(there.sum(0), 1)
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Bucket weights and bias of the log-odds of label 1."""
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return np.zeros(BUCKETS, np.float32), float(np.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5))) if len(labels) else 0.0
    documents = []
    for _, part in pieces(texts):
        found = list(tokens(part))
        counts = np.zeros((KINDS, len(part)))
        for kind, owner, _ in found:
            counts[kind] += np.bincount(owner, minlength=len(part))
        many = np.maximum((counts > 0).sum(0), 1)
        keys, values = [], []
        for kind, owner, bucket in found:
            keys.append(owner.astype(np.int64) * BUCKETS + bucket)
            values.append(1 / (counts[kind][owner] * many[owner]))
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(place, np.concatenate(values)).astype(np.float32)
        cuts = np.searchsorted(unique, np.arange(len(part) + 1) * BUCKETS)
        documents += [((unique[a:b] % BUCKETS).astype(np.int32), weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(documents)):
            bucket, weight = documents[k]
            rate = np.float32(RATE_VECTORS * (1 - done / steps))
            done += 1
            hidden = weight @ vectors[bucket]
            raw = output @ hidden + bias
            soft = np.exp(raw - raw.max())
            slope = soft / soft.sum()
            slope[int(labels[k])] -= 1
            back = slope @ output
            output -= rate / RATE_VECTORS * RATE_OUTPUT * np.outer(slope, hidden)
            bias -= rate / RATE_VECTORS * RATE_BIAS * slope
            if len(bucket):
                vectors[bucket] -= (rate * weight)[:, None] * back
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def _trained(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    weights, bias = train([x or "" for x in table["text"].to_pylist()], table["quality"].to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model: one number per bucket and a bias, learned in one task from `sample` documents at most."""
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id is not null and quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
        .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    # a doc_id that is in documents twice is still one example
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("r")).select("doc_id", "r.text", "r.quality")
    model = rows.groupBy(F.lit(0).alias("one")).applyInArrow(_trained, "weights binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def scored(documents: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """All columns of documents and the probability of label 1, as a column of a name that documents doesn't have."""
    if name.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"documents has a column {name}")
    weights, bias = documents.sparkSession.sparkContext.broadcast(model[0]), model[1]
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = averaged([x or "" for x in batch.column(text).to_pylist()], weights.value)
            score = 1 / (1 + np.exp(-np.clip(values + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def accepted(documents: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """All columns of the documents that the classifier accepts; their own columns, a `score` among them, stay as they are."""
    name = free_name(documents, "score")
    return scored(documents, fit(documents, labels), name).where(F.col(name) >= accept).select(*documents.columns)


def quality(documents: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scored(texts, fit(texts, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
