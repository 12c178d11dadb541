"""Languages of the spans of mixed-language texts.

A text is read as words (runs of letters and marks of one script). The script of a word narrows its
candidates to the languages that are written in it; character n-grams of 1 to 4 letters, boundaries
included, give each candidate a score. Viterbi's path over the words, with a penalty for every
switch, labels them, so that a borrowed word doesn't end a span but a passage does. A text whose
best single language can't be improved by any excursion (the largest sum of a run of words' gains
stays below the penalty) is labelled at once; that is exact, and only mixed texts are walked.

The model is counted by Spark from about SAMPLE documents of each language (all, if fewer; the
smallest hashes of doc_id), only from rows whose crc32 of doc_id as text isn't 2 modulo 4. Text is
the only input of a prediction.

Defined cases: a null text, or one without any letter, is `und` with score 0, as is every text if
no language was learned; words of a script that no learned language uses fit every language alike;
equal sums go to the language that comes first by name; rows with a null doc_id or lang are not
learned from (a null doc_id isn't held out); repeated rows are predicted each; texts are read
whole, in pieces of PIECE characters that end between words (a longer word is cut in two).
Empty tables give no rows. Other columns are kept by `labelled` and ignored by the query.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Documents of each language that are learned from, on average at most.
SAMPLE = 1000
#: n-gram lengths, hash buckets of each, strength of what all languages share, weight of a word's score.
LENGTHS, BUCKETS, SHARED, TEMPER = (1, 2, 3, 4), 1 << 16, 0.02, 0.3
#: Cost of a switch and the most that one word tells, in natural logarithms; share of its letters from which a language uses a script.
SWITCH, WORD_TELLS, USES = 9.0, 6.0, 0.01
#: Characters read at once; letters of a word in scripts without spaces.
PIECE, UNSPACED_WORD = 1 << 20, 4
#: Characters of the texts whose words are held at once (a longer text by itself).
HELD = 1 << 22
#: Score of a language that isn't written in the word's script.
NARROWED = -1e4
UND = "und"

#: Scripts and their ranges in Unicode.
RANGES = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA787), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))),
    ("Greek", ((0x370, 0x3E1), (0x3F0, 0x3FF), (0x1F00, 0x1FFE))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x531, 0x588),)),
    ("Hebrew", ((0x591, 0x5F4), (0xFB1D, 0xFB4F))),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Gurmukhi", ((0xA00, 0xA7F),)),
    ("Gujarati", ((0xA80, 0xAFF),)),
    ("Oriya", ((0xB00, 0xB7F),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Telugu", ((0xC00, 0xC7F),)),
    ("Kannada", ((0xC80, 0xCFF),)),
    ("Malayalam", ((0xD00, 0xD7F),)),
    ("Sinhala", ((0xD80, 0xDFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Lao", ((0xE80, 0xEFF),)),
    ("Tibetan", ((0xF00, 0xFFF),)),
    ("Myanmar", ((0x1000, 0x109F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("Hangul", ((0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97C), (0xAC00, 0xD7FB))),
    ("Ethiopic", ((0x1200, 0x139F),)),
    ("Khmer", ((0x1780, 0x17FF),)),
    ("Mongolian", ((0x1800, 0x18AA),)),
    ("Hiragana", ((0x3041, 0x309F),)),
    ("Katakana", ((0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))),
    ("Han", ((0x2E80, 0x2FD5), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
SCRIPTS = ("other", *(name for name, _ in RANGES))
UNSPACED = tuple(SCRIPTS.index(x) for x in ("Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Hiragana", "Katakana", "Han"))
ODD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for a letter and 1 for a mark, the script, the lower-case code point; beyond the last range nothing is a letter."""
    last = 0x32400
    kinds = [unicodedata.category(chr(c))[0] for c in range(last)]
    kind = np.array([2 if x == "L" else x == "M" for x in kinds], np.int8)
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(last)], np.uint32)
    script = np.zeros(last, np.int16)
    for number, (_, ranges) in enumerate(RANGES, 1):
        for low, high in ranges:
            script[low : high + 1] = number
    return kind, script, lower


@dataclass
class Words:
    """Words of some texts, in order: text number, start and end there, letters, script; and their padded letters."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    codes: np.ndarray
    word: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, word) of the n-grams; a word's letters stand between two boundaries, which are no 1-grams."""
        if len(self.codes) < n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        gram = self.codes[: len(self.codes) - n + 1].copy()
        for k in range(1, n):
            gram = gram * STEP + self.codes[k : len(self.codes) - n + 1 + k]
        inside = self.word[n - 1 :] == self.word[: len(gram)] if n > 1 else self.codes != 32
        gram = (gram[inside] + np.uint64(n)) * ODD
        gram ^= gram >> np.uint64(32)
        return ((gram * ODD) >> np.uint64(48)).astype(np.int32), self.word[: len(inside)][inside]


def words(texts: list[str]) -> Words:
    kind_of, script_of, lower_of = _tables()
    chars = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts])
    known = np.minimum(chars, len(kind_of) - 1)
    kind = np.where(chars < len(kind_of), kind_of[known], 0)
    inside = kind > 0
    # a mark has the script of what it stands on
    at = np.maximum.accumulate(np.where(kind == 1, 0, np.arange(len(chars))))
    script = script_of[known][at]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (script[1:] != script[:-1])
    if np.isin(script[inside], UNSPACED).any():
        begun = np.maximum.accumulate(np.where(first, np.arange(len(chars)), 0))
        first |= inside & np.isin(script, UNSPACED) & ((np.arange(len(chars)) - begun) % UNSPACED_WORD == 0)
    start = np.flatnonzero(first)
    length = np.diff(np.append(np.cumsum(inside)[start] - 1, inside.sum()))
    letters = np.diff(np.append(0, np.cumsum(kind == 2))[np.stack([start, start + length], 1)], axis=1).ravel() if len(start) else np.zeros(0, np.int64)
    start, length, letters = start[letters > 0], length[letters > 0], letters[letters > 0]
    padded = length + 2
    begin = np.cumsum(padded) - padded
    codes = np.full(padded.sum(), 32, np.uint64)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    codes[np.repeat(begin + 1, length) + within] = lower_of[np.minimum(chars[np.repeat(start, length) + within], len(lower_of) - 1)]
    text = np.searchsorted(ends, start, side="right")
    base = np.append(0, ends)[text]
    return Words(text, start - base, start - base + length, letters, script[start], codes, np.repeat(np.arange(len(start)), padded))


def pieces(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """(text number, offset, piece) in lists of about PIECE characters; long texts are cut after a space, if there is one."""
    held: list[tuple[int, int, str]] = []
    size = 0
    for number, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > PIECE:
                end = at + PIECE
                space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                end = space + 1 if space > at else end
            if held and size + end - at > PIECE:
                yield held
                held, size = [], 0
            held.append((number, at, text[at:end]))
            size += end - at + 1
            at = end
            if at >= len(text):
                break
    if held:
        yield held


@dataclass
class Model:
    """Languages by name, weights of the n-grams of each length (language, bucket), and who uses which script."""

    languages: list[str]
    weights: list[np.ndarray]
    uses: np.ndarray

    def scores(self, found: Words) -> np.ndarray:
        """(word, language): scores of the candidates, centred on their best."""
        out = np.zeros((len(found.text), len(self.languages)))
        for script in np.unique(found.script):
            able = np.flatnonzero(self.uses[script])
            mine = found.script == script
            if not len(able):
                continue
            total = np.zeros((len(found.text), len(able)))
            for n, weights in zip(LENGTHS, self.weights, strict=True):
                bucket, word = found.grams(n)
                if not mine.all():
                    bucket, word = bucket[mine[word]], word[mine[word]]
                if len(word):
                    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                    for k, language in enumerate(able):
                        total[word[heads], k] += np.add.reduceat(weights[language][bucket], heads)
            part = np.full((int(mine.sum()), len(self.languages)), NARROWED)
            part[:, able] = np.maximum((total - total.max(axis=1, keepdims=True))[mine] * TEMPER, -WORD_TELLS)
            out[mine] = part
        return out


def excursion(score: np.ndarray, single: int) -> float:
    """The most that a run of words can gain by leaving the language `single`."""
    gain = np.delete(score, single, axis=1).max(axis=1) - score[:, single] if score.shape[1] > 1 else np.zeros(len(score))
    total = np.append(0.0, np.cumsum(gain))
    return float((total - np.minimum.accumulate(total)).max())


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Labels of the words of each text (n words x languages) along the path of the largest sum less the switches' penalties."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    walked = []
    for k, score in enumerate(scores):
        if not len(score):
            continue
        single = int(score.sum(axis=0).argmax())
        if excursion(score, single) < switch:
            out[k] = np.full(len(score), single)
        else:
            walked.append(k)
    walked.sort(key=lambda k: -len(scores[k]))
    if not walked:
        return out
    size = np.array([len(scores[k]) for k in walked])
    first = np.cumsum(size) - size
    flat = np.concatenate([scores[k] for k in walked])
    back = np.zeros(flat.shape, np.int16)
    own = np.arange(flat.shape[1])
    best = flat[first]
    for t in range(1, size[0]):
        on = int((size > t).sum())
        before = best[:on]
        jump = before.max(axis=1, keepdims=True) - switch
        stay = before >= jump
        back[first[:on] + t] = np.where(stay, own, before.argmax(axis=1)[:, None])
        best[:on] = np.where(stay, before, jump) + flat[first[:on] + t]
    label = best.argmax(axis=1)
    labels = np.zeros(len(flat), np.int64)
    for t in range(size[0] - 1, -1, -1):
        on = int((size > t).sum())
        labels[first[:on] + t] = label[:on]
        label[:on] = back[first[:on] + t, label[:on]]
    for k, a, n in zip(walked, first, size, strict=True):
        out[k] = labels[a : a + n]
    return out


def _spans(score: np.ndarray, label: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, label, confidence, letters) of the runs of one label; confidence: the label's probability, were the span of one language."""
    heads = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    total = np.add.reduceat(score, heads, axis=0)
    which = label[heads]
    with np.errstate(over="ignore"):
        sure = 1 / np.exp(total - total[np.arange(len(heads)), which][:, None]).sum(axis=1)
    return start[heads], np.append(end[heads[1:] - 1], end[-1]), which, sure, np.add.reduceat(letters, heads)


def read_texts(texts: list[str], model: Model, switch: float = SWITCH) -> list[tuple[list[dict], str, float]]:
    """Spans, language and score of each text."""
    held: list[list[tuple]] = [[] for _ in texts]
    out: list[tuple[list[dict], str, float]] = [([], UND, 0.0)] * len(texts)
    if not model.languages:
        return out
    for part in pieces(texts):
        found = words([x for _, _, x in part])
        score = model.scores(found)
        cuts = np.searchsorted(found.text, np.arange(len(part) + 1))
        for (number, offset, _), a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                held[number].append((score[a:b], found.start[a:b] + offset, found.end[a:b] + offset, found.letters[a:b]))
    joined = [tuple(np.concatenate(x) for x in zip(*one, strict=True)) if one else None for one in held]
    labels = viterbi([x[0] if x else np.zeros((0, 1)) for x in joined], switch)
    for k, one in enumerate(joined):
        if one is None:
            continue
        start, end, which, sure, letters = _spans(one[0], labels[k], one[1], one[2], one[3])
        share = np.bincount(which, letters * sure, len(model.languages)) / letters.sum()
        best = int(share.argmax())
        spans = [{"start": int(a), "end": int(b), "lang": model.languages[w], "confidence": float(s)} for a, b, w, s in zip(start, end, which, sure, strict=True)]
        out[k] = spans, model.languages[best], min(1.0, float(share[best]))
    return out


def portions(texts: list[str], most: int = HELD) -> Iterator[list[str]]:
    """The texts in turn, as many at once as have about that many characters."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > most:
            yield texts[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield texts[first:]


def counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, buckets, counts) of the n-grams, and with n = 0 the letters by script."""
    for part in pieces(texts):
        found = words([x for _, _, x in part])
        yield 0, np.arange(len(SCRIPTS)), np.bincount(found.script, found.letters, len(SCRIPTS)).astype(np.int64)
        for n in LENGTHS:
            yield n, *np.unique(found.grams(n)[0], return_counts=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for n, bucket, count in counted(texts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(bucket), pa.string()), pa.array(np.full(len(bucket), n, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int64))],
                    names=["lang", "n", "bucket", "count"],
                )


def model_of(rows: pa.Table) -> Model:
    """The model of counts (lang, n, bucket, count)."""
    languages = sorted(set(rows["lang"].to_pylist()))
    lang = np.searchsorted(np.array(languages, object), np.array(rows["lang"].to_pylist(), object)) if languages else np.zeros(0, np.int64)
    n, bucket, count = (rows[x].to_numpy() for x in ("n", "bucket", "count"))

    def table(length: int, size: int) -> np.ndarray:
        out = np.zeros((size, len(languages)))
        np.add.at(out, (bucket[n == length], lang[n == length]), count[n == length])
        return out

    letters = table(0, len(SCRIPTS))
    weights = []
    for length in LENGTHS:
        share = table(length, BUCKETS)
        share /= np.maximum(share.sum(axis=0), 1)
        # what a language lacks has a part of the mean share, and what all lack tells nothing
        weights.append(np.log((share + SHARED * share.mean(axis=1, keepdims=True) + 1e-12) / (1 + SHARED)).astype(np.float32).T.copy())
    return Model(languages, weights, letters >= np.maximum(USES * letters.sum(axis=0), 1))


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """documents (doc_id, text, lang) -> the model of the rows that may be learned from."""
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(may & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], [np.zeros((0, BUCKETS), np.float32)] * len(LENGTHS), np.zeros((len(SCRIPTS), 0), bool))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, math.ceil(min(1.0, sample / n) * (1 << 40)))))
    picked = rows.where((drawn < F.element_at(shares, F.col("lang"))) & F.col("text").isNotNull()).select("lang", "text")
    counts = picked.mapInArrow(_counts, "lang string, n int, bucket int, count long").groupBy("lang", "n", "bucket").agg(F.sum("count").alias("count"))
    return model_of(counts.toArrow())  # at most one row for each bucket of each language


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType()), StructField("confidence", DoubleType())]))


def labelled(documents: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """All columns of documents with spans (code points, end exclusive), lang_pred and score."""
    taken = {"spans", "lang_pred", "score"} & {c.lower() for c in documents.columns}
    if taken:
        raise ValueError(f"documents has columns {sorted(taken)}")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found = [one for part in portions(texts) for one in read_texts(part, shared.value, switch)]
            more = [pa.array([x[0] for x in found], spans), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "spans", "lang_pred", "score"])

    fields = [*documents.schema.fields, StructField("spans", SPANS), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return documents.mapInArrow(run, StructType(fields))


def language_id(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return labelled(texts, fit(documents)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
