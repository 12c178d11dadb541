"""SentencePiece encoding and decoding as joins over a relational lattice.

Encoding: blanks become word marks and texts are cut into words wherever no piece of the model holds
the two characters side by side, so no piece crosses a cut. Every distinct word is exploded into its
substrings of at most the longest piece, an equi-join with the piece table keeps those that are
pieces, and the edges are grouped by word and folded by Spark's higher-order `aggregate`.

For a unigram model the fold is Viterbi over the lattice. The installed model is a byte-pair
model, where the best sum of scores is not the right segmentation: there the fold applies the
best-scored merge of two neighbouring symbols until none is left, which gives the library's ids.
Boundaries are bits of one long; words of over `LONGEST` characters go through the same rules in
an Arrow function. Characters without a piece become byte pieces.

Texts are read twice. The first reading counts words; the most frequent, FREQUENT at most, go through
the lattice and are known to every task of the second. There only the words that aren't known move:
they meet by word, distinct ones go through the lattice where they are, and what comes back to a
document is summed. Words meet by 64-bit hashes, so all is exact up to collisions of those.

Defined cases: null and empty texts have no pieces; a word mark in a text counts as a blank (as in
the library); of several rows with one doc_id the one with the smallest text counts; rows without
doc_id are left out; empty tables give no rows; extra columns are ignored; very long texts are cut
piece by piece, and a very long word is folded with a heap.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodeframe.llm.tables import bucketed, parts_for, written
from lodeframe.llm.windows import ODD, OTHER, mix, text_documents

MARK = "▁"
#: Characters of a word that fit the bits of a long; words known to every task (some 20 MB at most).
LONGEST, FREQUENT = 61, 1 << 19
#: Sums over words are kept below this prime; bytes of text to a bucket of unknown words.
PRIME, PART = (1 << 31) - 1, 16 << 20
#: Bytes of text taken at once, distinct words counted at once.
PIECE, FOLD = 1 << 19, 250_000
U = np.uint64
SUMS = ("n_words", "n_pieces", "pieces_sum", "decoded_sum", "n_changed")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The piece table of a model file: as many rows as the vocabulary, whatever the corpus."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.processor = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.unigram = proto.trainer_spec.model_type == 1
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        kinds = [(i, p.piece, float(p.score), p.type) for i, p in enumerate(proto.pieces)]
        self.normal = [(i, piece, score) for i, piece, score, kind in kinds if kind == 1]
        self.bytes = {int(piece[3:5], 16): i for i, piece, _, kind in kinds if kind == 6}
        self.longest = max(len(piece) for _, piece, _ in self.normal)
        if {x for _, piece, _ in self.normal for x in piece} - {piece for _, piece, _ in self.normal}:
            raise ValueError("only models that have every character of their pieces as a piece are supported")

    def ranked(self) -> list[tuple[int, str, float, int]]:
        """id, piece, score and place by descending score."""
        place = {score: k for k, score in enumerate(sorted({score for _, _, score in self.normal}, reverse=True))}
        return [(i, piece, score, place[score]) for i, piece, score in self.normal]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.ranked(), columns=["id", "piece", "score", "rank"]), "id int, piece string, score double, rank int")

    def cuts(self) -> Cuts:
        inside = {a + b for _, piece, _ in self.normal for a, b in zip(piece, piece[1:], strict=False)}
        return Cuts(tuple(sorted(inside)), self.dummy)


class Cuts:
    """Where texts are cut into words, by the pairs of characters that some piece holds."""

    def __init__(self, pairs: tuple[str, ...], dummy: bool):
        self.pairs, self.dummy = pairs, dummy

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kind of every character, which kinds some piece holds side by side, and a hash of every character."""
        letters = {x: k for k, x in enumerate(sorted({x for pair in self.pairs for x in pair}), 1)}
        kind, joined = np.zeros(0x110000, np.uint16), np.zeros((len(letters) + 1,) * 2, bool)
        for x, k in letters.items():
            kind[ord(x)] = k
        for a, b in self.pairs:
            joined[letters[a], letters[b]] = True
        return kind, joined, mix((np.arange(0x110000, dtype=U) + U(1)) * ODD)

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "dummy": self.dummy}

    def words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one string with word marks, and of every word its start, the number of its text, its hash."""
        kind, joined, letter = self.tables
        marked = [(MARK + x if self.dummy and x else x).replace(" ", MARK) for x in texts]
        whole = "".join(marked)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in marked])
        if not len(codes):
            return whole, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        kinds = kind[codes]
        first = np.ones(len(codes), bool)
        first[1:] = ~joined[kinds[:-1], kinds[1:]]
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, len(codes)))
        within = np.arange(len(codes)) - np.repeat(starts, size)
        factors = mix(np.arange(size.max(), dtype=U) + OTHER) | U(1)
        hashed = mix(np.add.reduceat(letter[codes] * factors[within], starts) + size.astype(U))
        return whole, starts, np.searchsorted(np.cumsum(sizes), starts, side="right"), hashed


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """doc_ids and texts, about PIECE bytes at once; only those become Python strings."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        ends = np.cumsum(pa.compute.binary_length(texts).to_numpy().astype(np.int64))
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right")))
            yield ids[a:b], texts.slice(a, b - a).to_pylist()
            a = b


def _distinct(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each is first, and which of them each place has."""
    which, keys = pd.factorize(hashed)
    first = np.empty(len(keys), np.int64)
    first[which[::-1]] = np.arange(len(hashed))[::-1]
    return keys, first, which


def _spelt(whole: str, starts: np.ndarray, at: np.ndarray) -> list[str]:
    ends = np.append(starts[1:], len(whole))
    return [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]


def _counted(batches: Iterator[pa.RecordBatch], cuts: Cuts) -> Iterator[pa.RecordBatch]:
    """key, word, times of words that a task has more than once.

    What was met once since the last fold is forgotten: it can't be frequent, and only speed depends on it.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fold() -> None:
        keys, words, times = (np.concatenate([x[k] for x in held]) for k in range(3))
        keys, at, which = _distinct(keys)
        times = np.bincount(which, times, len(keys)).astype(np.int64)
        held[:] = [(keys[times > 1], words[at][times > 1], times[times > 1])]

    size = 0
    for _, texts in _pieces(batches):
        whole, starts, _, hashed = cuts.words(texts)
        keys, at, which = _distinct(hashed)
        held.append((keys, np.array(_spelt(whole, starts, at), object), np.bincount(which, minlength=len(keys))))
        size += len(keys)
        if size >= FOLD:
            fold()
            size = 0
    if held:
        fold()
        keys, words, times = held[0]
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000].view(np.int64)), pa.array(words[a : a + 50_000], pa.string()), pa.array(times[a : a + 50_000])], names=["key", "word", "times"])


def frequent(texts: DataFrame, model: Model) -> tuple[DataFrame, int]:
    """key, word of the most frequent words, FREQUENT at most, and how many words there are more than once in a task."""
    cuts = model.cuts()
    counted = texts.mapInArrow(lambda b: _counted(b, cuts), "key long, word string, times long").groupBy("key", "word").agg(F.sum("times").alias("times"))
    counted = written(counted.withColumn("level", (F.log2("times") * 16).cast("int")))
    levels = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # 1,000 levels at most
    edge, total = max(levels, default=0) + 1, 0
    while edge - 1 >= min(levels, default=0) and total + levels.get(edge - 1, 0) <= FREQUENT:
        edge, total = edge - 1, total + levels.get(edge - 1, 0)
    return counted.where(F.col("level") >= edge).select("key", "word"), total


def _left(base: Column, by: Column) -> Column:
    return F.call_function("shiftleft", base, by.cast("int"))


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """words (key, word; distinct, of LONGEST characters at most) -> key, spelt (hash of the word), edges.

    An edge is a piece at a place: order (rank * 2^27 + id * 2^6 + start, so that edges sort by score,
    then place) and, as bits, its ends and the places between them. Key and partitioning stay those
    of the words. Substrings meet pieces by hash.
    """
    starts = words.select("key", "word", F.xxhash64("word").alias("spelt"), F.length("word").alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spans = starts.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("s")))))
    order = F.shiftleft(F.col("rank").cast("long"), 27) + F.shiftleft(F.col("id").cast("long"), 6)
    pieces = F.broadcast(model.table(words.sparkSession).select(F.xxhash64("piece").alias("h"), order.alias("order")))  # bounded by the model file
    cut = spans.select("key", "spelt", "s", "l", F.xxhash64(F.substring(F.col("word"), F.col("s") + 1, F.col("l"))).alias("h"))
    low, high = _left(F.lit(1).cast("long"), F.col("s")), _left(F.lit(1).cast("long"), F.col("s") + F.col("l"))
    edge = F.struct((F.col("order") + F.col("s")).alias("order"), (low + high).alias("ends"), (high - low - low).alias("inner"))
    return cut.join(pieces, "h").select("key", "spelt", edge.alias("edge")).groupBy("key", "spelt").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def bound(value: Column, use) -> Column:
    """use(value), the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _size(edges: Column) -> Column:
    """Characters of the word: each has one edge of its own, without a place inside."""
    return F.size(F.filter(edges, lambda e: e["inner"] == 0))


def merge_fold(edges: Column) -> Column:
    """Byte-pair merges: the mask of the boundaries that stay."""

    def step(pair: Column, _: Column) -> Column:
        """The best merge of two neighbours; then only merges whose ends are still boundaries and that aren't done."""
        best = F.get(F.filter(pair["merges"], lambda e: F.bit_count(pair["mask"].bitwiseAND(e["inner"])) == 1), F.lit(0))
        after = pair["mask"].bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("long"))))

        def rest(mask: Column) -> Column:
            open_ = F.filter(pair["merges"], lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (mask.bitwiseAND(e["inner"]) != 0))
            return F.struct(mask.alias("mask"), open_.alias("merges"))

        return bound(after, rest)

    def folded(n: Column) -> Column:
        merges = F.filter(edges, lambda e: e["inner"] != 0)
        full = _left(F.lit(1).cast("long"), n + 1) - 1
        rounds = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, F.struct(full.alias("mask"), merges.alias("merges")), step, lambda p: p["mask"])

    return bound(_size(edges), folded)


def viterbi_fold(edges: Column, scores: list[float]) -> Column:
    """Unigram: over the edges by their ends, the best sum of scores to every place; the mask of the best path's boundaries.

    scores: by rank.
    """
    n, table = _size(edges), F.array(*map(F.lit, scores))
    begin = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.when(k == 0, 0.0).otherwise(-1e300).alias("score"), F.lit(1).cast("long").alias("mask")))

    def opened(e: Column) -> Column:
        start = e["order"].bitwiseAND(63).cast("int")
        return F.struct(start.alias("s"), (start + F.bit_count(e["inner"]) + 1).alias("end"), F.get(table, F.shiftright(e["order"], 27).cast("int")).alias("score"))

    def step(best: Column, e: Column) -> Column:
        origin = F.get(best, e["s"])
        reached = F.struct((origin["score"] + e["score"]).alias("score"), origin["mask"].bitwiseOR(_left(F.lit(1).cast("long"), e["end"])).alias("mask"))
        return bound(reached, lambda r: F.transform(best, lambda x, k: F.when((k == e["end"]) & (r["score"] > x["score"]), r).otherwise(x)))

    return F.aggregate(F.array_sort(F.transform(edges, opened)), begin, step, lambda best: F.get(best, n)["mask"])


def _ids_of(edges: Column, mask: Column) -> Column:
    """Ids of the edges between neighbouring boundaries, by place."""
    stay = F.filter(edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (mask.bitwiseAND(e["inner"]) == 0))
    placed = F.transform(stay, lambda e: F.shiftleft(e["order"].bitwiseAND(63), 21) + F.shiftright(e["order"], 6).bitwiseAND((1 << 21) - 1))
    return F.transform(F.sort_array(placed), lambda x: x.bitwiseAND((1 << 21) - 1).cast("int"))


def merged(edges: list[dict], n: int, unigram: bool, first_byte: int) -> list[int]:
    """The rules of the folds for one word, with a heap: linear-logarithmic in its length."""
    at = {(e["s"], e["l"]): e for e in edges}
    if unigram:
        best = [(0.0, 0)] + [(-np.inf, 0)] * n
        for e in edges:
            total = best[e["s"]][0] + (e["score"] if e["id"] is not None else -1e6)
            if total > best[e["s"] + e["l"]][0]:
                best[e["s"] + e["l"]] = (total, e["s"])
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        cuts.reverse()
    else:
        follows, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(s: int) -> None:
            if s >= 0 and follows[s] < n:
                end = follows[follows[s]]
                e = at.get((s, end - s))
                if e is not None:
                    heapq.heappush(heap, (-e["score"], s, end))

        for s in range(n):
            offer(s)
        while heap:
            _, s, end = heapq.heappop(heap)
            if alive[s] and follows[s] < n and follows[follows[s]] == end:
                gone = follows[s]
                alive[gone], follows[s] = False, end
                if end < n:
                    before[end] = s
                offer(before[s])
                offer(s)
        cuts = [s for s in range(n) if alive[s]] + [n]
    out: list[int] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        e = at[(a, b - a)]
        out += [e["id"]] if e["id"] is not None else [x + first_byte for x in bytes.fromhex(e["raw"])]
    return out


def encoded_words(words: DataFrame, model: Model) -> list[DataFrame]:
    """words (key, word; distinct) -> key, spelt, ids: the words that have a lattice of LONGEST places at most, and the others.

    The others are longer words, and single characters without a piece, which no word holds beside another character.
    """
    unigram, first, longest = model.unigram, model.bytes.get(0, 0), model.longest
    pieces = {piece: (i, score) for i, piece, score in model.normal}

    @F.pandas_udf(ArrayType(IntegerType()))
    def other_ids(words: pd.Series) -> pd.Series:
        def ids(word: str) -> list[int]:
            found = ((s, k, word[s : s + k]) for s in range(len(word)) for k in range(1, min(longest, len(word) - s) + 1))
            none = (None, None)
            edges = [{"s": s, "l": k, "id": pieces.get(x, none)[0], "score": pieces.get(x, none)[1], "raw": x.encode().hex()} for s, k, x in found if k == 1 or x in pieces]
            return merged(edges, len(word), unigram, first)

        return words.map(ids)

    letters = "".join(piece for piece in pieces if len(piece) == 1)
    in_lattice = (F.length("word") <= LONGEST) & ((F.length("word") > 1) | (F.instr(F.lit(letters), F.col("word")) > 0))
    scores = sorted({score for _, _, score in model.normal}, reverse=True) if unigram else []

    def ids_of(found: Column) -> Column:
        return bound(viterbi_fold(found, scores) if unigram else merge_fold(found), lambda mask: _ids_of(found, mask))

    short = lattice(words.where(in_lattice), model).select("key", "spelt", bound(F.col("edges"), ids_of).alias("ids"))
    return [short, words.where(~in_lattice).select("key", F.xxhash64("word").alias("spelt"), other_ids("word").alias("ids"))]


def _raw(model: Model) -> list[tuple[int, str]]:
    """id and bytes, in hex, of every piece."""
    return [(i, piece.encode().hex()) for i, piece, _ in model.normal] + [(i, f"{b:02x}") for b, i in model.bytes.items()]


def checked(made: DataFrame, model: Model) -> DataFrame:
    """made (key, spelt, ids) -> key, ids, n, pieces (checksum of the ids), back (checksum of what they decode to), changed (whether that differs).

    Here the piece table is one constant array: the words are already where they are needed.
    """
    raw = dict(_raw(model))
    table = F.split(F.lit(",".join(raw.get(i, "") for i in range(max(raw) + 1))), ",")
    text = F.xxhash64(F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get(table, i)), "")), "UTF-8"))
    check = lambda c: F.pmod(c, F.lit(PRIME))
    back = made.select("key", "spelt", "ids", text.alias("text"))
    return back.select("key", "ids", F.size("ids").cast("long").alias("n"), check(F.xxhash64("ids")).alias("pieces"), check(F.col("text")).alias("back"), (F.col("text") != F.col("spelt")).cast("long").alias("changed"))


class Known:
    """The frequent words' ids and checksums, sorted by key: bounded by FREQUENT."""

    def __init__(self, table: pa.Table):
        keys = table["key"].to_numpy().view(U)
        order = np.argsort(keys)
        ids = table["ids"].combine_chunks().take(pa.array(order))
        self.keys, self.ids = keys[order], ids.flatten().to_numpy().astype(np.int32)
        self.starts = np.append(0, np.cumsum(ids.value_lengths().to_numpy())).astype(np.int32)
        self.pieces, self.back, self.changed = (table[c].to_numpy()[order].astype(np.int32) for c in ("pieces", "back", "changed"))

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the known words, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        keys, _, which = _distinct(hashed)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at[which], (self.keys[at] == keys)[which]


def weights(place: np.ndarray) -> np.ndarray:
    """What the word at a place of its document weighs in the sums."""
    return (mix(place.astype(U) + ODD) % U(PRIME)).astype(np.int64)


ROW = pa.schema([("key", pa.int64()), ("word", pa.string()), ("doc", pa.int64()), ("weight", pa.int64()), *((c, pa.int64()) for c in SUMS)])
ROW_SQL = "key long, word string, doc long, weight long, " + ", ".join(f"{c} long" for c in SUMS)
PLACE = pa.schema([("key", pa.int64()), ("word", pa.string()), ("doc", pa.int64()), ("pos", pa.int64()), ("ids", pa.list_(pa.int32()))])
PLACE_SQL = "key long, word string, doc long, pos long, ids array<int>"


def _summed(batches: Iterator[pa.RecordBatch], cuts: Cuts, known: Known) -> Iterator[pa.RecordBatch]:
    """A row for every document with the sums of its known words (word null), and one for each of its unknown words."""
    for ids, texts in _pieces(batches):
        whole, starts, of, hashed = cuts.words(texts)
        at, hit = known.find(hashed)
        place = np.arange(len(of)) - np.searchsorted(of, of)
        weight = weights(place)
        per = lambda x: np.bincount(of[hit], x, len(ids)).astype(np.int64)

        def residue(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(ids), np.int64)
            np.add.at(out, of[hit], weight[hit] * x[at[hit]].astype(np.int64) % PRIME)
            return out % PRIME

        if len(known.keys):
            sums = [per(np.diff(known.starts)[at[hit]]), residue(known.pieces), residue(known.back), per(known.changed[at[hit]])]
        else:
            sums = [np.zeros(len(ids), np.int64)] * 4
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(mix(ids.astype(U)).view(np.int64)), pa.nulls(n, pa.string()), pa.array(ids), pa.nulls(n, pa.int64()), *(pa.array(x) for x in (np.bincount(of, minlength=n), *sums))], schema=ROW)
        miss = np.flatnonzero(~hit)
        if not len(miss):
            continue
        miss = miss[np.lexsort((hashed[miss], of[miss]))]
        new = np.append(True, (hashed[miss][1:] != hashed[miss][:-1]) | (of[miss][1:] != of[miss][:-1]))
        lead, times = miss[new], np.diff(np.append(np.flatnonzero(new), len(miss)))
        total = np.add.reduceat(weight[miss], np.flatnonzero(new)) % PRIME
        none = pa.nulls(len(lead), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(hashed[lead].view(np.int64)), pa.array(_spelt(whole, starts, lead), pa.string()), pa.array(ids[of[lead]]), pa.array(total), pa.array(times.astype(np.int64)), none, none, none, none], schema=ROW)


def _placed(batches: Iterator[pa.RecordBatch], cuts: Cuts, known: Known) -> Iterator[pa.RecordBatch]:
    """Runs of known words with their ids (word null), and every unknown word, in place."""
    for ids, texts in _pieces(batches):
        whole, starts, of, hashed = cuts.words(texts)
        if not len(of):
            continue
        at, hit = known.find(hashed)
        place = np.arange(len(of)) - np.searchsorted(of, of)
        miss = np.flatnonzero(~hit)
        yield pa.RecordBatch.from_arrays([pa.array(hashed[miss].view(np.int64)), pa.array(_spelt(whole, starts, miss), pa.string()), pa.array(ids[of[miss]]), pa.array(place[miss]), pa.nulls(len(miss), PLACE.field("ids").type)], schema=PLACE)
        runs = np.flatnonzero(hit & np.append(True, (of[1:] != of[:-1]) | ~hit[:-1]))
        if not len(runs):
            continue
        found = [known.ids[known.starts[k] : known.starts[k + 1]] for k in at[hit].tolist()]
        size = np.zeros(len(of), np.int64)
        size[hit] = [len(x) for x in found]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(size, runs))), pa.int32()), pa.array(np.concatenate(found)))
        yield pa.RecordBatch.from_arrays([pa.array(hashed[runs].view(np.int64)), pa.nulls(len(runs), pa.string()), pa.array(ids[of[runs]]), pa.array(place[runs]), lists], schema=PLACE)


def _scattered(texts: DataFrame, model: Model, rows_of, schema: str) -> DataFrame:
    """Rows of the second reading, in buckets by key."""
    often, total = frequent(texts, model)
    spark, cuts = texts.sparkSession, model.cuts()
    short, other = encoded_words(often.repartition("key"), model)
    known = spark.sparkContext.broadcast(Known(checked(short.unionByName(other), model).toArrow()))
    parts = parts_for(spark, texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], PART)
    return bucketed(texts.mapInArrow(lambda b: rows_of(b, cuts, known.value), schema), "key", parts)


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """documents (doc_id, text) -> doc_id, pos, ids: the pieces of words in place, neighbouring frequent words in one row."""
    model = Model(path or default_model())
    rows = _scattered(text_documents(documents), model, _placed, PLACE_SQL)
    unknown = rows.where("word is not null")
    found = rows.where("word is null").select("doc", "pos", "ids")
    for made in encoded_words(unknown.select("key", "word").distinct(), model):  # joined one by one: a union would have to be dealt again
        found = found.unionByName(unknown.select("key", "doc", "pos").join(made.select("key", "ids"), "key").select("doc", "pos", "ids"))
    return found.withColumnRenamed("doc", "doc_id")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_pieces, pieces_sum, decoded_sum, decoded_equal: encoding and decoding every word.

    The sums add, over the words of a document, the weight of the word's place times a checksum of its
    ids, and of the text that these decode to, modulo PRIME; decoded_equal says that all words come back.
    """
    model = Model(path or default_model())
    rows = _scattered(text_documents(documents), model, _summed, ROW_SQL)
    unknown = rows.where("word is not null").select("key", "word", "doc", "weight", F.col("n_words").alias("times"))
    weighed = lambda c: F.pmod(F.col("weight") * F.col(c), F.lit(PRIME))
    both = rows.where("word is null").select("doc", *SUMS)
    for made in encoded_words(unknown.select("key", "word").distinct(), model):  # joined one by one: a union would have to be dealt again
        there = unknown.drop("word").join(checked(made, model), "key")
        sums = (F.lit(0).cast("long"), F.col("times") * F.col("n"), weighed("pieces"), weighed("back"), F.col("times") * F.col("changed"))
        both = both.unionByName(there.select("doc", *(x.alias(c) for x, c in zip(sums, SUMS, strict=True))))
    total = both.groupBy(F.col("doc").alias("doc_id")).agg(*(F.sum(c).alias(c) for c in SUMS))
    return total.select("doc_id", "n_words", "n_pieces", *(F.pmod(c, F.lit(PRIME)).alias(c) for c in ("pieces_sum", "decoded_sum")), (F.col("n_changed") == 0).alias("decoded_equal"))


def sequences(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: whole texts as one array of piece ids."""
    rows = encoded(documents, path).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("w"))
    made = rows.select("doc_id", F.flatten(F.col("w.ids")).alias("ids"))
    return text_documents(documents).select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (doc_id, ids) -> doc_id, text: an equi-join of the ids with the piece table, bytes put back together."""
    model = Model(path or default_model())
    pieces = F.broadcast(rows.sparkSession.createDataFrame(_raw(model), "id int, raw string"))
    exploded = rows.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    joined = exploded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("w"))
    text = F.replace(F.decode(F.unhex(F.array_join(F.col("w.raw"), "")), "UTF-8"), F.lit(MARK), F.lit(" "))
    text = F.regexp_replace(text, "^ ", "") if model.dummy else text
    made = joined.select("doc_id", text.alias("text"))
    return rows.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
