"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles; two texts link if the Jaccard similarity of their sets is
at least the threshold. Texts of equal sets form a class and are represented by their smallest
doc_id. Every representative enters `TREES` prefix tries with as many minima (one-permutation
hashing; an empty bin borrows from the first filled one in an order of its own, so that the tries
of texts with few shingles stay independent). Sorting a trie puts sharers of the longest prefixes
next to each other. A text matches at the deepest level first; its prefix is shortened until the
expected recall of the least similar link that a text of its size can have reaches the target (the
similarity of small sets takes few values: a text of six shingles has none between 5/6 and the
threshold). Two texts are candidates if they share the longer prefix that either of them still needs. Neighbours are joined instead of all
pairs of a prefix. All representatives that hang together are then compared exactly, in tiles, with
their whole shingle sets; no candidate is capped. Sets are compared by 64-bit hashes of shingles and equal
sets by 128 bits: results are exact up to collisions of those.

Defined cases: words are runs of non-blanks; a text of one to four words is one shingle of them
all; a null, empty or blank text has no shingles and links with nothing; of several rows with one
doc_id the one with the smallest text counts; rows without doc_id are left out; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import windows as W
from lodeframe.llm.components import chains, connected_components, forest
from lodeframe.llm.phrase_dedup import text_pieces, word_hashes
from lodeframe.llm.tables import free_name, parts_for, written

THRESHOLD, SHINGLE = 0.8, 5
TREES, DEEPEST, RECALL = 32, 8, 0.999
BINS = TREES * DEEPEST
#: Texts in a tile; components up to this size share a task by about as many texts.
TILE = 384
U = np.uint64
#: For each bin, all bins in an order of its own.
LENDERS = np.argsort(W.mix(np.arange(1, BINS * BINS + 1, dtype=U) * W.ODD).reshape(BINS, BINS), axis=1)


def depth_for(threshold: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The deepest prefix whose expected recall at the threshold reaches the target."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, ascending within each, and the text of each."""
    symbols, counts = word_hashes(texts)
    if not len(symbols):
        return np.zeros(0, U), np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = W.hashes(symbols, SHINGLE)
    fits = np.arange(len(symbols)) + SHINGLE <= ends[owner]
    value, of = W.mix(whole[fits]), owner[fits]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        folded = np.zeros(len(short), U)
        for k in range(SHINGLE - 1):
            more = counts[short] > k
            folded[more] = W.mix(folded[more] * W.OTHER + symbols[(ends[short] - counts[short] + k)[more]])
        value, of = np.concatenate([value, folded]), np.concatenate([of, short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))
    return value[new], of[new]


def least_similarity(size: int, threshold: float) -> float:
    """The least similarity, at or above the threshold, that a set of `size` can have with another set."""
    best = 1.0
    for shared in range(size, max(0, int(threshold * size) - 1), -1):
        union = int(shared / threshold + 1e-9)
        if union >= size:
            best = min(best, shared / union)
    return best


@functools.lru_cache(4)
def depths_by_size(threshold: float, recall: float) -> np.ndarray:
    """How deep a prefix a text may keep, by its number of shingles; sizes beyond the table need the depth of the threshold."""
    return np.array([DEEPEST] + [depth_for(least_similarity(n, threshold), recall) for n in range(1, 64)] + [depth_for(threshold, recall)])


def minima(value: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text with shingles (its numbers): fingerprints of its set, how many shingles, minima by bin."""
    there = np.unique(of)
    if not len(there):
        return there, np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, BINS), U)
    starts = np.searchsorted(of, there)
    prints = np.stack([np.add.reduceat(W.mix(value * f + f), starts) for f in (W.ODD, W.OTHER)], axis=1)
    row = np.searchsorted(there, of)
    bucket = (value >> U(56)).astype(np.int64)
    first = np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))
    low = np.zeros((len(there), BINS), U)
    low[row[first], bucket[first]] = value[first]
    filled = np.zeros((len(there), BINS), bool)
    filled[row[first], bucket[first]] = True
    text, gap = np.nonzero(~filled)
    for turn in range(BINS):
        if not len(text):
            break
        lender = LENDERS[gap, turn]
        lent = filled[text, lender]
        low[text[lent], gap[lent]] = low[text[lent], lender[lent]]  # only gaps are written, only filled bins read
        text, gap = text[~lent], gap[~lent]
    return there, prints.view(np.int64), np.diff(np.append(starts, len(of))), low


def prefixes(low: np.ndarray, depth: int) -> np.ndarray:
    """A key for the prefix of `depth` minima in every trie."""
    keys = np.broadcast_to(W.mix(np.arange(1, TREES + 1, dtype=U)), (len(low), TREES)).copy()
    for level in range(depth):
        keys = W.mix(keys * W.OTHER + low[:, level * TREES : (level + 1) * TREES])
    return keys.view(np.int64)


def signatures(value: np.ndarray, of: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text with shingles (its numbers, fingerprints of its set, and prefix keys by trie)."""
    there, prints, _, low = minima(value, of, n)
    return there, prints, prefixes(low, depth)


def _signed(batches: Iterator[pa.RecordBatch], threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    """doc, fingerprints, whether its prefix is shortened, and the shortest and the whole prefix in every trie."""
    shortest, depths = depth_for(threshold, recall), depths_by_size(threshold, recall)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for rows, texts in text_pieces(ids, batch.column(1).cast(pa.binary()).to_pylist()):
            value, of = shingle_sets(texts)
            there, prints, sizes, low = minima(value, of, len(texts))
            short = depths[np.minimum(sizes, len(depths) - 1)] < DEEPEST
            keys = np.stack([prefixes(low, shortest), prefixes(low, DEEPEST)], axis=2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows[there]]), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(short), pa.array([k.tobytes() for k in keys], pa.binary())],
                names=["doc", "f", "g", "short", "keys"],
            )


EDGE = pa.schema([("key", pa.int64()), ("deep", pa.int64()), ("short", pa.bool_()), ("doc", pa.int64()), ("other", pa.int64())])
EDGE_SQL = "key long, deep long, short boolean, doc long, other long"


def neighbours(key: np.ndarray, deep: np.ndarray, short: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In trie order: the first of each node, whether the node is short, and a forest over the documents of a node as id, id before.

    A node is a whole prefix, or the shortest one where some text under it was shortened to that.
    """
    order = np.lexsort((doc, deep, key))
    key, deep, short, doc = key[order], deep[order], short[order], doc[order]
    if not len(key):
        return order, short, doc, doc
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    any_short = np.repeat(np.logical_or.reduceat(short, starts), np.diff(np.append(starts, len(key))))
    same = (key[1:] == key[:-1]) & (any_short[1:] | (deep[1:] == deep[:-1]))
    ids, index = np.unique(doc, return_inverse=True)
    label = forest(index[1:][same], index[:-1][same], len(ids))
    later, before = chains(label, ids, np.ones(len(ids), bool))
    first = np.append(True, ~same)
    return order[first], any_short[first], later, before


def _local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)  # one of the partitions of the representatives
    if not sum(map(len, held)):
        return
    table = pa.Table.from_batches(held)
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64).reshape(-1, 2)
    doc, short = (np.repeat(table[c].to_numpy(), TREES) for c in ("doc", "short"))
    first, node, later, before = neighbours(keys[:, 0], keys[:, 1], short, doc)
    yield pa.RecordBatch.from_arrays([pa.array(keys[first, 0]), pa.array(keys[first, 1]), pa.array(node), pa.array(doc[first]), pa.nulls(len(first), pa.int64())], schema=EDGE)
    none = pa.nulls(len(later), pa.int64()), pa.nulls(len(later), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(W.mix(later.astype(U)).view(np.int64)), *none, pa.array(later), pa.array(before)], schema=EDGE)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), EDGE)  # one of the partitions that the shuffle made
    done = table.filter(pa.compute.is_valid(table["other"]))
    rest = table.filter(pa.compute.is_null(table["other"]))
    _, _, later, before = neighbours(*(rest[c].to_numpy() for c in ("key", "deep", "short", "doc")))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([done["doc"].to_numpy(), later])), pa.array(np.concatenate([done["other"].to_numpy(), before]))], names=["src", "dst"])


def candidate_groups(reps: DataFrame, parts: int) -> DataFrame:
    """reps (doc, short, keys) -> id, component: representatives that hang together by shared prefixes."""
    met = reps.mapInArrow(_local_links, EDGE_SQL).repartition(parts, "key").mapInArrow(_met, "src long, dst long")
    return connected_components(met)


def verified(value: np.ndarray, of: np.ndarray, group: np.ndarray, side: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of one group (cross: of different sides) whose sets reach the threshold."""
    sizes = np.bincount(of, minlength=len(group))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    bounds = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, np.int64)
    cuts = np.searchsorted(of, bounds)
    for a, b, low, high in zip(bounds[:-1], bounds[1:], cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        if b - a == 2:
            shared = len(np.intersect1d(value[low : low + sizes[a]], value[low + sizes[a] : high], assume_unique=True))
            common = np.array([[0, shared], [0, 0]])
        else:
            names, code = np.unique(value[low:high], return_inverse=True)
            many = np.bincount(code) > 1
            code, row = (np.cumsum(many) - 1)[code], of[low:high] - a
            row, code = row[many[np.searchsorted(names, value[low:high])]], code[many[np.searchsorted(names, value[low:high])]]
            common = np.zeros((b - a, b - a), np.float32)
            width = 4096
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            for start in range(0, int(many.sum()), width):
                x, y = np.searchsorted(code, (start, start + width))
                table = np.zeros((b - a, min(width, int(many.sum()) - start)), np.float32)
                table[row[x:y], code[x:y] - start] = 1
                common += table @ table.T
        total = sizes[a:b][:, None] + sizes[a:b][None, :] - common
        hit = np.triu(common >= threshold * total - 1e-9, 1) & (common > 0)
        if cross:
            hit &= side[a:b][:, None] != side[a:b][None, :]
        i, j = np.nonzero(hit)
        out.append((i + a, j + a))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _compared(threshold: float):
    out = pa.schema([("doc", pa.int64()), ("links", pa.int64()), ("before", pa.int64())])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("doc", "ascending")])
        docs, copies = table["doc"].to_numpy(), table["copies"].to_numpy()
        value, of = shingle_sets(table["text"].cast(pa.binary()).to_pylist())
        i, j = verified(value, of, table["component"].to_numpy(), table["side"].to_numpy(), key[1].as_py() != key[2].as_py(), threshold)
        links = np.bincount(i, copies[j], len(docs)) + np.bincount(j, copies[i], len(docs))
        later, before = chains(forest(i, j, len(docs)), docs, links > 0)
        known = dict(zip(later.tolist(), before.tolist(), strict=True))
        hit = links > 0
        return pa.table([pa.array(docs[hit]), pa.array(links[hit].astype(np.int64)), pa.array([known.get(x) for x in docs[hit].tolist()], pa.int64())], schema=out)

    return compare


def jaccard_links(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_links (other documents at or above the threshold), component_id, kept."""
    return linked(W.text_documents(documents), threshold, recall, tile)


def linked(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """jaccard_links of texts (doc_id, text) whose doc_ids are unique."""
    spark = texts.sparkSession
    signed = written(texts.mapInArrow(lambda b: _signed(b, threshold, recall), "doc long, f long, g long, short boolean, keys binary"))
    classes = written(signed.groupBy("f", "g").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("short").alias("short"), F.min_by("keys", "doc").alias("keys")))
    groups = candidate_groups(classes.select(F.col("rep").alias("doc"), "short", "keys"), parts_for(spark, signed.count() * TREES, 400_000))
    placed = written(
        groups.join(classes.select(F.col("rep").alias("id"), "copies"), "id").withColumnRenamed("id", "doc_id")
    )
    tiles = placed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.count(F.lit(1)).alias("members"))
    units = max(1, placed.count() // tile)
    spread = (
        texts.join(placed.join(tiles, "component").hint("merge"), "doc_id")  # the same plan at every size
        .withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(units))).otherwise(-1 - F.col("component")).alias("unit"),
            F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
            F.col("doc_id").alias("doc"), "component", "copies", "side", "text",
        )
    )
    pairs = written(spread.groupBy("unit", "i", "j").applyInArrow(_compared(threshold), "doc long, links long, before long"))
    links = pairs.groupBy("doc").agg(F.sum("links").alias("links"))
    joined = connected_components(pairs.where("before is not null").select(F.col("doc").alias("src"), F.col("before").alias("dst")))
    classed = (
        classes.select("f", "g", "rep", "copies")
        .join(links.withColumnRenamed("doc", "rep"), "rep", "left")
        .join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("f", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    members = signed.select(F.col("doc").alias("doc_id"), "f", "g").join(classed, ["f", "g"]).select("doc_id", "n_links", "component_id")
    return (
        texts.select("doc_id").join(members, "doc_id", "left")
        .select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def first_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of documents, one row (the first by doc_id, null last) of each group of linked ones.

    Every row is judged by its own text, also where rows share a doc_id or have none.
    """
    row = free_name(documents, "_row")
    rows = W.keyed(documents, row)
    dropped = linked(W.keyed_texts(rows, row), threshold).where("not kept").select(F.col("doc_id").alias(row))
    return rows.join(dropped, row, "left_anti").select(*documents.columns)
