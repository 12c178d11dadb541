"""Merkle manifests of a table: trees of fan-out 8 in blocks of van Emde Boas layout.

Every row is a leaf; the leaves of one language form a tree in the order of doc_id, the roots of
the languages form the tree above. A tree is cut into aligned subtrees of HEIGHT levels (512
leaves). One task builds a block from its leaves and stores it as one array, in which a subtree is
split at half its height: first the upper half, then the lower subtrees one after another, each
laid out the same way. Where a node lies follows from its level and number alone, so building a
block and finding the siblings of a leaf use the same arithmetic, whatever a page of memory holds.
The roots of the blocks are the leaves of the next stage, until each tree is one block. Proofs come
from above: a block receives the path of its own root once, for all its leaves.

Defined cases: null fields (lang, text and doc_id among them) are marked as null in the leaf; null
languages form a tree of their own, the first; null doc_ids come first in their tree and are never
tampered with; rows of one doc_id are ordered by their leaf, equal rows are leaves of their own;
a tree of one leaf is that leaf, with no sibling; empty and very long texts are hashed whole by
Spark; an empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.tables import parts_for, written

FAN = 8
#: Levels below the root of a block; a task holds one block of FAN ** HEIGHT leaves.
HEIGHT = 3
#: Rows of digests that one task sorts.
SORTED = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"
BLOCK = "tree string, block long, entries long, levels int, layout binary, root string"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def nodes(levels: int) -> int:
    """Nodes of a complete tree of that many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(level: int, number: np.ndarray, levels: int) -> np.ndarray:
    """Places in the layout of the nodes `number` of a level (0: the root) of a complete tree."""
    base = np.zeros(len(number), np.int64)
    number = np.asarray(number, np.int64)
    while levels > 1:
        upper = levels // 2
        if level < upper:
            levels = upper
            continue
        level, levels = level - upper, levels - upper
        below = FAN**level
        base += nodes(upper) + number // below * nodes(levels)
        number = number % below
    return base


def height_of(entries: int) -> int:
    """Levels of hashing until one node remains."""
    height = 0
    while FAN**height < entries:
        height += 1
    return height


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def laid_out(leaves: list[str], levels: int) -> list[str | None]:
    """The block of these leaves, in layout order; places of nodes that don't exist are None."""
    cells: list[str | None] = [None] * nodes(levels)
    count = len(leaves)
    for place, leaf in zip(address(levels - 1, np.arange(count), levels).tolist(), leaves, strict=True):
        cells[place] = leaf
    for level in range(levels - 2, -1, -1):
        below = address(level + 1, np.arange(count), levels).tolist()
        count = -(-count // FAN)
        for number, place in enumerate(address(level, np.arange(count), levels).tolist()):
            cells[place] = digest(*(cells[x] for x in below[FAN * number : FAN * number + FAN]))
    return cells


def siblings(cells: list[str | None], numbers: list[int], entries: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf number, level by level, what comes before and after it in its run."""
    steps: list[list[tuple[str, str]]] = []
    for level in range(levels - 1, 0, -1):
        row = [cells[x] for x in address(level, np.arange(entries), levels).tolist()]
        runs = [row[k : k + FAN] for k in range(0, entries, FAN)]
        steps.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        entries = len(runs)
    return [[step[number // FAN**k] for k, step in enumerate(steps)] for number in numbers]


def _packed(cells: list[str | None]) -> bytes:
    return b"".join(bytes.fromhex(x) if x else bytes(32) for x in cells)


def _unpacked(layout: bytes) -> list[str]:
    text = layout.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _built(height: int):
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("entries", pa.int64()), ("levels", pa.int32()), ("layout", pa.binary()), ("root", pa.string())])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        entries = table["entries"][0].as_py()
        levels = min(height, height_of(entries)) + 1
        leaves = table.sort_by("pos")["digest"].to_pylist()
        cells = laid_out(leaves, levels)
        return pa.Table.from_pylist([{"tree": key[0].as_py(), "block": key[1].as_py(), "entries": entries, "levels": levels, "layout": _packed(cells), "root": cells[0]}], schema=schema)

    return build


def _proven(height: int):
    """Entries of a block with the block itself and the path of its root -> the entries with their own paths."""

    def prove(entries: pa.Table, above: pa.Table) -> pa.Table:
        blocks = [x for x in above.to_pylist() if x["layout"] is not None]
        paths = [x for x in above.to_pylist() if x["layout"] is None]
        columns = entries.drop_columns(["block"])
        if not entries.num_rows or not blocks or not paths:
            found, path = [], {"subroot": None, "root": None}
            columns = columns.slice(0, 0)
        else:
            block, path = blocks[0], paths[0]
            base = block["block"] * FAN**height
            inside = min(FAN**height, block["entries"] - base)
            upper = [(x["before"], x["after"]) for x in path["path"]]
            found = [x + upper for x in siblings(_unpacked(block["layout"]), [x - base for x in entries["pos"].to_pylist()], inside, block["levels"])]
        steps = [x for one in found for x in one]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array([x[0] for x in steps], pa.string()), pa.array([x[1] for x in steps], pa.string())], fields=list(_STEP))
        columns = columns.append_column("path", pa.ListArray.from_arrays(pa.array(ends), flat))
        for name in ("subroot", "root"):
            columns = columns.append_column(name, pa.array([path[name]] * columns.num_rows, pa.string()))
        return columns

    return prove


def placed(rows: DataFrame, order: list[str], per_part: int = SORTED) -> DataFrame:
    """rows with tree -> with pos (gapless from 0 in the order of the tree) and entries (the tree's size).

    Rows are sorted by ranges over all trees, so that no tree meets in one task; a place is one
    within its range plus the sizes of the tree's ranges before it.
    """
    spark = rows.sparkSession
    keys = ["tree", *order]
    parts = parts_for(spark, rows.count(), per_part)
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "salt").sortWithinPartitions(*keys, "salt").drop("salt")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(whole).alias("entries"))
    return ranged.join(shifts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocked(entries: DataFrame, height: int) -> DataFrame:
    return entries.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**height)).cast("long"))


@dataclass
class Manifest:
    """The blocks of all trees: of each stage the entries (tree, pos, digest, ...) and the blocks, lowest first."""

    stages: list[tuple[DataFrame, DataFrame]]
    height: int

    def roots(self) -> DataFrame:
        """tree, root, stage."""
        found = [
            blocks.where(F.col("entries") <= FAN**self.height).select("tree", "root", F.lit(k).alias("stage"))
            for k, (_, blocks) in enumerate(self.stages)
        ]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """above (tree, path, subroot, root): what lies over each tree -> the lowest entries with path, subroot, root."""
        tops = self.roots().select("tree", "stage").join(above, "tree")
        lower = None
        for k in reversed(range(len(self.stages))):
            entries, blocks = self.stages[k]
            known = tops.where(F.col("stage") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
            if lower is not None:
                known = known.unionByName(lower.select("tree", F.col("pos").alias("block"), "path", "subroot", "root"))
            right = blocks.drop("root").unionByName(known, allowMissingColumns=True)
            left = _blocked(entries, self.height)
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema) + f", path {PATH}, subroot string, root string"
            lower = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(_proven(self.height), schema)
            if k:
                lower = written(lower)
        return lower


def manifest(entries: DataFrame, order: list[str], height: int = HEIGHT) -> Manifest:
    """entries (tree string, digest string, ...) ordered by `order` within each tree."""
    entries = written(placed(entries, order))
    stages = []
    while True:
        blocks = written(_blocked(entries, height).groupBy("tree", "block").applyInArrow(_built(height), BLOCK))
        stages.append((entries, blocks))
        rest = blocks.where(F.col("entries") > FAN**height)
        if rest.isEmpty():
            return Manifest(stages, height)
        above = F.ceil(F.col("entries") / F.lit(FAN**height)).cast("long")
        entries = rest.select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), above.alias("entries"))


def field(value: Column) -> Column:
    """A field as it is hashed: - for null, else its UTF-8 bytes with their number before them."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(name, F.col(name))) for name in FIELDS)).cast("binary"), 256)


def tree_of(lang: Column) -> Column:
    """The tree's name, so that null comes first and the others in the order of their bytes."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]).cast("binary"), 256))


def document_proofs(documents: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """documents (doc_id, source, lang, n_chars, text) -> doc_id, leaf, changed, path, subroot, root.

    `changed` is the leaf after the `tampered` fields have been replaced, for the rows that `where` holds for.
    """
    other = F.when(where, leaf(**tampered)) if tampered else F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    leaves = written(rows.select(tree_of(F.col("lang")).alias("tree"), "doc_id", leaf().alias("digest"), other.alias("changed")))
    trees = manifest(leaves, ["doc_id", "digest"], height)
    tops = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    over = manifest(tops, ["name"], height)
    last = over.roots().select("tree", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
    above = over.paths(last.withColumn("path", F.coalesce("path", F.array().cast(PATH))))
    above = written(above.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    return trees.paths(above).select("doc_id", F.col("digest").alias("leaf"), "changed", "path", "subroot", "root")


def differing(old: Manifest, new: Manifest) -> DataFrame:
    """(tree, pos) of leaves that two manifests don't share: only blocks of different roots are opened."""
    pick = lambda blocks, name: blocks.select("tree", "block", "entries", F.col("root").alias(name), F.lit(name).alias("side"), "levels", "layout")
    one, two = pick(old.stages[0][1], "old"), pick(new.stages[0][1], "new")
    odd = one.select("tree", "block", "entries", "old").join(two.select("tree", "block", "entries", "new"), ["tree", "block", "entries"], "full")
    odd = odd.where(~F.col("old").eqNullSafe(F.col("new"))).select("tree", "block").distinct()
    opened = one.drop("old").unionByName(two.drop("new")).join(odd, ["tree", "block"], "left_semi")
    height = old.height

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        sides = []
        for row in table.to_pylist():
            count = min(FAN**height, row["entries"] - row["block"] * FAN**height)
            cells = _unpacked(row["layout"])
            sides.append([cells[x] for x in address(row["levels"] - 1, np.arange(count), row["levels"]).tolist()])
        one, two = sides if len(sides) == 2 else (sides[0], [])
        length = max(len(one), len(two))
        one, two = one + [None] * (length - len(one)), two + [None] * (length - len(two))
        base = key[1].as_py() * FAN**height
        at = [base + k for k in range(length) if one[k] != two[k]]
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.string()), pa.array(at, pa.int64())], names=["tree", "pos"])

    return opened.groupBy("tree", "block").applyInArrow(compare, "tree string, pos long")


def merkle_manifest(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """-> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = document_proofs(documents, {"text": lower}, drawn, height)
    beside = F.concat_ws("", F.transform("path", lambda step: F.concat(step["before"], step["after"])))
    rows = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(beside.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
