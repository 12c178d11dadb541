"""Manifests against a plain Merkle tree; layout arithmetic; damage is found."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(row):
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, at):
    out = []
    for row in levels[:-1]:
        low = at // 8 * 8
        out.append(("".join(row[low:at]), "".join(row[at + 1 : low + 8])))
        at //= 8
    return out


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = mine, climb([leaf_of(r) for r in mine])
    top = climb([trees[x][1][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, row in enumerate(trees[lang][0]):
            levels = trees[lang][1]
            path = beside(levels, at) + beside(top, place)
            node = levels[0][at]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                node = leaf_of((*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])))
            for before, after in path:
                node = h(before, node, after)
            out.append((row[0], levels[0][at], levels[-1][0], top[-1][0], h(*(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def many(seed, langs):
    draw = random.Random(seed)
    rows = []
    for lang, n in langs.items():
        rows += [(draw.randrange(10**6), draw.choice(["s", None, "ü"]), lang, draw.choice([None, 3]), draw.choice(["Abc", "", None, "É x", "long " * 400])) for _ in range(n)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "langs", [{"en": 1}, {"en": 8, "de": 9}, {None: 65, "en": 1, "": 3, "ß": 8}, {"en": 700, "de": 513, "fr": 512, None: 64}, {f"l{k}": 1 + k for k in range(20)}], ids=str
)
def test_equals_a_plain_tree(spark, langs):
    rows = many(5, langs)
    rows += [rows[0], rows[0], (None, *rows[0][1:])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).withColumn("tree", F.lit(1)).repartition(3)
    assert sorted(map(tuple, merkle.merkle_manifest(frame).collect()), key=str) == expected(rows)


def test_more_stages_give_the_same(spark):
    rows = many(6, {"en": 150, "de": 70, None: 9})
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle.merkle_manifest(frame, height=1).collect()), key=str) == expected(rows)


def test_empty(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_holds_each_node_once_and_subtrees_together(levels):
    places = [merkle.address(k, np.arange(8**k), levels) for k in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes(levels)))
    upper = levels // 2
    if upper:
        top = np.concatenate(places[:upper])
        assert top.max() == merkle.nodes(upper) - 1
        for root in range(8**upper):
            below = np.concatenate([places[k][root * 8 ** (k - upper) : (root + 1) * 8 ** (k - upper)] for k in range(upper, levels)])
            assert below.max() - below.min() == merkle.nodes(levels - upper) - 1


def test_differing_blocks_name_the_changed_leaves(spark):
    rows = [(k, "s", "en" if k % 3 else "de", 1, f"text {k}") for k in range(1500)]
    other = [(*r[:4], "changed") if r[0] in (4, 5, 900) else r for r in rows] + [(1501, "s", "en", 1, "new")]

    def made(some):
        frame = spark.createDataFrame(some, SCHEMA)
        return merkle.manifest(frame.select(merkle.tree_of(F.col("lang")).alias("tree"), "doc_id", merkle.leaf().alias("digest")), ["doc_id"])

    found = {tuple(r) for r in merkle.differing(made(rows), made(other)).collect()}
    english = [r[0] for r in rows if r[2] == "en"]
    assert found == {("=en", english.index(4)), ("=en", english.index(5)), ("=de", 300), ("=en", 1000)}
