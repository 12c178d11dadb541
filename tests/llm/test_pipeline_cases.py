"""Stages and operators on empty, null, repeated and clashing input, and against plain definitions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import packing, quality, sharding, suffix_dedup

GOOD = "the quiet river runs under the hills and the stones are old and worn by water that never rests in any season of the year"
CLASHES = ("score", "score_", "_row", "_lo", "_hi", "_ALL", "keys", "f", "g", "short", "component", "salt", "rank", "kind")


def labelled(tmp_path, spark):
    rows = [(k, 1) for k in range(1, 40)] + [(k, 0) for k in range(40, 80)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")


def run(spark, docs, tmp_path):
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        kept.append(docs.collect())
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_stages_on_odd_rows(spark, tmp_path):
    labelled(tmp_path, spark)
    rows = [(1, f"{GOOD} first mail a.b9@c.de"), (1, f"{GOOD} first mail a.b9@c.de"), (1, "another text of its own with quiet words"), (None, GOOD), (2, None), (3, ""), (4, "  \t "), (5, GOOD * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    kept, pieces = run(spark, docs, tmp_path)
    assert all(r[name] == f"own {name}" for stage in kept for r in stage for name in CLASHES)
    texts = [r.text for r in kept[1]]
    assert len([t for t in texts if t and t.startswith(f"{GOOD} first")]) == 1  # of repeated rows one stays
    assert "another text of its own with quiet words" in texts  # though its doc_id repeats
    assert not any("a.b9@c.de" in (r.text or "") for r in kept[3])
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.start): p.length for p in pieces}.values()) or len({p.doc_id for p in pieces}) < len(kept[3])


def test_stages_on_an_empty_table(spark, tmp_path):
    labelled(tmp_path, spark)
    kept, pieces = run(spark, spark.createDataFrame([], "doc_id long, text string, score double"), tmp_path)
    assert not any(kept) and not pieces


def test_a_score_of_the_documents_stays(spark, tmp_path):
    docs = spark.createDataFrame([(k, GOOD if k % 2 else "@@@ !!!", 7.5) for k in range(1, 80)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 80)], "doc_id long, quality int")
    kept = quality.accepted(docs, labels).collect()
    assert {r.score for r in kept} == {7.5} and all(r.doc_id % 2 for r in kept)
    with pytest.raises(ValueError, match="score"):
        quality.scored(docs, quality.fit(docs, labels))


def test_one_class_alone(spark):
    docs = spark.createDataFrame([(k, GOOD) for k in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(1, 30)], "doc_id long, quality int")
    learned = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 30))
    score = {round(r.score, 4) for r in quality.quality(docs, labels).collect()}
    assert score == {round((learned + 0.5) / (learned + 1), 4)}


def test_ids_are_those_of_the_tokenizers_library(spark):
    """On every document of a given table."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    library = Tokenizer.from_file(path)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, coded in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.document_ids(text, path)[:-1].tolist() == coded.ids


def test_repeated_and_missing_ids_are_packed_and_sharded(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "four"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    assert sorted(p.doc_tokens for p in pieces) == sorted(len(packing.document_ids(t, packing.default_tokenizer())) for _, t in rows)
    placed = sharding.sharded(docs, shards=2).collect()
    assert sorted((r.doc_id or 0, r.size) for r in placed) == sorted((d or 0, len((t or "").encode()) + 16) for d, t in rows)


def test_longest_previous_factors_decide(spark):
    """A byte goes exactly if the longest earlier match from some start reaches it with WIDTH bytes: brute force over all starts."""
    draw = np.random.default_rng(5)
    base = bytes(draw.integers(97, 101, 400).tolist()).decode()
    rows = [(1, base), (2, "x" + base[50:260] + "y" + base[300:395]), (3, base[100:220] + base[100:220]), (4, base[:99])]
    found = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: set[str] = set()
    expected = {}
    for doc_id, text in rows:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            part = text[k : k + 100]
            if part in seen:
                gone[k : k + 100] = True
            seen.add(part)
        expected[doc_id] = int(gone.sum())
    assert found == expected
