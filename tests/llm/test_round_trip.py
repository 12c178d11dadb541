import hashlib

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm import sentencepiece
from lodeframe.llm.queries import QUERIES

ROWS = [(1, "Hello  world"), (2, None), (3, ""), (4, " lead\n日本語é😀"), (5, "a▁b"), (6, "x" * 80), (7, "Hello world, hello 12.50!"), (8, "the cat the cat" * 40), (None, "left out")]


def brute(spark, rows):
    """Ids and sums word by word, with the library."""
    model = sentencepiece.Model(sentencepiece.default_model())
    cuts, out = model.cuts(), {}
    texts = [(d, t or "") for d, t in rows if d is not None]
    lead = model.processor.encode("\x00")
    parts = {d: sentencepiece._spelt(whole, starts, np.arange(len(starts))) for d, t in texts for whole, starts, _, _ in [cuts.words([t])]}
    ids = {w: model.processor.encode("\x00" + w)[len(lead) :] for ws in parts.values() for w in ws}  # no piece holds a null character and another
    table = spark.createDataFrame(list(ids.items()), "w string, ids array<int>").select("w", F.expr(f"pmod(xxhash64(ids), {sentencepiece.PRIME})").alias("g"), F.expr(f"pmod(xxhash64(w), {sentencepiece.PRIME})").alias("d"))
    sums = {r.w: (r.g, r.d) for r in table.collect()}
    for d, ws in parts.items():
        weight = sentencepiece.weights(np.arange(len(ws))).tolist()
        total = [sum(x * sums[w][k] for x, w in zip(weight, ws, strict=True)) % sentencepiece.PRIME for k in (0, 1)]
        out[d] = (len(ws), sum(len(ids[w]) for w in ws), *total, True)
    return out


def test_the_query_encodes_and_decodes(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("word", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute(spark, ROWS)
    old = sentencepiece.FREQUENT
    try:
        for bound in (old, 2, 0):  # the known words change the path, never the result
            sentencepiece.FREQUENT = bound
            found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_sentencepiece"](spark, str(tmp_path)).collect()}
            assert found == expected
    finally:
        sentencepiece.FREQUENT = old


def test_whole_texts_come_back(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    made = sentencepiece.sequences(docs)
    processor = sentencepiece.Model(sentencepiece.default_model()).processor
    texts = {d: (t or "").replace("▁", " ") for d, t in ROWS if d is not None}
    assert {r.doc_id: list(r.ids) for r in made.collect()} == {d: processor.encode(t or "") for d, t in ROWS if d is not None}
    back = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in sentencepiece.decoded(made).collect()}
    assert back == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}


def test_repeated_ids_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, "b"), (1, "a b"), (1, "a b"), (None, "x")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in sentencepiece.round_trip(twice).collect()] == [(1, 2)]
    assert sentencepiece.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_come_from_the_lattice(spark):
    """Without the edges of two letters no merge can start: every letter stays alone."""
    model = sentencepiece.Model(sentencepiece.default_model())
    words = spark.createDataFrame([(1, "▁the")], "key long, word string")
    assert [len(r.ids) for some in sentencepiece.encoded_words(words, model) for r in some.collect()] == [1]
    edges = sentencepiece.lattice(words, model)
    alone = edges.select(sentencepiece.merge_fold(F.filter("edges", lambda e: F.bit_count(e["inner"]) != 1)).alias("m"))
    assert alone.first().m == 0b11111


def test_viterbi_fold_finds_the_best_path(spark):
    scores = [-0.2, -1.0, -1.5]  # by rank
    edges = [(1, 1, 0, 1), (1, 2, 1, 1), (1, 3, 2, 1), (2, 4, 0, 2), (0, 5, 1, 2)]
    packed = sorted(((rank << 27) + (code << 6) + s, (1 << s) + (1 << s + n), (1 << s + n) - (2 << s)) for rank, code, s, n in edges)
    rows = spark.createDataFrame([(packed,)], "edges array<struct<order: long, ends: long, inner: long>>")
    assert rows.select(sentencepiece.viterbi_fold(F.col("edges"), scores).alias("m")).first().m == 0b1011
    listed = [{"s": s, "l": n, "id": code, "score": scores[rank], "raw": None} for rank, code, s, n in sorted(edges, key=lambda e: (e[2], e[3]))]
    assert sentencepiece.merged(listed, 3, True, 3) == [1, 5]
