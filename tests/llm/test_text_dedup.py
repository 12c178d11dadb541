import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeframe.llm import jaccard, phrase_dedup, suffix_dedup, windows


def brute_bytes(corpus, width):
    seen, out = set(), {}
    for doc_id, text in sorted(corpus, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if raw[p : p + width] in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(raw[p : p + width])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(corpus, width):
    first, out = {}, {}
    for doc_id, text in sorted(corpus, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = bytearray(len(words))
        for p in range(len(words) - width + 1):
            if first.setdefault(tuple(words[p : p + width]), doc_id) < doc_id:
                gone[p : p + width] = b"\1" * width
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_suffix_dedup_is_exact(documents, corpus):
    for width in (100, 30):
        rows = suffix_dedup.suffix_dedup(documents, width).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_bytes(corpus, width)


def test_phrase_dedup_is_exact(documents, corpus):
    for width in (50, 12):
        rows = phrase_dedup.phrase_dedup(documents, width).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_words(corpus, width)


def test_many_automata_find_the_same(corpus):
    texts = [(t or "").encode() for _, t in corpus]
    symbols, counts = phrase_dedup.word_hashes(texts)
    places = np.arange(0, 200, 7)
    phrases = phrase_dedup.short(symbols)[places[:, None] + np.arange(3)]
    whole = phrase_dedup.located(symbols, counts, list(phrase_dedup.compiled(phrases)), 3)
    old, phrase_dedup.PHRASES = phrase_dedup.PHRASES, 5
    try:
        automata = list(phrase_dedup.compiled(phrases))
        assert len(automata) > 1
        assert np.array_equal(whole, phrase_dedup.located(symbols, counts, automata, 3))
    finally:
        phrase_dedup.PHRASES = old
    owner = np.repeat(np.arange(len(counts)), counts)
    wanted = {tuple(symbols[p : p + 3]) for p in places}
    brute = [p for p in range(len(symbols) - 2) if owner[p] == owner[p + 2] and tuple(symbols[p : p + 3]) in wanted]
    assert whole.tolist() == brute


def test_only_automata_report_phrases():
    """A shard whose phrases are left out of the automata reports nothing of them."""
    text = " ".join(f"w{k}" for k in range(80))
    run = phrase_dedup._streamed(phrase_dedup.shape_for(50))
    documents = pa.table({"doc_id": pa.array([1, 2]), "text": [text, text + " end"]})
    symbols, _ = phrase_dedup.word_hashes([text.encode()])
    gram = windows.mix(windows.hashes(symbols, 10))
    at = windows.picked(gram, np.array([80]), np.array([80]), phrase_dedup.shape_for(50))
    spelt = [phrase_dedup.short(symbols)[k : k + 10].tobytes() for k in at]
    phrases = lambda some: pa.table({"shard": pa.array([0] * len(some)), "spelt": pa.array(some, pa.binary())})
    assert sorted(run((0,), phrases(spelt), documents)["doc"].to_pylist())[0] == 1
    assert run((0,), phrases([]), documents).num_rows == 0
    one = run((0,), phrases(spelt[:1]), documents)
    assert set(one["h"].to_numpy()[one["at"].to_numpy() >= 0].tolist()) == {int(gram[at[0]].view(np.int64))}


def test_repeated_and_missing_ids(spark, nothing):
    rows = spark.createDataFrame([(1, "a" * 150), (1, "a" * 150), (None, "a" * 150), (2, "a" * 150)], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(rows).collect()}
    assert found == {1: 149, 2: 150}
    assert suffix_dedup.suffix_dedup(nothing).count() == phrase_dedup.phrase_dedup(nothing).count() == 0


def test_deduplicated_keeps_columns_and_untouched_texts(documents, corpus):
    rows = phrase_dedup.deduplicated(documents)
    assert rows.columns == documents.columns
    kept = {r.doc_id: r.text for r in rows.collect()}
    brute = brute_words(corpus, 50)
    for doc_id, text in corpus:
        words, removed, _ = brute[doc_id]
        if removed == 0:
            assert kept[doc_id] == text
        elif removed == words:
            assert doc_id not in kept
        else:
            assert len(kept[doc_id].split()) == words - removed


def test_shapes_are_covered():
    for width in (2, 5, 12, 50, 100, 200):
        for shape in (suffix_dedup.shape_for(width), phrase_dedup.shape_for(width)):
            assert 1 <= shape.block <= shape.gram < shape.width
            assert shape.block <= max(1, shape.reach)


def brute_links(corpus):
    sets, inverted = {}, defaultdict(list)
    for doc_id, text in corpus:
        words = (text or "").encode().split()
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        for s in sets[doc_id]:
            inverted[s].append(doc_id)
    common = defaultdict(int)
    for ids in inverted.values():
        for a in range(len(ids)):
            for b in range(a):
                common[tuple(sorted((ids[a], ids[b])))] += 1
    links = [(a, b) for (a, b), c in common.items() if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c)]
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {d: (count[d], find(d), find(d) == d) for d in sets}


def test_jaccard_links_match_brute_force(documents, corpus):
    for tile in (jaccard.TILE, 2):
        rows = jaccard.jaccard_links(documents, tile=tile).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_links(corpus)


def test_recall_decides_the_depth():
    assert jaccard.depth_for(0.8, 0.999) == 7
    assert jaccard.depth_for(0.8, 0.9) == 8
    assert jaccard.depth_for(0.5, 0.999) < 3


def test_first_of_each_group(documents, corpus):
    kept = {r.doc_id for r in jaccard.first_of_each(documents).select("doc_id").collect()}
    assert kept == {d for d, (_, _, first) in brute_links(corpus).items() if first}


def test_jaccard_of_nothing(nothing):
    assert jaccard.jaccard_links(nothing).count() == 0


def test_large_near_copy_group_in_tiles(spark):
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(words[:-1] + [f"end{k}"])) for k in range(40)]
    found = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), tile=8).agg(F.min("n_links"), F.max("n_links"), F.count_if("kept")).first()
    assert tuple(found) == (39, 39, 1)
