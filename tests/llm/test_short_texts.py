import numpy as np
import pytest

from lodeframe.llm import jaccard


@pytest.mark.parametrize("union", [5, 10, 20, 40, 100, 300])
def test_recall_at_the_threshold_for_every_size(union):
    """Pairs of Jaccard similarity 0.8: all but about one in 2,000 share a key, however few shingles they have."""
    draw, pairs = np.random.default_rng(union), 1000
    apart = union // 5
    value, of = [], []
    for k in range(pairs):
        shingles = draw.integers(0, 1 << 64, union, np.uint64)
        left = apart // 2
        for side, own in enumerate((shingles[: union - apart + left], np.concatenate([shingles[: union - apart], shingles[union - apart + left :]]))):
            value.append(np.sort(own))
            of.append(np.full(len(own), 2 * k + side))
    there, _, keys = jaccard.signatures(np.concatenate(value), np.concatenate(of), 2 * pairs, jaccard.depth_for(0.8))
    assert len(there) == 2 * pairs
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.995


def test_short_near_copies_are_found(spark):
    rows = []
    for k in range(60):
        words = [f"{k}w{n}" for n in range(13)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "end"]))]  # 9 of 10 shingles
    found = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_links, r.component_id) for r in found} == {(d, 1, d - d % 2) for d, _ in rows}


def test_prefixes_are_shortened_by_size():
    """Only as far as the least similar link of a text of that size needs."""
    assert [round(jaccard.least_similarity(n, 0.8), 3) for n in (1, 3, 4, 5, 6, 7, 10)] == [1.0, 1.0, 0.8, 0.8, 0.833, 0.857, 0.8]
    depths = jaccard.depths_by_size(0.8, 0.999)
    assert depths[3] == depths[6] == depths[7] == jaccard.DEEPEST
    assert depths[4] == depths[10] == depths[-1] == jaccard.depth_for(0.8) == jaccard.DEEPEST - 1


def test_nodes_follow_the_shortened():
    """Under one short prefix: whole prefixes join by themselves, unless some text was shortened."""
    key, deep, doc = np.array([1, 1, 1, 1]), np.array([5, 5, 6, 6]), np.array([10, 11, 12, 13])
    pairs = lambda short: sorted(zip(*(x.tolist() for x in jaccard.neighbours(key, deep, np.array(short), doc)[2:]), strict=True))
    assert pairs([False] * 4) == [(11, 10), (13, 12)]
    assert pairs([False, False, True, False]) == [(11, 10), (12, 11), (13, 12)]
    first, node, *_ = jaccard.neighbours(key, deep, np.array([False] * 4), doc)
    assert doc[first].tolist() == [10, 12] and not node.any()


def test_no_candidates_without_the_tries(spark, monkeypatch):
    """Links come from the forest alone: texts whose tries are emptied link with none but their equals."""
    rows = [(1, " ".join(f"w{n}" for n in range(40))), (2, " ".join(f"w{n}" for n in range(39))), (3, " ".join(f"w{n}" for n in range(39)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_links(frame).collect()} == {1: 2, 2: 2, 3: 2}
    monkeypatch.setattr(jaccard, "candidate_groups", lambda reps, parts: reps.sparkSession.createDataFrame([], "id long, component long"))
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_links(frame).collect()} == {1: 0, 2: 1, 3: 1}


def test_a_text_with_many_copies(spark):
    rows = [(k, "same words in all of these copies here") for k in range(300)] + [(1000, "same words in all of these copies here now"), (2000, "alone")]
    found = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 302 and found[2000] == (0, 2000, True)
    assert {found[k] for k in range(1, 300)} == {(300, 0, False)} or {found[k] for k in range(1, 300)} == {(299, 0, False)}
