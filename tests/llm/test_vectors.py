import math

import numpy as np
import pytest

from lodeframe.llm import ann, embedding_dedup
from lodeframe.llm.components import connected_components


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(60, 16))
    rows = [(k, base[k].tolist(), k % 3) for k in range(60)]
    rows += [(100 + k, (base[k] + 0.05 * draw.normal(size=16)).tolist(), k % 3) for k in range(30)]
    rows += [(200 + k, (2 * base[k]).tolist(), k % 3) for k in range(10)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, base[0].tolist(), None), (305, [1.0, 2.0], 1), (306, [], 1), (307, [math.inf] * 16, 1)]
    rows += [(0, base[0].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def usable(vectors, labelled):
    out = {}
    for r in vectors.collect():
        e = r.embedding
        if e and (r.label is not None or not labelled) and all(x is not None and math.isfinite(x) for x in e) and any(e):
            out[r.vec_id] = (np.array(e), r.label)
    return out


@pytest.mark.parametrize("tile", [2048, 7])
def test_links_match_brute_force(vectors, tile):
    good = usable(vectors, True)
    links = {v: set() for v in {r.vec_id for r in vectors.collect()}}
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    rows = {r.vec_id: r for r in embedding_dedup.embedding_links(vectors, tile=tile).collect()}
    assert set(rows) == set(links)
    for v, near in links.items():
        seen, todo = {v}, [v]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert (rows[v].n_links, rows[v].component_id, rows[v].kept) == (len(near), min(seen), min(seen) == v)


def test_error_bounds_hold():
    units = embedding_dedup.unit(np.random.default_rng(1).normal(size=(200, 24)))
    codes, scale, error = embedding_dedup.quantise(units)
    rough = (codes.astype(float) * scale[:, None]) @ (codes.astype(float) * scale[:, None]).T
    bound = error[:, None] + error[None, :] * (1 + error[:, None])
    assert (np.abs(units @ units.T - rough) <= bound).all()


@pytest.mark.parametrize(("shard", "block"), [(8192, 2048), (20, 3)])
def test_search_is_exact_at_factor_one(vectors, shard, block):
    good = usable(vectors, False)
    old, ann.LEAF = ann.LEAF, 4
    try:
        rows = ann.nearest(vectors, "vec_id % 5 = 0", 7, shard=shard, block=block).collect()
    finally:
        ann.LEAF = old
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q in [v for v in good if v % 5 == 0]:
        scored = sorted(((-float(good[q][0] @ y), b) for b, (y, _) in good.items() if b != q and len(y) == len(good[q][0])))[:7]
        assert found.get(q, []) == [(b, round(-s, 9)) for s, b in scored]


def test_smaller_factor_gives_fewer_or_worse(vectors):
    exact = ann.nearest(vectors, "vec_id % 5 = 0", 5).count()
    assert 0 < ann.nearest(vectors, "vec_id % 5 = 0", 5, factor=0.5).count() <= exact


def test_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(none).count() == 0
    assert ann.nearest(none, "vec_id % 20 = 0").count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 7), (200, 201), (5, 5), (201, 200)]
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(rows) == 54
    assert {r.id: r.component for r in rows} == {**dict.fromkeys([*range(51), 100], 0), 200: 200, 201: 200}
