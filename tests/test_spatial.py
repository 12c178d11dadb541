"""Overlaps and unions of polygons against a plain clipper of signed triangles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import spatial

SHAPE = f"key string, rings {spatial.RINGS}"


def star(draw, x, y, size, points=9):
    """A concave ring, counter-clockwise."""
    turn = draw.random()
    return [(x + size * draw.uniform(0.25, 1) * math.cos(2 * math.pi * (k + turn) / points), y + size * draw.uniform(0.25, 1) * math.sin(2 * math.pi * (k + turn) / points)) for k in range(points)]


def holed(draw, x, y, size):
    """A star with a hole around its middle, which runs clockwise."""
    hole = [(x + size * 0.1 * math.cos(-2 * math.pi * k / 5), y + size * 0.1 * math.sin(-2 * math.pi * k / 5)) for k in range(5)]
    return [star(draw, x, y, size), hole]


def clip(subject, triangle):
    for (ax, ay), (bx, by) in zip(triangle, triangle[1:] + triangle[:1], strict=True):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            if side(p) >= 0:
                out.append(p)
            if (side(p) >= 0) != (side(q) >= 0):
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = out
        if not subject:
            break
    return subject


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def triangles(rings):
    for ring in rings:
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            triangle = [(0.0, 0.0), p, q]
            sign = math.copysign(1, signed(triangle))
            yield sign, triangle if sign > 0 else triangle[::-1]


def plain_common(one, two):
    return sum(s * t * abs(signed(clip(list(a), b)) if len(clip(list(a), b)) > 2 else 0.0) for s, a in triangles(one) for t, b in triangles(two))


def points(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


def square(x, y, size=1.0):
    return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size)]]


def frame(spark, rows, names):
    return spark.createDataFrame([(*r[:-1], points(r[-1])) for r in rows], f"{names}, rings {spatial.RINGS}").repartition(3)


@pytest.mark.parametrize("seed", range(12))
def test_common_area_of_concave_polygons_with_holes(seed):
    draw = random.Random(seed)
    one, two = holed(draw, 5, 5, 4), holed(draw, 5 + draw.uniform(-2, 2), 6, 3)
    arrays = [[np.array(r) for r in rings] for rings in (one, two)]
    assert spatial.common_area([arrays[0]], arrays[1]) == pytest.approx(plain_common(one, two), abs=1e-9)
    both = sum(sum(map(signed, rings)) for rings in (one, two))
    assert spatial.union_area(arrays) == pytest.approx(both - plain_common(one, two), abs=1e-9)
    made = spatial.union_rings(arrays)
    assert sum(abs(signed([tuple(p) for p in r])) for r in made) == pytest.approx(both - plain_common(one, two), abs=1e-9)


@pytest.mark.parametrize(("limit", "deeper"), [(2000, 10), (30, 10), (30, 0), (12, 2)], ids=str)
def test_overlap_areas_equal_all_pairs_whatever_the_cells(spark, limit, deeper):
    draw = random.Random(7)
    keys = [(f"k{k}", holed(draw, draw.uniform(0, 40), draw.uniform(0, 40), draw.choice([1, 3, 15]))) for k in range(14)]
    # a third of the shapes lie at one place
    shapes = [(k % 3, holed(draw, *((20, 20) if k % 3 == 0 else (draw.uniform(0, 40), draw.uniform(0, 40))), draw.choice([1, 4, 20]))) for k in range(24)]
    want = {}
    for key, one in keys:
        for by, two in shapes:
            common = plain_common(one, two)
            if common > 1e-9:
                want[key, by] = want.get((key, by), 0.0) + common
    got = spatial.overlap_areas(frame(spark, keys, "key string"), frame(spark, shapes, "rank int"), "key", ["rank"], limit, deeper).collect()
    assert {(r["key"], r["rank"]): r["area"] for r in got if r["area"] > 1e-9} == pytest.approx(want, abs=1e-8)
    assert len(got) == len({(r["key"], r["rank"]) for r in got})


def test_parts_of_a_key_that_overlap_count_once(spark):
    keyed = frame(spark, [("a", square(0, 0, 2)), ("a", square(1, 0, 2)), ("a", square(0, 0, 2)), ("b", square(9, 9))], "key string")
    shapes = frame(spark, [(1, square(0.5, 0.5)), (1, square(1, 1)), (2, square(50, 50))], "rank int")
    got = {(r["key"], r["rank"]): r["area"] for r in spatial.overlap_areas(keyed, shapes, "key", ["rank"]).collect()}
    assert got == {("a", 1): pytest.approx(2.0)}


@pytest.mark.parametrize("limit", [2000, 8])
def test_unions_of_disjoint_touching_and_overlapping_parts(spark, limit):
    rows = [
        ("apart", square(0, 0)), ("apart", square(5, 5)), ("touch", square(0, 0)), ("touch", square(1, 0)), ("over", square(0, 0, 2)), ("over", square(1, 1, 2)),
        ("same", square(3, 3)), ("same", square(3, 3)), ("within", square(0, 0, 4)), ("within", square(1, 1)), ("hole", [*square(0, 0, 3), *square(1, 1)]),
    ]
    parts = frame(spark, rows, "key string")
    got = {r["key"]: r["area"] for r in spatial.union_areas(parts, "key", limit).collect()}
    assert got == pytest.approx({"apart": 2, "touch": 2, "over": 7, "same": 1, "within": 16, "hole": 8})
    # the pieces are polygons of the same union: they can be joined and united again
    again = spatial.union_areas(spatial.dissolved(parts, "key", limit).select("key", "rings"), "key")
    assert {r["key"]: r["area"] for r in again.collect()} == pytest.approx(got)
    touch = spatial.dissolved(parts.where("key = 'touch'"), "key").collect()
    assert sum(len(r["rings"]) for r in touch) <= 2  # the shared edge is gone, up to the start of a slab


def test_odd_polygons(spark):
    rows = [("n", None), ("e", []), ("line", points([[(0, 0), (1, 1), (2, 2)]])), ("two", points([[(0, 0), (1, 1)]])), ("nan", [[{"x": math.nan, "y": 0.0}, {"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]]), (None, points(square(0, 0)))]
    keyed = spark.createDataFrame(rows, SHAPE)
    shapes = frame(spark, [(1, square(0, 0, 3))], "rank int")
    assert [tuple(r) for r in spatial.overlap_areas(keyed, shapes, "key", ["rank"]).collect()] == [("nan", 1, pytest.approx(0.5))]
    assert spatial.overlap_areas(keyed.limit(0), shapes, "key", ["rank"]).collect() == []
    assert spatial.overlap_areas(keyed.limit(0), shapes.limit(0), "key", ["rank"]).collect() == []
    assert spatial.union_areas(keyed.limit(0), "key").collect() == []


def test_geojson_and_grid_squares(spark):
    rows = spark.createDataFrame(
        [
            ("p", '{"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]}'),
            ("m", '{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]]}'),
            ("x", '{"type": "Point", "coordinates": [1, 2]}'), ("b", "nonsense"),
        ], "key string, text string",
    )
    made = rows.select("key", spatial.rings_of_geojson(F.col("text")).alias("rings"))
    assert {r["key"]: r["area"] for r in spatial.union_areas(made, "key").collect()} == pytest.approx({"p": 15, "m": 1.5})
    codes = spark.createDataFrame([("5339452312",), ("5339",), ("533995231x",), (None,)], "code string")
    found = [r["m"] for r in codes.select(spatial.mesh_rectangle(F.col("code")).alias("m")).collect()]
    assert found[1:] == [None, None, None]
    corner = found[0][0]
    west, south = 139 + 5 / 8 + 3 / 80 + 0 / 160 + 1 / 320, 53 * 2 / 3 + 4 / 12 + 2 / 120
    assert [(p["x"], p["y"]) for p in corner] == [pytest.approx(x) for x in ((west, south), (west + 1 / 320, south), (west + 1 / 320, south + 1 / 480), (west, south + 1 / 480))]


def test_hazard_levels_of_blocks_and_towns(spark):
    from lodeframe.operators import hazards

    sizes = spark.createDataFrame([("a", "t", 10.0), ("b", "t", 30.0), ("c", "u", 5.0), ("z", "v", 0.0)], "key string, town string, size double")
    common = spark.createDataFrame([("a", "r1", 2, 4.0), ("a", "r1", 6, 4.0), ("a", "r2", 3, 9.0), ("b", "r1", 1, 6.0), ("c", "s", 2, 9.0)], "key string, dataset string, rank int, area double")
    kinds = [("flood", "r1", None), ("flood", "r2", None), ("red", "s", 2)]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in hazards.levels(common, sizes, kinds).collect()}
    # the larger of two sources, not their sum; a share of at most the whole; 0 where nothing overlaps
    assert got["a", "chome", "flood"] == (0.9, 3.2, 6.0) and got["b", "chome", "flood"] == (0.2, 0.2, 1.0)
    assert got["c", "chome", "red"] == (1.0, 2.0, 2.0) and got["a", "chome", "red"] == got["z", "chome", "flood"] == (0.0, 0.0, 0.0)
    assert got["t", "town", "flood"] == (0.375, 0.95, 6.0) and ("v", "town", "flood") not in got
    hazards.checked(hazards.levels(common, sizes, kinds), sizes)
    with pytest.raises(ValueError, match="no overlap at all"):
        hazards.levels(common, sizes, [("flood", "nowhere", None)])
    liquid = spark.createDataFrame([("a", 1, 1.0), ("a", 6, 50.0), ("b", 5, 3.0), ("c", 6, 9.0)], "key string, rank int, area double")
    made = {tuple(r)[:2]: tuple(r)[3:] for r in hazards.graded_levels(liquid, sizes, "liquefaction").collect()}
    assert made == {("a", "chome"): (1.0, 5.0, 5.0), ("b", "chome"): (0.0, 1.0, 1.0), ("t", "town"): (0.25, 2.0, 5.0)}
    with pytest.raises(ValueError, match="liquefaction"):
        hazards.checked(hazards.graded_levels(liquid, sizes, "liquefaction"), sizes, ("liquefaction",))


def test_polygons_meet_the_address_master(spark):
    from lodeframe.operators import hazards

    named = spark.createDataFrame([("東京都", "港区", "芝一丁目"), ("東京都", "港区", "芝１丁目"), ("東京都", "港区", "水面"), ("東京都", "港区", "-")], "p string, c string, n string")
    keys = [r["k"] for r in named.select(hazards.place_key(F.col("p"), F.col("c"), F.col("n")).alias("k")).collect()]
    assert keys[0] == "東京都港区芝1丁目" and keys[2] == "東京都港区水面" and keys[3] is None
    master = spark.createDataFrame([(keys[0], "東京都港区芝"), ("東京都港区海1丁目", "東京都港区海")], "normalized_key string, town_key string")
    rows = frame(spark, [(keys[0], square(0, 0)), (keys[0], square(0.5, 0)), ("x9丁目", square(7, 7))], "key string")
    kept = hazards.keyed_polygons(rows, master, least=0.5)
    assert {(r["key"], r["town"], r["known"]) for r in kept.collect()} == {(keys[0], "東京都港区芝", True), ("x9丁目", "x", False)}
    assert {(r["key"], r["size"]) for r in hazards.sizes_of(kept).collect()} == {(keys[0], 1.5), ("x9丁目", 1.0)}
    with pytest.raises(ValueError, match="1 of 2"):
        hazards.keyed_polygons(rows, master)
    with pytest.raises(ValueError, match="0 of 2"):
        hazards.keyed_polygons(rows.where("key like 'x%'"), master, least=0.0)
