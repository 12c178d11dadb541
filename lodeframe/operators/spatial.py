"""Polygons: areas of overlaps and unions, by cells that split where it is crowded.

A polygon is an array of rings of points {x, y}; a place is inside if a ray from it crosses the
rings an odd number of times, so holes and concave or damaged rings need no repair. Polygons are
clipped to the cells of a grid, map-side. Cells tile the plane, so parts of a result from different
cells are disjoint and add up: no pair is seen twice, however many cells it shares. A cell with more
than LIMIT edges is cut in four, again and again where polygons are dense, as long as its pieces lie
in fewer than two quarters on average: polygons that cover each other are no fewer in a smaller cell.
What stays crowded is dealt to several tasks, keys on one side and shapes on the other. Within a cell, areas
are exact: between neighbouring corners and crossings no edge crosses another, so the plane falls
into trapezoids that are inside or outside as a whole.

Defined cases: null polygons, rings of fewer than three points and points that are null or not
finite are ignored; a polygon without area has none in common with anything and isn't reported.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeframe.sources.stored import written

POINT = "struct<x: double, y: double>"
RINGS = f"array<array<{POINT}>>"
#: Edges in a cell before it is split, levels below the first grid, entries of a matrix at once.
LIMIT, DEEPER, MATRIX = 2000, 10, 1 << 21
#: Unions in one batch of results.
BATCH = 1000
CELL = ("level", "cx", "cy")


def rings_of_geojson(text: Column) -> Column:
    """The rings of a GeoJSON Polygon or MultiPolygon, null for anything else."""
    kind = F.get_json_object(text, "$.type")
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<array<double>>>")
    many = F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.transform(one, points)).when(kind == "MultiPolygon", F.transform(F.flatten(many), points))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A polygon of one ring from two corners."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2)))


def mesh_rectangle(code: Column) -> Column:
    """The rectangle (degrees east and north) of a ten-digit grid square code; null for another form.

    Two digits of latitude in steps of 2/3 degree and two of longitude from 100, then eighths,
    tenths of these, and two quarterings (1 south-west, 2 south-east, 3 north-west, 4 north-east).
    """
    digit = lambda k: F.substring(code, k, 1).cast("int")
    half = lambda k, of: F.when(digit(k).isin(*of), 1).otherwise(0)
    # counted in units of the smallest square: 320 to a first-order square, on both axes
    north = F.substring(code, 1, 2).cast("int") * 320 + digit(5) * 40 + digit(7) * 4 + half(9, (3, 4)) * 2 + half(10, (3, 4))
    east = F.substring(code, 3, 2).cast("int") * 320 + digit(6) * 40 + digit(8) * 4 + half(9, (2, 4)) * 2 + half(10, (2, 4))
    lon, lat = lambda k: k / F.lit(320.0) + 100, lambda k: k * 2 / F.lit(960.0)
    return F.when(code.rlike("^[0-9]{4}[0-7]{2}[0-9]{2}[1-4]{2}$"), rectangle(lon(east), lat(north), lon(east + 1), lat(north + 1)))


# ---- geometry of one cell ----


def packed(rings: list[np.ndarray]) -> bytes:
    """Rings as pairs of doubles, each followed by a pair of nan."""
    gap = np.full((1, 2), np.nan)
    return np.concatenate([x for ring in rings for x in (ring, gap)]).tobytes() if rings else b""


def unpacked(raw: bytes) -> list[np.ndarray]:
    points = np.frombuffer(raw, np.float64).reshape(-1, 2)
    ends = np.flatnonzero(np.isnan(points[:, 0]))
    return [points[a:b] for a, b in zip(np.append(0, ends[:-1] + 1), ends, strict=True)]


def half_plane(ring: np.ndarray, axis: int, bound: float, below: bool) -> np.ndarray:
    """The ring clipped to one side of a line parallel to an axis; what runs along the line encloses no area."""
    inside = ring[:, axis] <= bound if below else ring[:, axis] >= bound
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    after = np.roll(ring, -1, axis=0)
    crosses = inside != np.roll(inside, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = (bound - ring[:, axis]) / (after[:, axis] - ring[:, axis])
        met = ring + part[:, None] * (after - ring)
    met[:, axis] = bound
    both = np.stack([ring, met], axis=1)
    return both[np.stack([inside, crosses], axis=1)]


def strip(rings: list[np.ndarray], axis: int, low: float, high: float) -> list[np.ndarray]:
    cut = [half_plane(half_plane(ring, axis, high, True), axis, low, False) for ring in rings]
    return [ring for ring in cut if len(ring) >= 3 and (ring.max(axis=0) > ring.min(axis=0)).all()]


def edges_of(rings: list[np.ndarray]) -> np.ndarray:
    """(x1, y1, x2, y2) of the edges with x1 < x2; vertical ones bound no trapezoid."""
    if not rings:
        return np.zeros((0, 4))
    edges = np.concatenate([np.hstack([ring, np.roll(ring, -1, axis=0)]) for ring in rings])
    back = edges[:, 0] > edges[:, 2]
    edges[back] = edges[back][:, [2, 3, 0, 1]]
    return edges[edges[:, 0] < edges[:, 2]]


def _crossings(edges: np.ndarray) -> np.ndarray:
    """x of all points where two edges cross."""
    slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])
    base = edges[:, 1] - slope * edges[:, 0]
    found = [np.zeros(0)]
    rows = max(1, MATRIX // max(1, len(edges)))
    for a in range(0, len(edges), rows):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[None, :] - base[a : a + rows, None]) / (slope[a : a + rows, None] - slope[None, :])
        low, high = np.maximum(edges[a : a + rows, None, 0], edges[None, :, 0]), np.minimum(edges[a : a + rows, None, 2], edges[None, :, 2])
        found.append(x[(x > low) & (x < high)])
    return np.concatenate(found)


def trapezoids(polygons: list[list[np.ndarray]], wanted) -> Iterator[tuple[np.ndarray, ...]]:
    """(left, right, y at the left below and above, y at the right below and above, edge below, edge above) of the wanted places.

    wanted gets a boolean array whose last axis is the polygon, and tells which places count.
    """
    parts = [edges_of(rings) for rings in polygons]
    edges = np.concatenate([np.zeros((0, 4)), *parts])
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    if not len(edges):
        return
    x = np.unique(np.concatenate([edges[:, 0], edges[:, 2], _crossings(edges)]))
    left, right = x[:-1], x[1:]
    slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])
    own = owner[:, None] == np.arange(len(parts))
    rows = max(1, MATRIX // (len(edges) * len(parts)))
    for a in range(0, len(left), rows):
        l, r = left[a : a + rows, None], right[a : a + rows, None]  # noqa: E741
        on = (edges[None, :, 0] <= l) & (edges[None, :, 2] >= r)
        at_left, at_right = edges[:, 1] + slope * (l - edges[:, 0]), edges[:, 1] + slope * (r - edges[:, 0])
        order = np.argsort(np.where(on, at_left + at_right, np.inf), axis=1, kind="stable")
        take = lambda m, o=order: np.take_along_axis(m, o, axis=1)
        on, at_left, at_right = take(on), take(at_left), take(at_right)
        inside = np.cumsum(own[order] & on[:, :, None], axis=1) % 2 == 1
        good = wanted(inside)[:, :-1] & on[:, 1:]
        s, k = np.nonzero(good)
        yield l[s, 0], r[s, 0], at_left[s, k], at_left[s, k + 1], at_right[s, k], at_right[s, k + 1], order[s, k], order[s, k + 1]


def area(polygons: list[list[np.ndarray]], wanted) -> float:
    total = 0.0
    for left, right, a, b, c, d, _, _ in trapezoids(polygons, wanted):
        total += float((np.maximum((b - a) + (d - c), 0) * (right - left)).sum()) / 2
    return total


def union_area(polygons: list[list[np.ndarray]]) -> float:
    return area(polygons, lambda inside: inside.any(axis=2))


def common_area(many: list[list[np.ndarray]], one: list[np.ndarray]) -> float:
    """Area of the union of `many` within `one`."""
    return area([*many, one], lambda inside: inside[:, :, :-1].any(axis=2) & inside[:, :, -1])


def union_rings(polygons: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Disjoint trapezoids that make up the union; neighbours between the same two edges are one."""
    found = [np.stack(x, axis=1) for x in trapezoids(polygons, lambda inside: inside.any(axis=2))]
    rows = np.concatenate([np.zeros((0, 8)), *found])
    rows = rows[(rows[:, 3] > rows[:, 2]) | (rows[:, 5] > rows[:, 4])]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 7], rows[:, 6]))]
    follows = np.zeros(len(rows), bool)
    follows[1:] = (rows[1:, 6:] == rows[:-1, 6:]).all(axis=1) & (rows[1:, 0] == rows[:-1, 1])
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(rows)) - 1
    return [np.array([(rows[a, 0], rows[a, 2]), (rows[b, 1], rows[b, 4]), (rows[b, 1], rows[b, 5]), (rows[a, 0], rows[a, 3])]) for a, b in zip(first, last, strict=True)]


# ---- cells ----


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings as bytes with their bounds; rows without area are left out."""
    for batch in batches:
        at = batch.schema.get_field_index("rings")
        keep, raw, bounds = [], [], []
        polygons = batch.column(at)
        rings = polygons.values
        points = rings.values
        xy = np.stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], axis=1).reshape(-1, 2)
        finite = np.isfinite(xy).all(axis=1) & points.is_valid().to_numpy(zero_copy_only=False)
        starts, ends, there, real = polygons.offsets.to_pylist(), rings.offsets.to_pylist(), polygons.is_valid().to_pylist(), rings.is_valid().to_pylist()
        for k in range(len(polygons)):
            good = []
            for n in range(starts[k], starts[k + 1]) if there[k] else ():
                if real[n] and ends[n + 1] - ends[n] >= 3:
                    ring, fine = xy[ends[n] : ends[n + 1]], finite[ends[n] : ends[n + 1]]
                    ring = ring if fine.all() else ring[fine]
                    if len(ring) >= 3:
                        good.append(ring)
            if good:
                every = np.concatenate(good)
                keep.append(k)
                raw.append(packed(good))
                bounds.append((*every.min(axis=0), *every.max(axis=0)))
        rest = [batch.column(k).take(pa.array(keep, pa.int64())) for k in range(batch.num_columns) if k != at]
        names = [x for x in batch.schema.names if x != "rings"]
        corner = np.array(bounds, float).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*rest, pa.array(raw, pa.binary()), *(pa.array(corner[:, k]) for k in range(4))], names=[*names, "raw", "x1", "y1", "x2", "y2"])


def _cells(low: float, high: float, base: float, width: float) -> range:
    first = max(0, math.floor((low - base) / width))
    return range(first, max(first + 1, math.ceil((high - base) / width)))


def _cut(x0: float, y0: float, size: float, level: int | None, per_cell: bool):
    """Pieces of polygons: by the cells of a level, or (per_cell) by the four quarters of the cell each is in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = {"raw", "edges", "spread", *CELL} & set(batch.schema.names) | ({"x1", "y1", "x2", "y2"} & set(batch.schema.names))
            names = [x for x in batch.schema.names if x not in inner]
            levels = batch.column("level").to_pylist() if per_cell else [None] * batch.num_rows
            held: dict[str, list] = {"at": [], "level": [], "cx": [], "cy": [], "edges": [], "spread": [], "raw": []}
            for k, (raw, before) in enumerate(zip(batch.column("raw").to_pylist(), levels, strict=True)):
                rings = unpacked(raw)
                now = before + 1 if per_cell else level
                width = size / 2**now
                every = np.concatenate(rings)
                (x1, y1), (x2, y2) = every.min(axis=0).tolist(), every.max(axis=0).tolist()
                columns = _cells(x1, x2, x0, width)
                for cx in columns:
                    whole = len(columns) == 1 and len(_cells(y1, y2, y0, width)) == 1  # within one cell: nothing to clip
                    column = [r for r in rings if (r.max(axis=0) > r.min(axis=0)).all()] if whole else strip(rings, 0, x0 + cx * width, x0 + (cx + 1) * width)
                    if not column:
                        continue
                    tall = np.concatenate(column)
                    for cy in _cells(tall[:, 1].min(), tall[:, 1].max(), y0, width):
                        piece = column if whole else strip(column, 1, y0 + cy * width, y0 + (cy + 1) * width)
                        if piece:
                            here = np.concatenate(piece)
                            middle = x0 + (cx + 0.5) * width, y0 + (cy + 0.5) * width
                            spread = math.prod(2 if low < m < high else 1 for low, m, high in zip(here.min(axis=0), middle, here.max(axis=0), strict=True))
                            for name, value in (("at", k), ("level", now), ("cx", cx), ("cy", cy), ("edges", len(here)), ("spread", spread), ("raw", packed(piece))):
                                held[name].append(value)
            rest = [batch.column(x).take(pa.array(held["at"], pa.int64())) for x in names]
            made = [pa.array(held["level"], pa.int32()), pa.array(held["cx"], pa.int64()), pa.array(held["cy"], pa.int64()), pa.array(held["edges"], pa.int64()), pa.array(held["spread"], pa.int32()), pa.array(held["raw"], pa.binary())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, *CELL, "edges", "spread", "raw"])

    return cut


def _columns(frame: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name not in without)


def _width(wide: float, high: float, cells: float) -> float:
    """Width of the first grid's cells, a power of two: that many cells lie in the bounds, however long and narrow these are."""
    longest = max(wide, high) or 1.0
    wanted = longest if cells <= 1 else max(math.sqrt(wide * high / cells), longest / 2**14)
    return 2.0 ** (math.ceil if cells <= 1 else math.floor)(math.log2(wanted))


def _spread(polygons: DataFrame) -> DataFrame:
    """Polygons dealt evenly to all cores: few row groups would leave all clipping to few tasks."""
    spark = polygons.sparkSession
    return polygons.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def gridded(polygons: DataFrame, limit: int = LIMIT, deeper: int = DEEPER, both: bool = False) -> DataFrame:
    """polygons (..., rings) -> pieces (..., level, cx, cy, edges, spread, raw) in cells of at most `limit` edges, where splitting helps.

    both: polygons have a boolean column `second`; cells with pieces of one kind alone are dropped.
    """
    rest = _columns(polygons, "rings")
    shapes = written(_spread(polygons).mapInArrow(_raw, f"{rest}, raw binary, x1 double, y1 double, x2 double, y2 double"))
    bounds = shapes.agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("x1", "y1")), *(F.max(c).alias(c) for c in ("x2", "y2")), F.sum(F.octet_length("raw")).alias("b")).first()
    schema = f"{rest}, level int, cx long, cy long, edges long, spread int, raw binary"
    if not bounds["n"]:
        return shapes.drop("x1", "y1", "x2", "y2").mapInArrow(lambda batches: iter(()), schema)
    size = _width(bounds["x2"] - bounds["x1"], bounds["y2"] - bounds["y1"], bounds["b"] / 16 / limit)
    x0, y0 = (math.floor(bounds[c] / size) * size for c in ("x1", "y1"))
    pieces = written(shapes.mapInArrow(_cut(x0, y0, size, 0, False), schema))
    for _ in range(deeper):
        cells = pieces.groupBy(*CELL).agg((F.when(F.avg("spread") < 2, F.sum("edges")).otherwise(0)).alias("_all"), *([F.count_if("second").alias("_b"), F.count_if(~F.col("second")).alias("_a")] if both else []))
        if both:
            cells = cells.where("_a > 0 and _b > 0")
        cells = written(cells)
        crowded = cells.where(F.col("_all") > limit).select(*CELL)
        if crowded.isEmpty():
            break
        dense = pieces.join(crowded, list(CELL), "left_semi").select(*pieces.columns)
        cut = dense.mapInArrow(_cut(x0, y0, size, None, True), schema)
        calm = cells.where(F.col("_all") <= limit).select(*CELL)
        pieces = written(pieces.join(calm, list(CELL), "left_semi").select(*pieces.columns).unionByName(cut))
    return pieces


def _dealt(pieces: DataFrame, key: str, limit: int) -> DataFrame:
    """Pieces with (sa, sb): a crowded cell is several groups, keys dealt by sa and shapes by sb."""
    second = F.col("second")
    sizes = pieces.groupBy(*CELL).agg(F.sum(F.when(~second, F.col("edges"))).alias("_a"), F.sum(F.when(second, F.col("edges"))).alias("_b"))
    salts = sizes.where("_a is not null and _b is not null").select(*CELL, F.ceil(F.col("_a") / limit).cast("int").alias("_na"), F.ceil(F.col("_b") / limit).cast("int").alias("_nb"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n, by: F.array(F.pmod(F.xxhash64(by), F.col(n)).cast("int"))
    found = pieces.join(salts, list(CELL)).withColumn("sa", F.explode(F.when(second, every("_na")).otherwise(mine("_na", key))))
    return found.withColumn("sb", F.explode(F.when(second, mine("_nb", "raw")).otherwise(every("_nb")))).drop("_na", "_nb")


def _boxes(shapes: list[list[np.ndarray]]) -> np.ndarray:
    return np.array([(*np.concatenate(x).min(axis=0), *np.concatenate(x).max(axis=0)) for x in shapes]).reshape(-1, 4)


def _overlaps(key: str, by: list[str]):
    def run(_: tuple, table: pa.Table) -> pa.Table:
        shapes = [unpacked(x) for x in table["raw"].to_pylist()]
        second = np.array(table["second"].to_pylist(), bool)
        box = _boxes(shapes)
        members: dict[object, list[int]] = {}
        names = table[key].to_pylist()
        for k in np.flatnonzero(~second).tolist():
            members.setdefault(names[k], []).append(k)
        left, right, areas = [], [], []
        others = np.flatnonzero(second)
        for mine in map(np.array, members.values()):
            near = (box[mine, None, :2] < box[None, others, 2:]).all(axis=2) & (box[None, others, :2] < box[mine, None, 2:]).all(axis=2)
            for n in np.flatnonzero(near.any(axis=0)).tolist():
                other = int(others[n])
                if (found := common_area([shapes[k] for k in mine[near[:, n]].tolist()], shapes[other])) > 0:
                    left.append(int(mine[0]))
                    right.append(other)
                    areas.append(found)
        taken = [table[key].take(pa.array(left, pa.int64())), *(table[c].take(pa.array(right, pa.int64())) for c in by)]
        return pa.table([*taken, pa.array(areas, pa.float64())], names=[key, *by, "area"])

    return run


def overlap_areas(keyed: DataFrame, shapes: DataFrame, key: str, by: list[str], limit: int = LIMIT, deeper: int = DEEPER) -> DataFrame:
    """keyed (key, rings), shapes (by..., rings) -> key, by..., area: what the union of a key's polygons has in common with each shape, added up by `by`.

    Shapes of one class that overlap each other count as often as they cover a place; pairs without
    common area have no row.
    """
    left = keyed.select(F.lit(False).alias("second"), key, "rings").where(F.col(key).isNotNull())
    right = shapes.select(F.lit(True).alias("second"), *by, "rings")
    schema = f"{_columns(keyed.select(key))}, {_columns(shapes.select(*by))}, area double"
    pieces = gridded(left.unionByName(right, allowMissingColumns=True), limit, deeper, both=True)
    found = _dealt(pieces, key, limit).groupBy(*CELL, "sa", "sb").applyInArrow(_overlaps(key, by), schema)
    return found.groupBy(key, *by).agg(F.sum("area").alias("area"))


def _united(key: str, kind: pa.DataType, shapes: bool):
    """Unions of pieces that come sorted by key and cell: one stream of many keys, since most keys have a few pieces only."""
    schema = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def made(names: list, points: list, areas: list) -> pa.RecordBatch:
        columns = [pa.array(names, kind), pa.array(areas, pa.float64())]
        return pa.RecordBatch.from_arrays([columns[0], pa.array(points, schema), columns[1]] if shapes else columns, names=[key, "rings", "area"] if shapes else [key, "area"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (key, *CELL, "raw")), strict=True))
        names, points, areas = [], [], []
        for place, rows in itertools.groupby(places, lambda x: x[:-1]):
            polygons = [unpacked(x[-1]) for x in rows]
            if shapes:
                rings = union_rings(polygons)
                # half the cross product of the diagonals
                areas.append(sum(abs((r[2, 0] - r[0, 0]) * (r[3, 1] - r[1, 1]) - (r[2, 1] - r[0, 1]) * (r[3, 0] - r[1, 0])) / 2 for r in rings))
                points.append([[{"x": x, "y": y} for x, y in r.tolist()] for r in rings])
            else:
                areas.append(union_area(polygons))
            names.append(place[0])
            if len(names) == BATCH:
                yield made(names, points, areas)
                names, points, areas = [], [], []
        yield made(names, points, areas)

    return run


def _unions(parts: DataFrame, key: str, limit: int, deeper: int, shapes: bool) -> DataFrame:
    pieces = gridded(parts.select(key, "rings").where(F.col(key).isNotNull()), limit, deeper).select(key, *CELL, "raw")
    kind = to_arrow_type(parts.schema[key].dataType)
    sorted_ = pieces.repartition(key, *CELL).sortWithinPartitions(key, *CELL)
    return sorted_.mapInArrow(_united(key, kind, shapes), f"{_columns(parts.select(key))}, {f'rings {RINGS}, ' if shapes else ''}area double").where("area > 0")


def dissolved(parts: DataFrame, key: str, limit: int = LIMIT, deeper: int = DEEPER) -> DataFrame:
    """parts (key, rings) -> key, rings, area by cell: the union of a key's parts as disjoint pieces that add up.

    Parts of a key meet within a cell only; a key that covers many cells is never gathered.
    """
    return _unions(parts, key, limit, deeper, True)


def union_areas(parts: DataFrame, key: str, limit: int = LIMIT, deeper: int = DEEPER) -> DataFrame:
    """parts (key, rings) -> key, area of the union of its parts."""
    return _unions(parts, key, limit, deeper, False).groupBy(key).agg(F.sum("area").alias("area"))
