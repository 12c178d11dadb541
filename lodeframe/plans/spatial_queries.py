"""Registered queries over polygons laid out from parts (plots) and suppliers (zones), and their DuckDB twins.

Plots are rectangles, corners or frames with whole coordinates, rows of 100 of them; seven neighbours
share a key and overlap. The twins count unit squares.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import hazards, spatial
from lodeframe.plans.frames import table
from lodeframe.plans.queries import query

KINDS = [("flood", "d1", None), ("flood", "d2", None), ("slide", "d0", None), ("slide_special", "d0", 2)]

SQUARES = """plots AS (
    SELECT DISTINCT CAST(p_partkey // 7 AS VARCHAR) AS key, p_partkey // 70 AS town, p_partkey % 100 * 4 + i AS cx, p_partkey // 100 * 3 + j AS cy
    FROM part, range(5) AS a(i), range(4) AS b(j) WHERE NOT (p_partkey % 3 = 1 AND i >= 3 AND j >= 2) AND NOT (p_partkey % 3 = 2 AND i = 2 AND j = 1)
), zones AS (
    SELECT 'd' || s_suppkey % 3 AS dataset, s_nationkey % 6 + 1 AS rank, s_suppkey * 83 % 400 + i AS cx, s_suppkey // 5 * 3 + j AS cy
    FROM supplier, range(20) AS a(i), range(15) AS b(j)
), common AS (
    SELECT key, dataset, rank, CAST(count(*) AS DOUBLE) AS area FROM plots JOIN zones USING (cx, cy) GROUP BY ALL
), sizes AS (
    SELECT key, CAST(key AS INTEGER) // 10 AS town, CAST(count(DISTINCT (cx, cy)) AS DOUBLE) AS size FROM plots GROUP BY ALL
)"""


def _plots(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = (k % 100 * 4).cast("double"), (F.floor(k / 100) * 3).cast("double")
    ring = lambda *at: F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in at))
    whole = ring((0, 0), (5, 0), (5, 4), (0, 4))
    corner = ring((0, 0), (5, 0), (5, 2), (3, 2), (3, 4), (0, 4))
    hole = ring((2, 1), (3, 1), (3, 2), (2, 2))
    rings = F.when(k % 3 == 1, F.array(corner)).when(k % 3 == 2, F.array(whole, hole)).otherwise(F.array(whole))
    return table(spark, sf_dir, "part").select(F.floor(k / 7).cast("string").alias("key"), F.floor(k / 70).cast("string").alias("town"), rings.alias("rings"))


def _zones(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = k * 83 % 400, F.floor(k / 5) * 3
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k % 3).alias("dataset"), (F.col("s_nationkey") % 6 + 1).cast("int").alias("rank"), spatial.rectangle(x, y, x + 20, y + 15).alias("rings"))


@query(f"WITH {SQUARES} SELECT key, dataset, CAST(rank AS INTEGER) AS rank, area FROM common", offers=False)
def polygon_overlaps(spark, sf_dir):
    return hazards.overlaps_of(_plots(spark, sf_dir), _zones(spark, sf_dir))


@query(f"WITH {SQUARES} SELECT key, size AS area FROM sizes", offers=False)
def polygon_unions(spark, sf_dir):
    return spatial.union_areas(_plots(spark, sf_dir), "key")


@query(
    f"""WITH {SQUARES}, kinds(hazard_type, dataset, only_rank) AS (VALUES ('flood', 'd1', NULL), ('flood', 'd2', NULL), ('slide', 'd0', NULL), ('slide_special', 'd0', 2)),
    every AS (SELECT * FROM sizes, kinds),
    per AS (SELECT e.key, e.town, e.size, e.hazard_type, e.dataset, round(least(coalesce(sum(area), 0) / size, 1.0), 4) AS area_ratio,
        round(least(coalesce(sum(rank * area), 0) / size, coalesce(max(rank), 0)), 4) AS rank_avg, CAST(coalesce(max(rank), 0) AS DOUBLE) AS rank_max
        FROM every e LEFT JOIN common o ON e.key = o.key AND e.dataset = o.dataset AND (e.only_rank IS NULL OR e.only_rank = o.rank) GROUP BY e.key, e.town, e.size, e.hazard_type, e.dataset),
    blocks AS (SELECT key, town, size, hazard_type, max(area_ratio) AS area_ratio, max(rank_avg) AS rank_avg, max(rank_max) AS rank_max FROM per GROUP BY key, town, size, hazard_type)
    SELECT key, 'chome' AS level, hazard_type, area_ratio, rank_avg, rank_max FROM blocks
    UNION ALL SELECT 't' || town, 'town', hazard_type, round(sum(area_ratio * size) / sum(size), 4), round(sum(rank_avg * size) / sum(size), 4), max(rank_max) FROM blocks GROUP BY town, hazard_type""",
    offers=False,
)
def hazard_levels(spark, sf_dir):
    plots = _plots(spark, sf_dir).withColumn("town", F.concat(F.lit("t"), F.floor(F.col("key").cast("int") / 10).cast("string")))
    sizes = hazards.sizes_of(plots)
    return hazards.levels(hazards.overlaps_of(plots, _zones(spark, sf_dir)), sizes, KINDS)
