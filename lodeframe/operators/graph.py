"""Shortest paths over rides and transfers by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.numbers import haversine_km, ride_minutes
from lodeframe.sources.stored import written


def rail_edges(stations: DataFrame, links: DataFrame, penalty: float = 10.0) -> DataFrame:
    """Edges src, dst, minutes, km, transfers between stations and their groups (groups are negative).

    A ride costs its distance; station to group and back cost half a transfer each, counted when leaving the group.
    """
    a = stations.select(F.col("station_cd").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stations.select(F.col("station_cd").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    rides = links.join(a, "a").join(b, "b").select("a", "b", km.alias("km"), ride_minutes(km).alias("minutes"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = lambda s, d: rides.select(F.col(s).alias("src"), F.col(d).alias("dst"), "minutes", "km", zero.alias("transfers"))
    group = -F.col("station_g_cd")
    enter = stations.select(F.col("station_cd").alias("src"), group.alias("dst"), F.lit(penalty / 2).alias("minutes"), F.lit(0.0).alias("km"), zero.alias("transfers"))
    leave = stations.select(group.alias("src"), F.col("station_cd").alias("dst"), F.lit(penalty / 2).alias("minutes"), F.lit(0.0).alias("km"), one.alias("transfers"))
    return both("a", "b").unionByName(both("b", "a")).unionByName(enter).unionByName(leave)


def shortest(edges: DataFrame, origins: DataFrame, rounds: int = 200, hops: int = 4) -> DataFrame:
    """node, minutes, transfers, km: least minutes from any origin, ties by transfers, then km.

    Each round relaxes the edges out of the nodes that the last one improved, `hops` times before its
    result is stored, so work follows the frontier; nothing is collected but the count that ends the loop.
    """
    edges = written(edges)
    zero = F.struct(F.lit(0.0).alias("minutes"), F.lit(0).cast("long").alias("transfers"), F.lit(0.0).alias("km"))
    best = origins.select(F.col("node"), zero.alias("d"), F.lit(True).alias("improved")).distinct()
    step = F.struct((F.col("d.minutes") + F.col("minutes")).alias("minutes"), (F.col("d.transfers") + F.col("transfers")).alias("transfers"), (F.col("d.km") + F.col("km")).alias("km"))
    for _ in range(rounds):
        best = written(best)
        front = best.where("improved").select("node", "d")
        if not front.limit(1).count():
            return best.select("node", "d.minutes", "d.transfers", "d.km")
        reached = None
        for _ in range(hops):
            front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), step.alias("d")).groupBy("node").agg(F.min("d").alias("d"))
            reached = front if reached is None else reached.unionByName(front)
        new = reached.groupBy("node").agg(F.min("d").alias("new"))
        improved = F.col("d").isNull() | F.coalesce(F.col("new") < F.col("d"), F.lit(False))
        best = best.drop("improved").join(new, "node", "full").select("node", F.coalesce(F.least("d", "new"), "d", "new").alias("d"), improved.alias("improved"))
    raise RuntimeError("paths did not settle")


def group_estimates(distances: DataFrame, stations: DataFrame) -> DataFrame:
    """Per station group the least (minutes, transfers, km) of its stations."""
    joined = stations.select("station_cd", "station_g_cd").join(distances.withColumnRenamed("node", "station_cd"), "station_cd")
    best = joined.groupBy("station_g_cd").agg(F.min(F.struct("minutes", "transfers", "km")).alias("d"))
    return best.select("station_g_cd", "d.minutes", "d.transfers", "d.km")
