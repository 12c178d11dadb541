"""Hazard levels of places: polygons keyed by the address master, overlap areas, values of blocks and towns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import address, enrich, spatial
from lodeframe.sources.stored import written

#: Least share of the master's blocks that must have a polygon, most of the graded keys without a value.
LEAST_COVERAGE, MOST_MISSING = 0.88, 0.005
VALUES = ("area_ratio", "rank_avg", "rank_max")
# fixed values: names that stand for no place, and the end of a block's name
NO_PLACE = ("", "‐", "-")
BLOCK = r"[0-9]+丁目$"


def place_key(prefecture: Column, city: Column, name: Column) -> Column:
    """The comparable name of a place of the boundary data, null for statistical remainders."""
    whole = address.comparable(F.concat(prefecture, city, F.trim(name)), F.lit(None).cast("string"))
    return F.when(~F.trim(name).isin(*NO_PLACE), whole)


def keyed_polygons(boundaries: DataFrame, master: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """boundaries (key, rings), master (normalized_key, town_key) -> key, town, known, rings.

    Places that the master lacks stay, under the town that their own name gives. No place at all, or fewer of
    the master's places than `least` of them, is an error: a key spelt otherwise would look like a safe place.
    """
    towns = master.where("normalized_key is not null").groupBy(F.col("normalized_key").alias("key")).agg(F.min("town_key").alias("_town"))
    rows = boundaries.where("key is not null")
    kept = rows.join(towns, "key", "left").select("key", F.coalesce("_town", F.regexp_replace("key", BLOCK, "")).alias("town"), F.col("_town").isNotNull().alias("known"), "rings")
    places, there = towns.count(), towns.join(rows.select("key"), "key", "left_semi").count()
    if not there or there < least * places:
        raise ValueError(f"polygons of {there} of {places} places of the master")
    return kept


def summed(overlaps: DataFrame, sizes: DataFrame, kinds: list[tuple[str, str, int | None]]) -> DataFrame:
    """overlaps (key, dataset, rank, area), sizes (key, town, size) -> key, hazard_type, values of every key and type, 0 where nothing overlaps.

    kinds: (hazard type, dataset, the only rank that counts or None). Several datasets of a type may lie on
    each other, so the larger value of each counts, not the sum.
    """
    kind = F.explode(F.array(*(F.struct(F.lit(t).alias("hazard_type"), F.lit(d).alias("dataset"), F.lit(only).cast("int").alias("only")) for t, d, only in kinds)))
    every = sizes.select("key", "town", "size", kind.alias("_k")).select("key", "town", "size", "_k.hazard_type", "_k.dataset")
    counts = overlaps.select("key", F.col("dataset").alias("_d"), "rank", "area", kind.alias("_k")).where("_d = _k.dataset and (_k.only is null or rank = _k.only)").select("key", "rank", "area", "_k.hazard_type", "_k.dataset")
    per = counts.groupBy("key", "hazard_type", "dataset").agg(F.sum("area").alias("_a"), F.sum(F.col("rank") * F.col("area")).alias("_w"), F.max("rank").cast("double").alias("_m"))
    joined = every.join(per, ["key", "hazard_type", "dataset"], "left")
    share = lambda x: F.when(F.col("size") > 0, F.coalesce(x, F.lit(0.0)) / F.col("size")).otherwise(0.0)
    most = F.coalesce("_m", F.lit(0.0))
    one = joined.select(
        "key", "town", "size", "hazard_type",
        F.round(F.least(share(F.col("_a")), F.lit(1.0)), 4).alias("area_ratio"), F.round(F.least(share(F.col("_w")), most), 4).alias("rank_avg"), most.alias("rank_max"),
    )
    return one.groupBy("key", "town", "size", "hazard_type").agg(*(F.max(v).alias(v) for v in VALUES))


def towns_of(blocks: DataFrame) -> DataFrame:
    """Rows of towns from those of their blocks: weighted by size, the largest rank; towns without size have none."""
    whole = F.sum("size")
    mean = lambda v: F.round(F.sum(F.col(v) * F.col("size")) / F.nullif(whole, F.lit(0.0)), 4).alias(v)
    made = blocks.groupBy("town", "hazard_type").agg(whole.alias("size"), mean("area_ratio"), mean("rank_avg"), F.max("rank_max").alias("rank_max"))
    return made.where("size > 0").select(F.col("town").alias("key"), F.lit("town").alias("level"), "hazard_type", *VALUES)


def levels(overlaps: DataFrame, sizes: DataFrame, kinds: list[tuple[str, str, int | None]]) -> DataFrame:
    """key, level (chome, town), hazard_type and values. A declared dataset without any overlap is an error: it would read as safe everywhere."""
    overlaps, sizes = written(overlaps), written(sizes)
    there = {r["dataset"] for r in overlaps.select("dataset").distinct().where(F.col("dataset").isin(*{k[1] for k in kinds})).collect()}
    if missing := sorted({k[1] for k in kinds} - there):
        raise ValueError(f"no overlap at all in {missing}")
    blocks = summed(overlaps, sizes, kinds)
    return blocks.select("key", F.lit("chome").alias("level"), "hazard_type", *VALUES).unionByName(towns_of(blocks))


def graded_levels(overlaps: DataFrame, sizes: DataFrame, hazard_type: str, excluded: int = 6, risky: tuple[int, ...] = (4, 5)) -> DataFrame:
    """Levels 1 (worst) to 5 as ranks 5 to 1, over the graded area; towns from the summed areas of their blocks; without graded area no row.

    overlaps (key, rank, area), where rank is the source's level.
    """
    known = overlaps.join(sizes.select("key", "town"), "key")
    both = known.select(F.explode(F.array(F.struct("key", F.lit("chome").alias("level")), F.struct(F.col("town").alias("key"), F.lit("town").alias("level")))).alias("k"), "rank", "area")
    made = enrich.graded(both.select("k.key", "k.level", "rank", "area"), ["key", "level"], "rank", "area", excluded, risky)
    return made.select("key", "level", F.lit(hazard_type).alias("hazard_type"), *VALUES)


def checked(found: DataFrame, sizes: DataFrame, partial: tuple[str, ...] = (), most_missing: float = MOST_MISSING) -> DataFrame:
    """found, if every type has a row for each place (types in `partial` may lack `most_missing` of them), else an error."""
    places = sizes.count() + sizes.groupBy("town").agg(F.sum("size").alias("s")).where("s > 0").count()
    for r in found.groupBy("hazard_type").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a type
        lacking = places - r["n"]
        if lacking < 0 or lacking > (most_missing * places if r["hazard_type"] in partial else 0):
            raise ValueError(f"{r['hazard_type']}: {r['n']} rows for {places} places")
    return found


def overlaps_of(keyed: DataFrame, shapes: DataFrame) -> DataFrame:
    """keyed (key, rings), shapes (dataset, rank, rings) -> key, dataset, rank, area."""
    return spatial.overlap_areas(keyed, shapes, "key", ["dataset", "rank"])


def sizes_of(keyed: DataFrame) -> DataFrame:
    """keyed (key, town, rings) -> key, town, size (area of the union of its parts)."""
    return keyed.select("key", "town").distinct().join(spatial.union_areas(keyed, "key").select("key", F.col("area").alias("size")), "key")
