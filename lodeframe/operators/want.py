"""Weighted, normalised scores with explicit missing values, and deterministic ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions.numbers import share_of_range
from lodeframe.sources.stored import written

#: metric -> whether lower is better
METRICS = {
    "rent_total": True, "living_cost": True, "price": True, "monthly_cost": True, "area_sqm": False,
    "building_area_sqm": False, "land_area_sqm": False, "age_years": True, "walk_minutes": True,
    "commute_minutes": True, "flood_rank_avg": True, "flood_area_ratio": True, "landslide_area_ratio": True,
    "liquefaction_rank_avg": True, "market_rate_ratio": True,
}


@dataclass(frozen=True)
class Feature:
    """Full points if any of the codes is there; unknown (0 points, weight stays) before details are fetched."""

    codes: tuple[str, ...]
    weight: float

    @property
    def key(self) -> str:
        return "|".join(self.codes)


@dataclass(frozen=True)
class Numeric:
    """Points by the place between worst and best; a missing value leaves the weights unless on_missing is "zero"."""

    metric: str
    weight: float
    best: float
    worst: float
    on_missing: str = "renormalize"


ITEM = "struct<code:string,kind:string,weight:double,s:double,status:string,missing:boolean,value:double>"


@dataclass(frozen=True)
class Part:
    """One item as plain columns: what it adds, whether it counts, how it is reported."""

    code: str
    kind: str
    weight: float
    s: Column
    status: Column
    missing: Column
    value: Column

    @property
    def struct(self) -> Column:
        fields = {"code": F.lit(self.code), "kind": F.lit(self.kind), "weight": F.lit(float(self.weight)), "s": self.s, "status": self.status, "missing": self.missing, "value": self.value}
        return F.struct(*(c.alias(k) for k, c in fields.items())).cast(ITEM)


def _feature(item: Feature) -> Part:
    hit = F.arrays_overlap(F.coalesce("feature_codes", F.array().cast("array<string>")), F.array(*map(F.lit, item.codes)))
    known = F.coalesce(F.col("detail_fetched"), F.lit(False))
    status = F.when(~known, "unknown").when(hit, "hit").otherwise("miss")
    return Part(item.key, "feature", item.weight, F.when(known & hit, 1.0).otherwise(0.0), status, F.lit(False), F.lit(None).cast("double"))


def _numeric(item: Numeric) -> Part:
    value = F.col(item.metric).cast("double")
    s = F.when(value.isNull(), 0.0).otherwise(share_of_range(value, item.best, item.worst))
    status = F.when(value.isNull(), "unknown").when(s > 0, "hit").otherwise("miss")
    return Part(item.metric, "numeric", item.weight, s, status, value.isNull() & F.lit(item.on_missing != "zero"), value)


def parts(features: list[Feature], numerics: list[Numeric]) -> list[Part]:
    """All items, features by key, then metrics by name: the order in which points are added."""
    return [*map(_feature, sorted(features, key=lambda f: f.key)), *map(_numeric, sorted(numerics, key=lambda n: n.metric))]


def items(features: list[Feature], numerics: list[Numeric]) -> Column:
    made = [p.struct for p in parts(features, numerics)]
    return F.array(*made) if made else F.array().cast(f"array<{ITEM}>")


def score(found: list[Part]) -> Column:
    """100 x points / weights of the items that aren't missing, 0 without any; rounded once."""
    present = lambda x: sum((F.when(p.missing, 0.0).otherwise(x(p)) for p in found), F.lit(0.0))
    points, weights = present(lambda p: F.lit(float(p.weight)) * p.s), present(lambda p: F.lit(float(p.weight)))
    return F.round(F.when(weights == 0, 0.0).otherwise(points * 100.0 / F.nullif(weights, F.lit(0.0))), 3)


def unknown_count(found: list[Part]) -> Column:
    return sum((F.when(p.status == "unknown", 1).otherwise(0) for p in found), F.lit(0))


def top_hits(found: Column, most: int = 3) -> Column:
    """Codes of the items with the most points, ties by code."""
    hits = F.transform(F.filter(found, lambda x: x["weight"] * x["s"] > 0), lambda x: F.struct((-x["weight"] * x["s"]).alias("p"), x["code"].alias("code")))
    return F.transform(F.slice(F.array_sort(hits), 1, most), lambda x: x["code"])


def scored(views: DataFrame, features: list[Feature], numerics: list[Numeric]) -> DataFrame:
    """views and score_items, score, unknown_items; each from plain columns, so that unused ones cost nothing."""
    found = parts(features, numerics)
    return views.select("*", items(features, numerics).alias("score_items"), score(found).alias("score"), unknown_count(found).alias("unknown_items"))


def top(scores: DataFrame, most: int) -> DataFrame:
    """The first `most` rows by score, then listing_id, with their rank: no row beyond them is ranked."""
    first = scores.orderBy(F.desc("score"), "listing_id").limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "listing_id")).cast("long"))


def ranked(scores: DataFrame, pattern: list[str], eligible: Column) -> DataFrame:
    """rank (long) by score, then listing_id, among eligible rows of a pattern; null for the others.

    Scores are stored once. Eligible rows are sorted by ranges, and a rank is a place within a range plus the
    sizes of the ranges before it, so no score and no pattern is ever sorted by one task. Rows travel whole
    in that one shuffle: nothing is joined back.
    """
    stored = written(scores.withColumn("_eligible", F.coalesce(eligible, F.lit(False))))
    order = [*(F.col(k) for k in pattern), F.desc("score"), F.col("listing_id")]
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored.where("_eligible").drop("_eligible").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()))  # range * 2^33 + place within it
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = placed.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("_index", F.col("_before") + place)
    if pattern:
        starts = index.groupBy(*pattern).agg(F.min("_index").alias("_start"))  # a row for each pattern
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in pattern]
        index = index.join(F.broadcast(starts.select(*(F.col(k).alias(f"_{k}") for k in pattern), "_start")), same)
    else:
        index = index.withColumn("_start", F.lit(0))
    ranks = index.select(*scores.columns, (F.col("_index") - F.col("_start") + 1).cast("long").alias("rank"))
    return ranks.unionByName(stored.where("not _eligible").select(*scores.columns, F.lit(None).cast("long").alias("rank")))
