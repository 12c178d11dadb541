"""Enrichment joins: latest value, fallback keys, pivots, best pairs, coverage of hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import stats


def latest(rates: DataFrame, keys: list[str], period: str, *ties: str) -> DataFrame:
    """The row of the newest period of each cell (ties by the named columns): a partial aggregate, no window."""
    rest = [c for c in rates.columns if c not in (*keys, period, *ties)]
    order = F.struct(period, *(F.col(t) for t in ties), *rest)
    newest = rates.groupBy(*keys).agg(F.max(order).alias("r"))
    return newest.select(*keys, *(F.col("r")[c].alias(c) for c in (period, *ties, *rest)))


def market_ratio(listings: DataFrame, rates: DataFrame, keys: list[str], value: Column, rate: str = "rate_value") -> DataFrame:
    """listings, their latest rate and value / rate; without a value the rate is still given."""
    joined = listings.join(rates, keys, "left")
    return joined.withColumn("market_rate_ratio", value / F.nullif(F.col(rate), F.lit(0)))


def with_fallback(rows: DataFrame, levels: DataFrame, fine: str, coarse: str, key: str, columns: list[str]) -> DataFrame:
    """Values of the fine key, else all of the coarse one; `level_used` tells which, null for neither."""
    take = lambda tag, on: levels.select(F.col(key).alias(on), F.struct(*columns).alias(f"_{tag}"))
    found = rows.join(take("fine", fine), fine, "left").join(take("coarse", coarse), coarse, "left")
    used = F.coalesce("_fine", "_coarse")
    level = F.when(F.col("_fine").isNotNull(), "fine").when(F.col("_coarse").isNotNull(), "coarse")
    return found.select(*rows.columns, *(used[c].alias(c) for c in columns), level.alias("level_used"))


def pivoted(levels: DataFrame, keys: list[str], cells: dict[str, tuple[Column, str]]) -> DataFrame:
    """Long to wide: name -> (condition, value column), the maximum of each cell, null without rows."""
    return levels.groupBy(*keys).agg(*(F.max(F.when(on, F.col(value))).alias(name) for name, (on, value) in cells.items()))


def area_weighted(parts: DataFrame, keys: list[str], rank: str, area: str, total: str) -> DataFrame:
    """area_ratio, rank_avg (weighted over the whole area, at most the largest rank), rank_max.

    A key without whole area has no row of numbers but 0 for ratio and average.
    """
    whole = F.max(total)
    share = lambda x: F.when(whole > 0, x / F.nullif(whole, F.lit(0.0))).otherwise(0.0)
    return parts.groupBy(*keys).agg(
        F.round(F.least(share(F.sum(area)), F.lit(1.0)), 4).alias("area_ratio"),
        F.round(F.least(share(F.sum(F.col(rank) * F.col(area))), F.max(rank).cast("double")), 4).alias("rank_avg"),
        F.max(rank).cast("double").alias("rank_max"),
    )


def graded(parts: DataFrame, keys: list[str], level: str, area: str, excluded: int = 6, risky: tuple[int, ...] = (4, 5)) -> DataFrame:
    """Levels 1 to 5 turned into ranks 5 to 1; the excluded level counts neither above nor below; no graded area, no row."""
    rank = F.lit(6) - F.col(level)
    valid = parts.where(F.col(level).between(1, 5) & (F.col(level) != excluded)).groupBy(*keys)
    made = valid.agg(
        F.sum(area).alias("_a"), F.sum(F.when(rank.isin(*risky), F.col(area)).otherwise(0.0)).alias("_r"), F.sum(rank * F.col(area)).alias("_w"), F.max(rank).cast("double").alias("rank_max")
    )
    kept = made.where("_a > 0")
    return kept.select(*keys, F.round(F.col("_r") / F.col("_a"), 4).alias("area_ratio"), F.round(F.col("_w") / F.col("_a"), 4).alias("rank_avg"), "rank_max")


def best_pairs(pairs: DataFrame, key: str | list[str], walk: str, ride: str, place: str) -> DataFrame:
    """The pair with the least walk + ride of each key, ties by walk, then place: both numbers come from one place.

    A key without a complete pair keeps its least ride alone, else its least walk alone.
    """
    sums = F.struct((F.col(walk) + F.col(ride)).alias("total"), F.col(walk).alias("walk"), F.col(place).alias("place"), F.col(ride).alias("ride"))
    keys = [key] if isinstance(key, str) else key
    best = pairs.groupBy(*keys).agg(
        F.min(F.when(F.col(walk).isNotNull() & F.col(ride).isNotNull(), sums)).alias("b"), F.min(ride).alias("_ride"), F.min(walk).alias("_walk")
    )
    return best.select(
        *keys, F.col("b.place").alias(place), F.coalesce("b.walk", F.when(F.col("b").isNull(), F.col("_walk"))).alias(walk),
        F.coalesce("b.ride", F.when(F.col("b").isNull(), F.col("_ride"))).alias(ride),
    )


def preferred(first: DataFrame, second: DataFrame, keys: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Full outer merge of two cell tables: the first one's value where it has one, and which was taken."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), names[0]).otherwise(names[1]).alias("basis"))


def median_with_fallback(rows: DataFrame, keys: list[str], value: str, primary: Column, least: int = 10, within: tuple[float, float] | None = None) -> DataFrame:
    """Median of the primary rows if there are enough, else of all rows if enough, else no row; one outside `within` is an error."""
    twice = rows.select(*keys, F.col(value).alias("_v"), F.explode(F.when(primary, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("_first"))
    made = stats.placed_values(twice, [*keys, "_first"], "_v").groupBy(*keys, "_first").agg(stats.interpolated(0.5, F.col("_v")).alias("rate_value"), F.max("_all").alias("samples"))
    enough = made.where(F.col("samples") >= least)
    best = enough.groupBy(*keys).agg(F.max(F.struct("_first", "rate_value", "samples")).alias("b"))
    rate = F.col("b.rate_value")
    if within:
        rate = F.when(rate.between(*within), rate).otherwise(F.raise_error(F.lit("median out of range")).cast("double"))
    return best.select(*keys, rate.alias("rate_value"), F.when(F.col("b._first"), "primary").otherwise("all").alias("basis"), F.col("b.samples").alias("samples"))


def longest_contained(texts: DataFrame, names: DataFrame, scope: str, text: str, name: str) -> DataFrame:
    """texts and the longest name of their scope that the text contains (first by name on ties), null without one.

    The names of a scope become one array, longest first, that texts meet by an equi-join; Spark broadcasts
    it if its size allows. Equal texts stay rows of their own.
    """
    order = F.struct((-F.length(name)).alias("l"), F.col(name).alias("n"))
    scopes = names.where(F.col(name).isNotNull()).groupBy(scope).agg(F.array_sort(F.collect_set(order))["n"].alias("_names"))
    hit = F.get(F.filter("_names", lambda n: F.col(text).contains(n)), F.lit(0))
    return texts.join(scopes, scope, "left").select(*texts.columns, hit.alias(name))
