"""Statistics: rank correlation, percentiles, coverage, counters, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.sources.stored import written


def cumulated(counts: DataFrame, groups: list[str], value: str, weight: str, name: str) -> DataFrame:
    """counts and `name`: the sum of the weights of smaller values of the group.

    Values are sorted by ranges over all groups; a sum is one within its range plus the group's sums of
    the ranges before it. A range has about as many rows as any other, whatever the groups' sizes.
    """
    spark = counts.sparkSession
    order = [*groups, value]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(counts.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*groups, "_part").agg(F.sum(weight).alias("_sum"))  # a row for each range that a group has
    before = sums.select(*groups, "_part", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*groups).orderBy("_part"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(weight).over(earlier(Window.partitionBy("_part", *groups).orderBy(value))), F.lit(0))
    return placed.withColumn("_within", within).join(before, [*groups, "_part"]).select(*counts.columns, (F.col("_before") + F.col("_within")).alias(name))


def average_ranks(counts: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """1-based ranks of the values of counts (groups, value, _n), ties averaged."""
    made = cumulated(counts, groups, value, "_n", "_before")
    return made.select(*groups, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def spearman(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group; null under two pairs or where a side is constant.

    Pairs of values are counted once; ranks come from those counts, and moments are weighted by them.
    """
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_n"))
    ranks = lambda c, name: average_ranks(pairs.groupBy(*groups, c).agg(F.sum("_n").alias("_n")), groups, c, name)
    both = pairs.join(ranks(x, "_rx"), [*groups, x]).join(ranks(y, "_ry"), [*groups, y])
    n, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    middle = (F.col("_all") + 1) / 2  # ranks of n rows average to this
    sizes = pairs.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    made = both.join(sizes, groups).groupBy(*groups).agg(
        F.sum("_n").alias("pairs"), F.sum(n * (rx - middle) * (ry - middle)).alias("_xy"), F.sum(n * (rx - middle) * (rx - middle)).alias("_xx"), F.sum(n * (ry - middle) * (ry - middle)).alias("_yy")
    )
    shared = F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("_yy")), F.lit(0.0))
    return made.select(*groups, "pairs", F.when((F.col("pairs") >= 2) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.round(shared, 6)).alias("spearman"))


def placed_values(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, _n, _before (rows of smaller values), _all (rows of the group)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias(value)).agg(F.count(F.lit(1)).alias("_n"))
    made = cumulated(counts, groups, value, "_n", "_before")
    return made.join(made.groupBy(*groups).agg(F.sum("_n").alias("_all")), groups)


def at_place(place: Column, value: Column) -> Column:
    """Aggregate over placed_values: the value at a 0-based place of the group's sorted rows."""
    return F.min(F.when(F.col("_before") + F.col("_n") > place, value))


def nearest_percentile(rows: DataFrame, groups: list[str], value: str, ratios: list[float]) -> DataFrame:
    """Values at place min(int(n * ratio), n - 1) of the sorted values, without interpolation."""
    at = lambda r: F.least(F.floor(F.col("_all") * r), F.col("_all") - 1)
    return placed_values(rows, groups, value).groupBy(*groups).agg(*(at_place(at(r), F.col(value)).alias(f"p{round(r * 100)}") for r in ratios))


def interpolated(ratio: float, value: Column) -> Column:
    """Aggregate over placed_values: the percentile between its two neighbouring places."""
    exact = (F.col("_all") - 1) * F.lit(ratio)
    low, high = at_place(F.floor(exact), value), at_place(F.ceil(exact), value)
    part = F.max(exact - F.floor(exact))
    return low + (high - low) * part


def quartiles(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Interpolated quartiles, rounded to whole numbers half up."""
    made = placed_values(rows, groups, value).groupBy(*groups)
    return made.agg(*(F.round(interpolated(p, F.col(value).cast("double")), 0).cast("long").alias(f"q{round(p * 100)}") for p in (0.25, 0.5, 0.75)))


def coverage(rows: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Rows and non-null values of each column."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"has_{c}") for c in columns))


def site_coverage(rows: DataFrame, site: str, features: DataFrame, columns: list[str], key: str = "listing_id") -> DataFrame:
    """Per site: offers, offers with details, offers with features, their least, mean and largest number of features, and non-null values of each column.

    Mean, least and most are over the offers that have features, 0 where none has: a site that is read but
    not wired up has details and no features. rows: key, site, detail_fetched, columns; features: key, code.
    """
    per = features.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.select(key, site, "detail_fetched", *columns).join(per, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.groupBy(site).agg(
        F.count(F.lit(1)).alias("listings"), F.count_if("detail_fetched").alias("detail_fetched"), F.count("_n").alias("with_features"), F.coalesce(F.avg("_n"), F.lit(0.0)).alias("features_avg"),
        zero(F.min("_n")).alias("features_min"), zero(F.max("_n")).alias("features_max"), *(F.count(c).alias(f"filled_{c}") for c in columns),
    )


def counted(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Counts by key, most frequent first if limited, ties by key."""
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return made.orderBy(F.desc("n"), *keys).limit(most) if most else made


def added_counts(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Additive upsert of counters."""
    return stored.unionByName(batch).groupBy(*keys).agg(F.sum("n").alias("n"))


def share(condition: Column) -> Column:
    """Share of rows where a condition is true, null without rows."""
    return F.count_if(condition) / F.nullif(F.count(F.lit(1)), F.lit(0))


def gated(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Whether a statistic meets its gate; null stays null."""
    held = F.lit(True)
    if least is not None:
        held &= value >= least
    if most is not None:
        held &= F.abs(value) <= most
    return F.when(value.isNotNull(), held)


def unique_or_fail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, or an error once a key occurs twice."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    checked = many.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{keys} not unique"))).otherwise(True)).where("_ok").drop("_n", "_ok")
    return rows.join(checked, keys)
