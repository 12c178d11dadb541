"""Favourites, exclusions and memos, seen through the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators.grouping import GROUP
from lodeframe.sources.stored import written


def group_marks(listings: DataFrame, marks: DataFrame) -> DataFrame:
    """listing_id, is_favourite, is_excluded (any of the group), memos (how many); listings have `gk`."""
    folded = listings.select("listing_id", "gk").join(marks, "listing_id").groupBy("gk").agg(
        F.bool_or("is_favourite").alias("is_favourite"), F.bool_or("is_excluded").alias("is_excluded"), F.count("memo").alias("memos")
    )
    return listings.select("listing_id", "gk").join(folded, "gk", "left").select(
        "listing_id", F.coalesce("is_favourite", F.lit(False)).alias("is_favourite"), F.coalesce("is_excluded", F.lit(False)).alias("is_excluded"), F.coalesce("memos", F.lit(0)).cast("long").alias("memos")
    )


def flag_set(listings: DataFrame, marks: DataFrame, asked: DataFrame, flag: str, value: bool) -> DataFrame:
    """Marks after setting a flag of the asked listings; unsetting reaches their whole groups; empty marks go.

    listings: listing_id and gk or the columns of grouping.GROUP; asked may carry them too.
    """
    by = ["gk"] if "gk" in listings.columns else GROUP
    rows = asked.select("listing_id").distinct()
    if not value:
        # the asked offers' groups are few beside all offers: written, so that Spark sees their size and may send them to the offers
        here = asked if set(by) <= set(asked.columns) else listings.join(rows, "listing_id", "left_semi")
        rows = listings.join(written(here.select(*by).distinct()), by, "left_semi").select("listing_id").distinct()
    hit = rows.withColumn("_hit", F.lit(True))
    joined = marks.join(hit, "listing_id", "full" if value else "left")
    other = "is_excluded" if flag == "is_favourite" else "is_favourite"
    made = joined.select(
        "listing_id", F.when(F.col("_hit"), F.lit(value)).otherwise(F.coalesce(flag, F.lit(False))).alias(flag), F.coalesce(other, F.lit(False)).alias(other), "memo"
    )
    return made.where("is_favourite or is_excluded or memo is not null")
