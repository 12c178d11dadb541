"""The city master from lists of municipalities and of designated cities with their wards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import stats

CITY = "市"


def longest_prefix(rows: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """rows and `prefix`: the longest of the prefixes that the name starts with and isn't itself, null without one.

    A name's own prefixes are exploded and joined by equality: no pair of a name and a foreign prefix is made.
    Repeated prefixes count once, repeated rows stay.
    """
    names = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    own = names.select("_name", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_name") - 1, F.lit(1)))).alias("_n")).where(F.col("_n") < F.length("_name"))
    own = own.select("_name", "_n", F.left("_name", F.col("_n")).alias("_p"))
    known = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("_p")).distinct()
    best = own.join(known, "_p").groupBy("_name").agg(F.max(F.struct("_n", "_p"))["_p"].alias(prefix))
    return rows.join(best, rows[name] == best["_name"], "left").drop("_name")


def city_rows(municipalities: DataFrame, designated: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Both (jis_code, prefecture, city) -> jis_code, prefecture, city_name, parent_city, canonical_name.

    designated lists wards by their full name, and the cities themselves, which are left out. A ward belongs
    to the longest city whose name its own starts with; a ward of no city, a code or a full name that comes
    twice is an error. overrides: code -> canonical name.
    """
    plain = municipalities.select("jis_code", "prefecture", F.col("city").alias("city_name"), F.lit(None).cast("string").alias("parent_city"), F.col("city").alias("canonical_name"))
    rest = designated.join(municipalities.select("prefecture", "city").distinct(), ["prefecture", "city"], "left_anti")
    parents = municipalities.where(F.col("city").endswith(CITY)).select(F.col("city").alias("parent_city"))
    split = longest_prefix(rest, "city", parents, "parent_city")
    lost = F.raise_error(F.concat(F.lit("no city of the ward "), F.col("prefecture"), F.lit(" "), F.col("city"))).cast("string")
    wards = split.withColumn("parent_city", F.coalesce("parent_city", lost))
    wards = wards.select("jis_code", "prefecture", F.substring("city", F.length("parent_city") + 1, F.length("city")).alias("city_name"), "parent_city", F.col("city").alias("canonical_name"))
    named = F.create_map(*(F.lit(x) for pair in (overrides or {"": ""}).items() for x in pair))
    rows = plain.unionByName(wards).withColumn("canonical_name", F.coalesce(F.try_element_at(named, F.col("jis_code")), F.col("canonical_name")))
    return stats.unique_or_fail(stats.unique_or_fail(rows, ["jis_code"]), ["prefecture", "canonical_name"]).select("jis_code", "prefecture", "city_name", "parent_city", "canonical_name")


def indexed(municipalities: DataFrame) -> DataFrame:
    """code, prefecture: the two-digit code of each prefecture, from the codes of its municipalities; two codes of one prefecture are an error."""
    found = municipalities.groupBy("prefecture").agg(F.min(F.left("jis_code", F.lit(2))).alias("code"), F.max(F.left("jis_code", F.lit(2))).alias("_other"))
    two = F.raise_error(F.concat(F.lit("two codes of "), F.col("prefecture"))).cast("string")
    return found.select(F.when(F.col("code") == F.col("_other"), F.col("code")).otherwise(two).alias("code"), "prefecture")
