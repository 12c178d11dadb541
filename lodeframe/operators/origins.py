"""Stations that routes start from: names to search by, what is fetched already, whether an answer is the station that was meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators import address, rows


def origin_stations(stations: DataFrame, groups: DataFrame, prefectures: DataFrame) -> DataFrame:
    """station_g_cd, station_name, prefecture, alias_names of some groups: the name of the smallest code, and all names of the group.

    stations: station_cd, station_g_cd, station_name, pref_cd; prefectures: pref_cd, prefecture.
    """
    kept = stations.join(groups.select("station_g_cd").distinct(), "station_g_cd", "left_semi")
    made = kept.groupBy("station_g_cd").agg(F.min(F.struct("station_cd", "station_name", "pref_cd")).alias("r"), F.array_sort(F.collect_set("station_name")).alias("alias_names"))
    return made.select("station_g_cd", "r.station_name", "r.pref_cd", "alias_names").join(prefectures.select("pref_cd", "prefecture"), "pref_cd", "left").select("station_g_cd", "station_name", "prefecture", "alias_names")


def search_words(name: Column, prefecture: Column) -> Column:
    """A name as it is searched for: with its prefecture, since equal names elsewhere would be taken silently."""
    return F.coalesce(F.concat(name, F.lit("（"), F.nullif(prefecture, F.lit("")), F.lit("）")), name)


def fetched(routes: DataFrame, destination: int, on: str, at: str) -> DataFrame:
    """Origins that have a route to the destination under these conditions: what a resumed run skips."""
    return routes.where((F.col("destination") == destination) & (F.col("depart_on") == F.lit(on)) & (F.col("depart_at") == F.lit(at))).select("origin").distinct()


def with_source(commutes: DataFrame, destination: int, source: str) -> DataFrame:
    """Origins whose commute to the destination comes from a source: estimates must not replace measured ones."""
    return commutes.where((F.col("destination") == destination) & (F.col("source") == source)).select("origin").distinct()


def kept_estimates(estimates: DataFrame, commutes: DataFrame, destination: int, measured: str) -> DataFrame:
    """Estimates (origin, ...) of origins that have no measured commute."""
    return estimates.join(with_source(commutes, destination, measured), "origin", "left_anti")


def is_meant(label: Column, names: Column) -> Column:
    """Whether the station that a route page names is one of a group's names, notes and spellings aside; null without a label."""
    plain = lambda c: address.station_key(F.try_element_at(text.without_note(c), F.lit(-1)))
    return F.when(label.isNotNull(), F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: plain(n) == plain(label)))


def checked_routes(routes: DataFrame, origins: DataFrame) -> DataFrame:
    """routes (station_g_cd, origin_label, asked_on, answered_on, ...) with `fault`: another station, another day, or null.

    A page that answers for another station or day is no answer, however well it reads.
    """
    known = routes.join(origins.select("station_g_cd", "alias_names"), "station_g_cd", "left")
    fault = F.when(~F.coalesce(is_meant(F.col("origin_label"), F.col("alias_names")), F.lit(False)), "station").when(~F.col("asked_on").eqNullSafe(F.col("answered_on")), "date")
    return known.select(*routes.columns, fault.alias("fault"))


def segment_prefectures(offers: DataFrame, prefectures: DataFrame, region: list[int] | None) -> DataFrame:
    """Codes whose stations resolve the names of route segments: those of the region, else those that active offers lie in.

    Never the whole country, where names are no longer unique, and with a region not only where offers are.
    """
    if region is not None:
        return prefectures.where(F.col("code").isin(sorted(region))).select("code").distinct()
    return rows.prefectures_of(offers, prefectures)
