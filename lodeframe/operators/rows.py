"""Rows that reports, notices and pages are made of: composed from stored tables, ordered for display."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import numbers
from lodeframe.operators import reports
from lodeframe.sources.params import Param


def ranking_frame(scores: DataFrame, offers: DataFrame, marks: DataFrame) -> DataFrame:
    """What every page starts from: scores with their offers and what the group marked. marks: listing_id, is_favourite, is_excluded, memos."""
    flags = marks.select("listing_id", "is_favourite", "is_excluded", "memos")
    joined = scores.join(offers, "listing_id").join(flags, "listing_id", "left")
    return joined.withColumns({"is_favourite": F.coalesce("is_favourite", F.lit(False)), "is_excluded": F.coalesce("is_excluded", F.lit(False)), "memos": F.coalesce("memos", F.lit(0).cast("long"))})


def notice_rows(ranked: DataFrame, events: DataFrame, caveats: Column) -> DataFrame:
    """One row per event with all that a message shows: heading, price, summary, rank."""
    heading, body = reports.price_field(F.lit(""), F.lit(""))
    rows = events.join(ranked.withColumn("caveats", caveats), "listing_id")
    line = reports.summary_line(F.col("property_family") == "TOCHI_BUY")
    return rows.select("listing_id", "event", heading.alias("heading"), body.alias("body"), line.alias("summary"), "rank", "score")


def members_of_groups(offers: DataFrame) -> DataFrame:
    """gk, place, listing_id, status, cost of every member, inactive ones too: active first, then cheapest, then id."""
    cost = F.coalesce("rent_total", "price")
    order = F.struct((F.col("status") != "active").alias("gone"), cost.isNull().alias("u"), cost.alias("cost"), "listing_id", "status")
    listed = offers.groupBy("gk").agg(F.array_sort(F.collect_list(order)).alias("m"))  # the offers of one home on all sites
    return listed.select("gk", F.posexplode("m").alias("place", "x")).select("gk", "place", "x.listing_id", "x.status", "x.cost")


def stations_of_groups(members: DataFrame, near: DataFrame, commutes: DataFrame) -> DataFrame:
    """gk, station_g_cd, walk, ride: every station of a group with its least walk and its commute, where there is one."""
    best = members.select("listing_id", "gk").join(near, "listing_id").groupBy("gk", "station_g_cd").agg(F.min("walk").alias("walk"))
    return best.join(commutes.select("station_g_cd", "ride"), "station_g_cd", "left").select("gk", "station_g_cd", "walk", "ride")


def with_members(groups: DataFrame, offers: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Groups that still have a member."""
    return groups.join(offers.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")


def prefectures_of(offers: DataFrame, prefectures: DataFrame) -> DataFrame:
    """Codes of the prefectures that active offers lie in. prefectures: prefecture, code."""
    return offers.where("status = 'active'").select("prefecture").distinct().join(prefectures, "prefecture").select("code")


def groups_in(stations: DataFrame, codes: DataFrame) -> DataFrame:
    """Station groups of some prefectures."""
    return stations.join(codes.select(F.col("code").alias("prefecture")), "prefecture", "left_semi").select("station_g_cd").distinct()


def excluded_gate(rows: DataFrame, excluded: Column, most: float = 0.05) -> DataFrame:
    """One row: how many rows a source check excludes, their share, whether that is few enough."""
    made = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(excluded).alias("excluded"))
    share = F.col("excluded") / F.nullif(F.col("rows"), F.lit(0))
    return made.select("rows", "excluded", F.round(share, 6).alias("share"), (share <= most).alias("few"))


def run_rows(events: DataFrame, run: Column) -> DataFrame:
    """Per run: when it began and ended, its steps, whether one failed. events: at, step, failed."""
    return events.groupBy(run.alias("run")).agg(F.min("at").alias("began"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("steps"), F.bool_or("failed").alias("failed"))


def city_master(places: DataFrame, variants: dict[str, str]) -> DataFrame:
    """prefecture, name, parent_city, jis_code: one row a code, spellings unified, wards with the city they belong to.

    places: prefecture, city, ward, jis_code.
    """
    plain = lambda c: F.translate(c, "".join(variants), "".join(variants.values()))
    rows = places.select("prefecture", plain(F.col("city")).alias("city"), plain(F.col("ward")).alias("ward"), "jis_code")
    one = rows.groupBy("jis_code").agg(F.min(F.struct("prefecture", "city", "ward")).alias("r")).select("jis_code", "r.*")
    return one.select("prefecture", F.concat("city", F.coalesce("ward", F.lit(""))).alias("name"), F.when(F.col("ward").isNotNull(), F.col("city")).alias("parent_city"), "jis_code")


def tariff_fingerprint() -> str:
    """Changes with any tariff, demand or efficiency that estimates depend on."""
    used = [numbers.CITY_GAS, numbers.LPG, numbers.POWER_BASIC, numbers.POWER, numbers.POWER_EXTRA, numbers.ALL_ELECTRIC, numbers.HEAT_RISE, numbers.EFFICIENCY, {k: vars(v) for k, v in numbers.HOUSEHOLDS.items()}]
    return hashlib.sha256(json.dumps(used, sort_keys=True, default=str).encode()).hexdigest()


def load_params(path: str) -> dict[str, list[Param]]:
    """Site -> parameters, from a YAML file of a few kilobytes; an unknown field is an error."""
    import yaml

    raw: dict[str, list[dict[str, Any]]] = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return {site: [Param(**{k: tuple(v) if isinstance(v, list) else v for k, v in one.items()}) for one in params] for site, params in raw.items()}


def condition_names(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """code, name of conditions, for display."""
    return spark.createDataFrame(entries, "code string, name string")


def memo_set(marks: DataFrame, asked: DataFrame) -> DataFrame:
    """marks after new memos (listing_id, memo): an empty one removes, others keep their flags; marks without anything go."""
    b = asked.select("listing_id", F.nullif(F.trim("memo"), F.lit("")).alias("_memo"), F.lit(True).alias("_hit"))
    made = marks.join(b, "listing_id", "full")
    kept = made.select(
        "listing_id", F.coalesce("is_favourite", F.lit(False)).alias("is_favourite"), F.coalesce("is_excluded", F.lit(False)).alias("is_excluded"), F.when(F.col("_hit"), F.col("_memo")).otherwise(F.col("memo")).alias("memo")
    )
    return kept.where("is_favourite or is_excluded or memo is not null")
