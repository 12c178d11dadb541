"""The composed scoring view, city resolution, and stored scores and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import numbers, text
from lodeframe.operators import address, enrich, grouping
from lodeframe.operators.grouping import GROUP
from lodeframe.operators.snapshot import last_of_each
from lodeframe.sources.stored import written

#: family -> (what a market rate's segment is, what is compared with it)
MARKET = {
    "CHINTAI": (lambda: F.col("layout"), lambda: F.col("rent_total").cast("double")),
    "MANSION_BUY": (lambda: F.lit("AREA_SQM"), lambda: numbers.ratio(F.col("price").cast("double"), F.col("area_sqm"))),
    "KODATE_BUY": (lambda: F.lit("FLOOR_SQM"), lambda: numbers.ratio(F.col("price").cast("double"), F.col("building_area_sqm"))),
}


def by_family(place: int) -> Column:
    """The segment (0) or the numerator (1) of a row's family; null for others, land among them."""
    whole = F.lit(None)
    for family, made in MARKET.items():
        whole = F.when(F.col("property_family") == family, made[place]()).otherwise(whole)
    return whole


def group_access(near: DataFrame, commutes: DataFrame) -> DataFrame:
    """The columns of GROUP, walk_minutes, commute_minutes: both from one station of the group where one has both, else each at its least.

    near: the columns of GROUP, station_g_cd, walk. commutes: station_g_cd, ride (only those found).
    A station's least walk in a group is found first, so that offers are not dealt by station.
    """
    pairs = near.groupBy(*GROUP, "station_g_cd").agg(F.min("walk").alias("walk")).join(commutes, "station_g_cd", "left")
    best = enrich.best_pairs(pairs, GROUP, "walk", "ride", "station_g_cd")
    return best.select(*GROUP, F.col("walk").alias("walk_minutes"), F.col("ride").alias("commute_minutes"))


def group_hazards(members: DataFrame, hazards: DataFrame, towns: DataFrame) -> DataFrame:
    """The columns of GROUP and the hazard columns of the finest address in the group: blocks before towns, then the smallest listing_id.

    hazards: key, level and values, one row a key. towns: normalized_key, town_key of the address master.
    Addresses are looked up once each, and the offers meet that table.
    """
    values = [c for c in hazards.columns if c not in ("key", "level")]
    places = members.select("address_normalized").where("address_normalized is not null").distinct()
    keyed = places.join(towns, F.col("address_normalized") == F.col("normalized_key"), "left")
    keys = keyed.select("address_normalized", F.explode(F.array_distinct(F.array_compact(F.array("address_normalized", "town_key")))).alias("key"))
    one = F.min(F.struct((F.col("level") != "chome").alias("coarse"), F.struct(*values).alias("v")))
    known = written(keys.join(hazards, "key").groupBy("address_normalized").agg(one.alias("_b")))
    found = members.select("listing_id", *GROUP, "address_normalized").join(known, "address_normalized")
    order = F.struct("_b.coarse", "listing_id", "_b.v")
    return found.groupBy(*GROUP).agg(F.min(order).alias("b")).select(*GROUP, "b.v.*")


def scoring_view(offers: DataFrame, near: DataFrame, commutes: DataFrame, hazards: DataFrame, towns: DataFrame, rates: DataFrame, cities: DataFrame, asked: Column | None = None) -> DataFrame:
    """Everything that judging and notifying an offer reads: access, hazards, market rate, city, and what its group knows.

    asked: which offers (by id, site, city); what a group knows comes from all its members all the same.
    near: station_g_cd, walk and listing_id, or the columns of grouping.GROUP, which spares a join.
    """
    members = offers.select("*", *grouping.group_columns())
    rows = (members if asked is None else members.where(asked)).drop("walk_minutes", "detail_fetched")
    if asked is not None:  # only their groups count
        members = members.join(written(rows.select(*GROUP).distinct()), GROUP, "left_semi")
    stops = near if set(GROUP) <= set(near.columns) else near.join(members.select("listing_id", *GROUP), "listing_id")
    if asked is not None and stops is near:
        stops = near.join(members.select(*GROUP).distinct(), GROUP, "left_semi")
    known = members.groupBy(*GROUP).agg(F.bool_or("detail_fetched").alias("detail_fetched"))
    rows = rows.join(known, GROUP).join(group_access(stops, written(commutes)), GROUP, "left").join(group_hazards(members, hazards, towns), GROUP, "left")
    # lookups are written: by their size Spark sends them to the offers, which need not be dealt by the few values of a city or segment
    latest = written(enrich.latest(rates, ["property_family", "city_id", "segment"], "period"))
    rows = rows.withColumn("segment", by_family(0)).join(latest, ["property_family", "city_id", "segment"], "left").join(written(cities), "city_id", "left")
    return rows.withColumn("market_rate_ratio", numbers.ratio(by_family(1), F.col("rate_value"))).drop(*GROUP)


def group_rights(members: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of GROUP, leasehold: whether any member says in any of the named attributes that the land is leased; no, if some say it is owned; null if none can be read.

    members: the columns of GROUP, attributes (map of texts).
    """
    said = members.select(*GROUP, F.explode(F.array(*(F.try_element_at("attributes", F.lit(k)) for k in keys))).alias("_r")).where("_r is not null")
    return said.groupBy(*GROUP).agg(grouping.folded_flag(text.leasehold(F.col("_r"))).alias("leasehold"))


def group_build_condition(members: DataFrame, raw: str, saved: str) -> DataFrame:
    """The columns of GROUP, build_condition: a member's text counts before its stored flag; one member with a condition is enough.

    members: the columns of GROUP, attributes (map of texts; the stored flag is true or false).
    """
    words, flag = F.try_element_at("attributes", F.lit(raw)), F.try_element_at("attributes", F.lit(saved))
    stored = F.when(flag == "true", True).when(flag == "false", False)
    one = F.when(F.coalesce(words, F.lit("")) != "", text.build_condition(words)).otherwise(stored)
    return members.where(words.isNotNull() | flag.isNotNull()).groupBy(*GROUP).agg(grouping.folded_flag(one).alias("build_condition"))


def group_stations(members: DataFrame, near: DataFrame, commutes: DataFrame) -> DataFrame:
    """The columns of GROUP, stations: what a notice lists of all members' matched stations, nearest first: struct(station_g_cd, name, walk, ride).

    A station counts once, with its least walk and its first name; an unknown walk comes last.
    near: listing_id or the columns of GROUP, station_g_cd, name, walk, status; commutes: station_g_cd, ride.
    """
    found = near.where("status = 'matched'")
    if not set(GROUP) <= set(near.columns):
        found = members.select(*GROUP, "listing_id").join(found, "listing_id")
    one = found.groupBy(*GROUP, "station_g_cd").agg(F.min("name").alias("name"), F.min("walk").alias("walk"))
    one = one.join(written(commutes.groupBy("station_g_cd").agg(F.max("ride").alias("ride"))), "station_g_cd", "left")
    order = F.struct(F.col("walk").isNull().alias("u"), "walk", "name", "station_g_cd", "ride")
    listed = one.groupBy(*GROUP).agg(F.sort_array(F.collect_list(order)).alias("s"))  # the stations around one home
    return listed.select(*GROUP, F.transform("s", lambda x: F.struct(x["station_g_cd"].alias("station_g_cd"), x["name"].alias("name"), x["walk"].alias("walk"), x["ride"].alias("ride"))).alias("stations"))


def with_group_knowledge(view: DataFrame, offers: DataFrame, near: DataFrame, commutes: DataFrame, rights: list[str], raw: str, saved: str, utility: Column) -> DataFrame:
    """view (listing_id, ...) and stations, leasehold, build_condition, feature_codes and utility of each offer's whole group.

    Every fold is a partial aggregate by group, joined once by the group's key; utility is estimated from the group's
    features, as `utility` says (see numbers.estimated_utility). offers: the columns of grouping, attributes among them.
    A view or near that has the columns of grouping.GROUP needs no join by listing_id.
    """
    members = offers.select("listing_id", "feature_codes", "attributes", *grouping.group_columns())
    codes = members.groupBy(*GROUP).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("feature_codes")))).alias("feature_codes"))
    codes = codes.withColumn("feature_codes", F.coalesce("feature_codes", F.array().cast("array<string>")))
    rows = view.drop("feature_codes")
    if not set(GROUP) <= set(view.columns):
        rows = rows.join(members.select("listing_id", *GROUP), "listing_id")
    rows = rows.join(codes, GROUP)
    for known in (group_stations(members, near, commutes), group_rights(members, rights), group_build_condition(members, raw, saved)):
        rows = rows.join(known, GROUP, "left")
    return rows.withColumn("utility", utility).drop(*GROUP)


def resolved_city(texts: DataFrame, cities: DataFrame, column: str, scope: list[str]) -> DataFrame:
    """texts and prefecture, city_id of an address.

    An address that starts with a prefecture takes its longest city name, or none; another takes the
    longest name that exists once in the prefectures of the scope. cities: prefecture, name, city_id.
    """
    named = cities.select("prefecture", address.city_key(F.col("name")).alias("name"), "city_id")
    order = F.struct((-F.length("name")).alias("l"), "name", "prefecture", "city_id")
    own = named.groupBy("prefecture").agg(F.array_sort(F.collect_list(order)).alias("_own"))
    once = named.where(F.col("prefecture").isin(scope)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("prefecture").alias("prefecture"), F.min("city_id").alias("city_id")).where("n = 1")
    unique = once.agg(F.array_sort(F.collect_list(order)).alias("_unique")).withColumn("_k", F.lit(1))  # the names of a country
    key = address.city_key(F.col(column))
    start = own.select(F.col("prefecture").alias("_p"), "_own")
    heads = own.agg(F.collect_list("prefecture").alias("_heads")).withColumn("_k", F.lit(1))
    rows = texts.withColumn("_key", key).withColumn("_k", F.lit(1)).join(heads, "_k").join(unique, "_k")
    rows = rows.withColumn("_p", F.get(F.filter("_heads", lambda p: F.col("_key").startswith(p)), F.lit(0))).join(start, "_p", "left")
    hit = lambda names: F.get(F.filter(names, lambda c: F.col("_key").contains(c["name"])), F.lit(0))
    inside, fallback = hit(F.col("_own")), hit(F.col("_unique"))
    return rows.select(*texts.columns, F.when(F.col("_p").isNotNull(), F.col("_p")).otherwise(fallback["prefecture"]).alias("prefecture"), F.when(F.col("_p").isNotNull(), inside["city_id"]).otherwise(fallback["city_id"]).alias("city_id"))


def matched_cities(areas: DataFrame, cities: DataFrame) -> DataFrame:
    """slug, city_id, how: areas of a source (slug, name, jis_code) by public code first, then by name; a conflict of the two is rejected."""
    by_code = cities.select(F.col("jis_code").alias("_j"), F.col("city_id").alias("_a"), F.col("name").alias("_n"))
    by_name = cities.groupBy(address.city_key(F.col("name")).alias("_m")).agg(F.min("city_id").alias("_b"), F.count(F.lit(1)).alias("_c"))
    rows = areas.join(by_code, F.col("jis_code") == F.col("_j"), "left").join(by_name, address.city_key(F.col("name")) == F.col("_m"), "left")
    one = F.when(F.col("_c") == 1, F.col("_b"))
    conflict = F.col("_a").isNotNull() & (address.city_key(F.col("_n")) != address.city_key(F.col("name")))
    how = F.when(conflict, "conflict").when(F.col("_a").isNotNull(), "code").when(one.isNotNull(), "name").otherwise("unmatched")
    return rows.select("slug", F.when(~conflict | F.col("_a").isNull(), F.coalesce("_a", one)).alias("city_id"), how.alias("how"))


def replaced_rows(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the rows of the keys that come anew, and the new rows: how the features of offers are saved."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*stored.columns))


def upserted_scores(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The score table after new scores: one row for each pattern and offer, the largest of several new ones."""
    return replaced_rows(stored, last_of_each(fresh.select(*stored.columns), ["pattern", "listing_id"]), ["pattern", "listing_id"])


def saved_scores(scored: DataFrame) -> DataFrame:
    """Rows of the score table: pattern, listing_id, score, must, config_hash, breakdown (canonical JSON of its items)."""
    rounded = F.transform("score_items", lambda x: F.struct(x["code"].alias("code"), x["kind"].alias("kind"), F.round(x["weight"] * x["s"], 4).alias("points"), x["status"].alias("status"), x["weight"].alias("weight")))
    return scored.select("pattern", "listing_id", "score", "must", "config_hash", F.to_json(rounded).alias("breakdown"))


def orphan_scores(scores: DataFrame, patterns: list[str]) -> DataFrame:
    """Patterns that have scores but no definition any more, and how many."""
    return scores.where(~F.col("pattern").isin(patterns)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def regroup_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: offers, with a key, groups, offers whose key changed (both sides: listing_id, dedup_key)."""
    both = after.select("listing_id", "dedup_key").join(before.select("listing_id", F.col("dedup_key").alias("_old")), "listing_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("offers"), F.count("dedup_key").alias("keyed"), F.countDistinct("dedup_key").alias("groups"), F.count_if(~F.col("dedup_key").eqNullSafe(F.col("_old"))).alias("changed")
    )


def group_ranks(ranked: DataFrame) -> DataFrame:
    """listing_id and the rank that its whole group shows: that of its ranked member. ranked: listing_id, rank and gk or the columns of grouping.GROUP."""
    by = ["gk"] if "gk" in ranked.columns else grouping.GROUP
    best = ranked.groupBy(*by).agg(F.min("rank").alias("group_rank"))
    return ranked.select("listing_id", *by).join(best, by).select("listing_id", "group_rank")


def ranking_items(scores: DataFrame, hashes: dict[str, str]) -> DataFrame:
    """scores and `stale`: made under another configuration than the pattern has now, or by a pattern that is gone."""
    known = F.create_map(*(F.lit(x) for pair in hashes.items() for x in pair)) if hashes else F.create_map().cast("map<string,string>")
    return scores.withColumn("stale", ~F.col("config_hash").eqNullSafe(F.element_at(known, F.col("pattern"))))


# --- prices out of line -------------------------------------------------------------------------

#: Ratios to the market rate under which a price is out of line, for bought homes and for the rest.
LOW_BUY, LOW = 0.10, 0.20
BUY = ("MANSION_BUY", "KODATE_BUY")


def threshold() -> Column:
    return F.when(F.col("property_family").isin(*BUY), LOW_BUY).otherwise(LOW)


def out_of_line(limit: float | None = None) -> Column:
    """Whether the price is far below the market; not judged, so false, without a rate."""
    return F.coalesce(F.col("market_rate_ratio") < (threshold() if limit is None else F.lit(limit)), F.lit(False))


def anomaly_text(site: Column, title: Column) -> Column:
    """One line of a run's report, in the terms of the family: what isn't known is left out. Its words are fixed values."""
    buy = F.col("property_family").isin(*BUY)
    money = F.when(buy, F.concat(F.lit("価格"), F.format_number("price", 0), F.lit("円"))).otherwise(F.concat(F.lit("月額"), F.format_number("rent_total", 0), F.lit("円")))
    plain = lambda c: F.col(c).cast("double").cast("string")
    size = F.when(F.col("property_family") == "KODATE_BUY", F.concat(F.lit("延床"), plain("building_area_sqm"), F.lit("㎡"))).otherwise(F.concat(plain("area_sqm"), F.lit("㎡")))
    named = F.concat(F.lit("「"), F.left(F.nullif(title, F.lit("")), F.lit(24)), F.lit("」"))
    head = F.concat(F.coalesce(site, F.lit("?")), F.lit(" id="), F.col("listing_id").cast("string"))
    return F.concat_ws(" / ", head, money, size, F.nullif(F.col("layout"), F.lit("")), F.when(F.col("market_rate_ratio").isNotNull(), F.concat(F.lit("相場比"), F.format_string("%.3f", F.round("market_rate_ratio", 3)))), named)
