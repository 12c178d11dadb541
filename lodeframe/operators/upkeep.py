"""Upkeep of commutes, routes, dictionaries and masters; their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators.address import station_key
from lodeframe.operators.features import Entry
from lodeframe.operators.stations import variants


def looked_up(names: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, station_g_cd, status of names (columns name, prefecture): groups of the own prefecture first, else of all.

    stations: station_g_cd, station_name, prefecture. Of the name and its variants the first that has one group decides.
    """
    tried = names.select(*keys, "prefecture", F.posexplode(F.flatten(F.transform(text.without_note(F.col("name")), variants))).alias("_order", "_v"))
    # a name's groups are counted, not listed: a name that many stations share is one row, whatever their number
    counts = lambda rows, *by: rows.groupBy(*by).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.bool_or("_void").alias("_void"))
    code = F.col("station_g_cd")
    own = counts(stations.select(station_key(F.col("station_name")).alias("_key"), "prefecture", code.alias("_lo"), code.alias("_hi"), code.isNull().alias("_void")), "_key", "prefecture")
    number = F.when(F.col("_lo").isNull(), 0).when(F.col("_lo") == F.col("_hi"), 1).otherwise(2) + F.col("_void").cast("int")
    of = lambda rows, name: rows.select(*(c for c in ("_key", "prefecture") if c in rows.columns), F.struct(number.alias("n"), F.col("_lo").alias("g")).alias(name))
    found = tried.withColumn("_key", station_key(F.col("_v"))).join(of(own, "_own"), ["_key", "prefecture"], "left").join(of(counts(own, "_key"), "_all"), "_key", "left")
    found = found.withColumn("_chosen", F.coalesce("_own", "_all"))
    one = F.when(F.col("_chosen.n") == 1, F.struct("_order", F.col("_chosen.g").alias("g")))
    best = found.groupBy(*keys).agg(F.min(one).alias("b"), F.bool_or(F.coalesce(F.col("_chosen.n") > 1, F.lit(False))).alias("_many"))
    status = F.when(F.col("b").isNotNull(), "matched").when(F.col("_many"), "ambiguous").otherwise("unmatched")
    return best.select(*keys, F.col("b.g").alias("station_g_cd"), status.alias("status"))


def harvested(legs: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments between station groups with their least minutes, one row: legs, kept, dropped for a name).

    legs: from_name, to_name, line, minutes. A name that isn't one group is never guessed.
    """
    places = legs.select(F.explode(F.array("from_name", "to_name")).alias("name")).distinct().withColumn("prefecture", F.lit(None).cast(stations.schema["prefecture"].dataType))
    known = looked_up(places.withColumn("_id", F.col("name")), stations, ["_id"]).where("status = 'matched'").select("_id", "station_g_cd")
    end = lambda side: known.select(F.col("_id").alias(f"{side}_name"), F.col("station_g_cd").alias(f"{side}_g"))
    both = legs.join(end("from"), "from_name", "left").join(end("to"), "to_name", "left")
    whole = F.col("from_g").isNotNull() & F.col("to_g").isNotNull()
    moves = whole & (F.col("from_g") != F.col("to_g"))
    segments = both.where(moves).groupBy("from_g", "to_g", "line").agg(F.min("minutes").alias("minutes"))
    counts = both.agg(F.count(F.lit(1)).alias("legs"), F.count_if(moves).alias("kept"), F.count_if(~whole).alias("dropped"))
    return segments, counts


def commute_rows(asked: DataFrame, estimates: DataFrame) -> DataFrame:
    """station_g_cd, status, minutes, source: estimates of the asked groups, `no_route` where there is none."""
    made = asked.select("station_g_cd").distinct().join(estimates.select("station_g_cd", "minutes"), "station_g_cd", "left")
    return made.select("station_g_cd", F.when(F.col("minutes").isNull(), "no_route").otherwise("ok").alias("status"), "minutes", F.lit("estimate").alias("source"))


def saved_commutes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored after fresh estimates: measured rows are kept, all others replaced."""
    measured = stored.where("source <> 'estimate'")
    return measured.unionByName(fresh.join(measured.select("station_g_cd"), "station_g_cd", "left_anti").select(*stored.columns))


def restored_commutes(stored: DataFrame, routes: DataFrame) -> DataFrame:
    """stored with measured rows made anew from saved routes (station_g_cd, minutes, transfers): the fastest, then the fewest transfers."""
    best = routes.groupBy("station_g_cd").agg(F.min(F.struct("minutes", "transfers")).alias("b")).select("station_g_cd", F.lit("ok").alias("status"), F.col("b.minutes").alias("minutes"), F.lit("measured").alias("source"))
    return best.unionByName(stored.join(best.select("station_g_cd"), "station_g_cd", "left_anti").select(*best.columns))


def saved_routes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Routes of an origin are replaced as a whole."""
    return stored.join(fresh.select("origin").distinct(), "origin", "left_anti").unionByName(fresh.select(*stored.columns))


def missing_origins(groups: DataFrame, routes: DataFrame) -> DataFrame:
    """Station groups of which no route was fetched, those with the most lines first. groups: station_g_cd, lines."""
    return groups.join(routes.select(F.col("origin").alias("station_g_cd")).distinct(), "station_g_cd", "left_anti").orderBy(F.desc("lines"), "station_g_cd")


def segment_stats(segments: DataFrame) -> DataFrame:
    """One row: segments, ridden, walked."""
    return segments.agg(F.count(F.lit(1)).alias("segments"), F.count_if(~F.col("is_walk")).alias("ridden"), F.count_if("is_walk").alias("walked"))


def commute_summary(commutes: DataFrame) -> DataFrame:
    """Rows by status and source, least, mean and most minutes."""
    return commutes.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"), F.min("minutes").alias("least"), F.round(F.avg("minutes"), 2).alias("mean"), F.max("minutes").alias("most"))


def resolve_stats(matches: DataFrame, site: str) -> DataFrame:
    """Per site: offers with any name, offers with a matched one, names by status. matches: listing_id, status."""
    per = matches.groupBy(site, "listing_id").agg(F.bool_or(F.col("status") == "matched").alias("_hit"), *(F.count_if(F.col("status") == s).alias(f"_{s}") for s in ("matched", "ambiguous", "unmatched")))
    return per.groupBy(site).agg(F.count(F.lit(1)).alias("offers"), F.count_if("_hit").alias("resolved"), *(F.sum(f"_{s}").alias(s) for s in ("matched", "ambiguous", "unmatched")))


def busiest(stations: DataFrame, by: str) -> DataFrame:
    """The station group with the most lines of each key, ties by code. stations: station_g_cd, line_cd."""
    lines = stations.groupBy(by, "station_g_cd").agg(F.countDistinct("line_cd").alias("lines"))
    best = lines.groupBy(by).agg(F.min(F.struct((-F.col("lines")).alias("n"), "station_g_cd")).alias("b"))
    return best.select(by, F.col("b.station_g_cd").alias("station_g_cd"), (-F.col("b.n")).alias("lines"))


def names_of_groups(stations: DataFrame) -> DataFrame:
    """station_g_cd, names: each name of the group once, sorted."""
    return stations.groupBy("station_g_cd").agg(F.array_sort(F.collect_set("station_name")).alias("names"))


def next_cursor(rotated: DataFrame, code: str, size: int) -> Column:
    """Aggregate: where the next turn starts: after the last of a full turn, from the beginning (null) after a short one."""
    return F.when(F.count(F.lit(1)) >= size, F.max_by(F.col(code), F.col("_place")))


# --- dictionaries and masters -------------------------------------------------------------------


def dictionary(documents: list[dict[str, list[dict]]], families: dict[str, tuple[str, ...]]) -> list[Entry]:
    """Entries of parsed dictionary files: sections by family name or `common`; a section or code that comes twice is an error."""
    made: dict[str, Entry] = {}
    sections: set[str] = set()
    for document in documents:
        for section, entries in document.items():
            if section in sections:
                raise ValueError(f"section {section} repeats")
            if section != "common" and section not in families:
                raise ValueError(f"unknown section {section}")
            sections.add(section)
            for e in entries:
                if e["code"] in made:
                    raise ValueError(f"code {e['code']} repeats")
                made[e["code"]] = Entry(e["code"], tuple(e["patterns"]), tuple(e.get("negatives") or ()), () if section == "common" else families[section])
    return list(made.values())


def load_dictionary(spark: SparkSession, path: str, families: dict[str, tuple[str, ...]]) -> list[Entry]:
    """The dictionary of all YAML files of a folder, read by Spark so that any store will do; a few files of a few kilobytes."""
    import yaml

    files = spark.read.text(path, wholetext=True).collect()  # configuration, not data
    return dictionary([yaml.safe_load(r.value) or {} for r in files], families)


def dictionary_rows(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """code, pattern, place, negative, family: how a dictionary is stored."""
    rows = [(e.code, p, k, negative, f) for e in entries for negative, patterns in ((False, e.patterns), (True, e.negatives)) for k, p in enumerate(patterns) for f in (e.families or ("*",))]
    return spark.createDataFrame(rows, "code string, pattern string, place int, negative boolean, family string")


def dictionary_of(rows: DataFrame) -> list[Entry]:
    """The dictionary read back from its rows."""
    grouped = rows.groupBy("code").agg(
        F.array_sort(F.collect_set(F.when(~F.col("negative"), F.struct("place", "pattern")))).alias("p"), F.array_sort(F.collect_set(F.when(F.col("negative"), F.struct("place", "pattern")))).alias("n"),
        F.array_sort(F.collect_set(F.nullif(F.col("family"), F.lit("*")))).alias("f"),
    )
    return [Entry(r.code, tuple(x.pattern for x in r.p), tuple(x.pattern for x in r.n), tuple(r.f)) for r in grouped.orderBy("code").collect()]


def regions(spec: dict[str, list[int]], all_codes: set[int]) -> dict[int, str]:
    """code -> region; every code must be in exactly one region."""
    found: dict[int, str] = {}
    for name, codes in spec.items():
        for code in codes:
            if code in found:
                raise ValueError(f"{code} is in {found[code]} and {name}")
            found[code] = name
    if missing := all_codes - set(found):
        raise ValueError(f"in no region: {sorted(missing)}")
    return found


def coverage_identity(levels: DataFrame, points: DataFrame) -> DataFrame:
    """Per level: keys of the address master, keys with hazard values, keys with values that the master lacks."""
    a, b = points.select("key", "level").distinct(), levels.select("key", "level").distinct()
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), ["key", "level"], "full")
    return both.groupBy("level").agg(F.count("_a").alias("known"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("covered"), F.count_if(F.col("_a").isNull()).alias("strange"))


def synced_rates(stored: DataFrame, fresh: DataFrame, cities: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rates after an upsert by city_id and keys, city names that resolve to no single city with their rows, counts of inserted and updated keys).

    fresh: city (a name) and rate_value; cities: name, city_id. Several fresh rows of a key are one (the
    largest value); a name of several cities names none of them.
    """
    named = cities.groupBy(F.col("name").alias("city")).agg(F.min("city_id").alias("city_id"), F.max("city_id").alias("_other"))
    known = fresh.join(named.where("city_id = _other").drop("_other"), "city", "left")
    unresolved = known.where("city_id is null").groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    new = known.where("city_id is not null").groupBy("city_id", *keys).agg(F.max("rate_value").alias("rate_value"))
    both = stored.select("city_id", *keys, F.col("rate_value").alias("_old"), F.lit(True).alias("_there")).join(new.withColumn("_comes", F.lit(True)), ["city_id", *keys], "full")
    counts = both.agg(F.count_if(F.col("_comes") & F.col("_there").isNull()).alias("inserted"), F.count_if(F.col("_comes") & F.col("_there")).alias("updated"))
    return both.select("city_id", *keys, F.when(F.col("_comes"), F.col("rate_value")).otherwise(F.col("_old")).alias("rate_value")), unresolved, counts


def unit_prices(trades: DataFrame, kind: str, area: str) -> DataFrame:
    """trades of one kind with price per square metre; rows without a price or an area, or with an area of 0, are left out."""
    rows = trades.where((F.col("kind") == kind) & F.col("price").isNotNull() & (F.col(area) > 0))
    return rows.withColumn("unit_price", F.col("price") / F.col(area))
