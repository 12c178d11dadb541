"""Entity resolution: key, groups, representative, membership, change of representative, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions import text

KEY_VERSION = "v2"
PARTS = {
    "CHINTAI": ("layout", "area_sqm", "floor_num"),
    "MANSION_BUY": ("layout", "area_sqm", "floor_num"),
    "KODATE_BUY": ("land_area_sqm", "building_area_sqm", "layout"),
    "TOCHI_BUY": ("land_area_sqm",),
}


def fixed_area(value: Column) -> Column:
    """Two decimals, half to even on the decimal rendering."""
    return F.bround(value.cast("decimal(20,6)"), 2).cast("decimal(20,2)").cast("string")


def _part(name: str) -> Column:
    if name == "layout":
        return text.layout(F.col("layout"))
    return fixed_area(F.col(name)) if name.endswith("sqm") else F.col(name).cast("string")


def dedup_key() -> Column:
    """SHA-256 of version, family, address and the family's parts; null if any is missing, an error for an unknown family."""
    family = F.col("property_family")
    whole = F.raise_error(F.concat(F.lit("unknown family "), family)).cast("string")
    alike: dict[tuple[str, ...], list[str]] = {}
    for name, parts in PARTS.items():
        alike.setdefault(parts, []).append(name)
    for parts, names in alike.items():
        columns = [c for p in ("address", *parts) for c in (F.lit("|"), F.nullif(F.col("address_normalized"), F.lit("")) if p == "address" else _part(p))]
        whole = F.when(family.isin(names), F.concat(F.lit(KEY_VERSION + "|"), family, *columns)).otherwise(whole)  # null with any part
    return F.sha2(whole, 256)


def group_or_self() -> Column:
    """Joining key that makes "same group, or itself without one" an equi-join."""
    return F.coalesce(F.concat(F.lit("g:"), F.col("dedup_key")), F.concat(F.lit("l:"), F.col("listing_id").cast("string")))


#: Two hashes of the group's key, or of the offer's own id without one: never null, and cheap to sort and join by.
GROUP = ["_g", "_h"]


def group_columns() -> list[Column]:
    """The columns of GROUP."""
    key = group_or_self()
    return [F.xxhash64(key).alias("_g"), F.xxhash64(key, F.lit(1)).alias("_h")]


def _grouped(listings: DataFrame) -> DataFrame:
    return listings.select("*", *group_columns())


def _order(*payload: Column) -> Column:
    """The cheapest active member (total, else price; unknown last), then most features, then site priority, then id."""
    cost = F.coalesce("rent_total", "price")
    return F.struct(cost.isNull().alias("u"), cost.alias("cost"), (-F.col("feature_count")).alias("f"), F.col("site_priority").alias("p"), F.col("listing_id").alias("id"), *payload)


def representatives(listings: DataFrame) -> DataFrame:
    """dedup_key, representative_id, representative_cost of every group with an active member.

    A partial aggregate: members of a group never meet.
    """
    best = listings.where("dedup_key is not null and status = 'active'").groupBy("dedup_key").agg(F.min(_order()).alias("b"))
    return best.select("dedup_key", F.col("b.id").alias("representative_id"), F.col("b.cost").alias("representative_cost"))


def representative_rows(listings: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of the representatives, and member_count: they travel with the aggregate, so offers are read once and joined with nothing."""
    stands = (F.col("status") == "active") | F.col("dedup_key").isNull()
    whole = F.struct(*columns).alias("row")
    groups = _grouped(listings).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("member_count"), F.min(F.when(stands, _order(whole))).alias("b"))
    return groups.where("b is not null").select("b.row.*", "member_count")


def with_groups(listings: DataFrame) -> DataFrame:
    """listings and member_count (inactive members too), other_sites (active members elsewhere, sorted), is_representative.

    One aggregate and one join: the offers are read twice, not once per attribute.
    """
    rows = _grouped(listings)
    active = F.col("status") == "active"
    groups = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("member_count"), F.collect_set(F.when(active, F.col("site_id"))).alias("_sites"), F.min(F.when(active, _order()))["id"].alias("_best")
    )
    alone = F.col("dedup_key").isNull()
    others = F.array_sort(F.array_remove("_sites", F.col("site_id")))
    return rows.join(groups, GROUP).select(
        *listings.columns, "member_count", F.when(alone, F.array().cast("array<long>")).otherwise(others).alias("other_sites"),
        (alone | F.coalesce(F.col("_best") == F.col("listing_id"), F.lit(False))).alias("is_representative"),
    )


def membership(listings: DataFrame) -> DataFrame:
    """listing_id, member_count, other_sites, is_representative."""
    needed = ["listing_id", "dedup_key", "site_id", "site_priority", "rent_total", "price", "feature_count", "status"]
    return with_groups(listings.select(*needed)).select("listing_id", "member_count", "other_sites", "is_representative")


#: So many sites of a group make one piece of its text.
PIECE = 64


def _other_sites(own: str) -> Column:
    """The text of a group's sorted _sites without the one at the place _at (from 1; 0: nowhere): only the piece that holds it is made anew, the other _pieces are joined as they are."""
    before = F.floor((F.col("_at") - 1) / PIECE).cast("int")
    rest = F.array_join(F.array_remove(F.slice("_sites", before * PIECE + 1, PIECE), F.col(own)), ",")
    pieces = F.concat(F.slice("_pieces", 1, before), F.array(F.nullif(rest, F.lit(""))), F.slice("_pieces", before + 2, F.size("_pieces")))
    return F.when(F.col("_at") > 0, F.array_join(pieces, ",")).when(F.col("_at") == 0, F.array_join("_pieces", ",")).otherwise("")


def membership_texts(listings: DataFrame) -> DataFrame:
    """membership with other_sites as one text, sorted and joined by commas; empty for an offer without a site.

    The result grows with the square of a group. What it is made of does not: the sites of a group become text once, in pieces,
    and only id, site and two hashes of an offer travel. Offers meet their group sorted, so that texts of a group are written
    side by side, which compresses them; those without a key find no group.
    """
    rows = _grouped(listings.select("listing_id", "dedup_key", "site_id", "site_priority", "rent_total", "price", "feature_count", "status"))
    active = F.col("status") == "active"
    groups = rows.where("dedup_key is not null").groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("member_count"), F.sort_array(F.collect_set(F.when(active, F.col("site_id")))).alias("_sites"), F.min(F.when(active, _order()))["id"].alias("_best")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("_sites"), F.lit(1)), F.lit(PIECE))
    groups = groups.withColumn("_pieces", F.transform(starts, lambda k: F.array_join(F.slice("_sites", k, PIECE), ",")))
    met = rows.select(*GROUP, "listing_id", "site_id").join(groups.hint("merge"), GROUP, "left").withColumn("_at", F.array_position("_sites", F.col("site_id")))
    return met.select(
        "listing_id", F.coalesce("member_count", F.lit(1).cast("long")).alias("member_count"), _other_sites("site_id").alias("other_sites"),
        F.when(F.col("member_count").isNull(), True).otherwise(F.coalesce(F.col("_best") == F.col("listing_id"), F.lit(False))).alias("is_representative"),
    )


def group_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups whose representative changed: old and new, and whether the new one is strictly cheaper."""
    old = before.select("dedup_key", F.col("representative_id").alias("old_id"), F.col("representative_cost").alias("old_cost"))
    new = after.select("dedup_key", F.col("representative_id").alias("new_id"), F.col("representative_cost").alias("new_cost"))
    changed = old.join(new, "dedup_key", "full").where(~F.col("old_id").eqNullSafe(F.col("new_id")))
    return changed.withColumn("is_cheaper", F.coalesce(F.col("new_cost") < F.col("old_cost"), F.lit(False)))


def union_features(listings: DataFrame) -> DataFrame:
    """listing_id and the sorted feature codes of its whole group, inactive members included.

    Only distinct sets of codes travel: as many as the dictionary has, whatever the group's size.
    """
    rows = _grouped(listings.select("listing_id", "dedup_key", "feature_codes"))
    codes = rows.groupBy(*GROUP).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("feature_codes")))).alias("_codes"))
    return rows.join(codes, GROUP).select("listing_id", F.coalesce("_codes", F.array().cast("array<string>")).alias("feature_codes"))


def folded_flag(flag: Column) -> Column:
    """Aggregate of a three-valued flag: any true, else any false, else null."""
    return F.when(F.bool_or(flag), True).when(F.bool_or(~flag), False)


def group_stats(listings: DataFrame, by: str = "site_id") -> DataFrame:
    """Per site: listings, with a key, distinct keys, key rate, unique rate (0 without listings), groups shared with other sites.

    Offers are counted per site and key once; what follows works on those counts.
    """
    key, there = F.col("dedup_key"), F.col("dedup_key").isNotNull()
    pairs = listings.groupBy(by, "dedup_key").agg(F.count(F.lit(1)).alias("n"))
    sites = pairs.withColumn("sites", F.when(there, F.count(F.lit(1)).over(Window.partitionBy("dedup_key"))))  # a key has one row a site
    made = sites.groupBy(by).agg(
        F.sum("n").alias("listings"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("keyed"), F.count(key).alias("groups"), F.count_if(F.col("sites") > 1).alias("shared_groups")
    )
    return made.withColumn("key_rate", F.round(F.col("keyed") / F.col("listings"), 4)).withColumn(
        "unique_rate", F.round(F.when(F.col("keyed") == 0, 0.0).otherwise(F.col("groups") / F.nullif(F.col("keyed"), F.lit(0))), 4)
    )


def key_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Only rows whose key differs (null-safe)."""
    both = stored.select("listing_id", F.col("dedup_key").alias("old_key")).join(fresh.select("listing_id", "dedup_key"), "listing_id")
    return both.where(~F.col("old_key").eqNullSafe(F.col("dedup_key")))


def granularity(address: Column) -> Column:
    return F.when(address.isNull() | (address == ""), "none").when(address.contains("丁目"), "chome").otherwise("town")


def first_per_group(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def group_rows(members: DataFrame, by: str = "gk") -> DataFrame:
    """by, representative_id, representative_cost, member_count: groups without an active member have no representative."""
    best = members.groupBy(by).agg(F.count(F.lit(1)).alias("member_count"), F.min(F.when(F.col("status") == "active", _order())).alias("b"))
    return best.select(by, F.col("b.id").alias("representative_id"), F.col("b.cost").alias("representative_cost"), "member_count")


def synced_groups(stored: DataFrame, members: DataFrame, keys: DataFrame, number: int, by: str = "gk", buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The groups table after a batch, and the groups whose representative changed.

    stored: by, group_id, representative_id, representative_cost, member_count; members: all members of
    the groups named in `keys`, after the batch; groups not in keys stay as they are. A group keeps its id
    for as long as it has a member; a new one gets an id made of the batch's number and its place among
    the batch's new groups of its hash bucket, so that ids never meet and a batch run again gives the same ones.
    """
    keys = keys.select(by).distinct()
    held, kept = stored.join(keys, by, "left_semi"), stored.join(keys, by, "left_anti")
    now = group_rows(members.join(keys, by, "left_semi"), by).join(held.select(by, "group_id"), by, "left")
    place = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(by), F.lit(buckets))).orderBy(by))
    fresh = now.where("group_id is null").withColumn("group_id", F.lit(number).cast("long") * (1 << 40) + F.pmod(F.xxhash64(by), F.lit(buckets)) * (1 << 30) + place)
    after = now.where("group_id is not null").unionByName(fresh).select(*stored.columns)
    old = held.select(by, "group_id", F.col("representative_id").alias("old_id"), F.col("representative_cost").alias("old_cost"))
    new = after.select(by, F.col("group_id").alias("_id"), F.col("representative_id").alias("new_id"), F.col("representative_cost").alias("new_cost"), "member_count")
    changed = old.join(new, by, "full").where("member_count is not null and not (old_id <=> new_id)")
    changed = changed.select(by, F.coalesce("group_id", "_id").alias("group_id"), "old_id", "old_cost", "new_id", "new_cost", "member_count")
    return kept.unionByName(after), changed.withColumn("is_cheaper", F.coalesce(F.col("new_cost") < F.col("old_cost"), F.lit(False)))
