"""Registered queries of reports, areas, routes and changes, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import address, grouping, must, pages, reports, snapshot, stations, stats, want
from lodeframe.plans.frames import listings, table
from lodeframe.plans.queries import FEATURES, GROUP_SQL, MUST_SQL, NUMERICS, SCORE_SQL, WANTED, query


@query(
    """, l AS (SELECT unnest([5.0, 10.0, 15.0, 20.0]) AS "limit"), k AS (SELECT property_family, count(*) AS rows, count(walk_minutes) AS known FROM listings GROUP BY 1)
    SELECT k.property_family, k.rows, k.known, l."limit", count(*) FILTER (WHERE x.walk_minutes <= l."limit") AS passed, round(count(*) FILTER (WHERE x.walk_minutes <= l."limit") / k.known, 4) AS share
    FROM k CROSS JOIN l JOIN listings x ON x.property_family = k.property_family GROUP BY 1, 2, 3, 4"""
)
def limit_shares(spark, sf_dir):
    return reports.limits_passed(listings(spark, sf_dir), ["property_family"], "walk_minutes", [5, 10, 15, 20])


@query(
    """, l AS (SELECT unnest([10.0, 20.0, 30.0]) AS worst), k AS (SELECT property_family, count(walk_minutes) AS known FROM listings GROUP BY 1)
    SELECT k.property_family, k.known, l.worst, count(*) FILTER (WHERE x.walk_minutes >= l.worst) AS stuck, round(count(*) FILTER (WHERE x.walk_minutes >= l.worst) / k.known, 4) AS share
    FROM k CROSS JOIN l JOIN listings x ON x.property_family = k.property_family GROUP BY 1, 2, 3"""
)
def worst_saturation(spark, sf_dir):
    return reports.saturation(listings(spark, sf_dir), ["property_family"], "walk_minutes", [10, 20, 30])


@query(
    """, v AS (SELECT site_id, CASE WHEN unit_id % 11 <> 0 THEN unit_id % 4 END AS v FROM listings)
    SELECT site_id, count(*) AS rows, count(v) AS resolved, count(*) FILTER (WHERE v = 0) AS zero, round(count(v) / count(*), 4) AS share, round(count(*) FILTER (WHERE v = 0) / nullif(count(v), 0), 4) AS zero_share FROM v GROUP BY 1"""
)
def hazard_resolution(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("v", F.when(F.col("unit_id") % 11 != 0, F.col("unit_id") % 4))
    return reports.resolution(rows, "site_id", "v")


@query(
    MUST_SQL
    + SCORE_SQL
    + """, i AS (SELECT 'GAS_CITY|GAS_LPG' AS code, CASE WHEN NOT detail_fetched THEN 'unknown' WHEN p1 > 0 THEN 'hit' ELSE 'miss' END AS status FROM points
        UNION ALL SELECT 'STOVE_IH', CASE WHEN NOT detail_fetched THEN 'unknown' WHEN p2 > 0 THEN 'hit' ELSE 'miss' END FROM points
        UNION ALL SELECT 'area_sqm', CASE WHEN p3 > 0 THEN 'hit' ELSE 'miss' END FROM points
        UNION ALL SELECT 'rent_total', CASE WHEN rent_total IS NULL THEN 'unknown' WHEN p4 > 0 THEN 'hit' ELSE 'miss' END FROM points
        UNION ALL SELECT 'walk_minutes', CASE WHEN walk_minutes IS NULL THEN 'unknown' WHEN p5 > 0 THEN 'hit' ELSE 'miss' END FROM points)
    SELECT code, status, count(*) AS n FROM i GROUP BY 1, 2"""
)
def score_breakdown(spark, sf_dir):
    scored = want.scored(listings(spark, sf_dir), FEATURES, NUMERICS)
    return stats.counted(reports.breakdown(scored, ["listing_id"]), ["code", "status"])


@query(
    """WITH c AS (SELECT s_suppkey AS city_id, s_nationkey AS prefecture, 'S' || s_suppkey AS name, CASE WHEN s_suppkey % 10 <> 0 THEN 'S' || (s_suppkey - s_suppkey % 10) END AS parent_city, CASE WHEN s_acctbal > 0 THEN 'v' || s_suppkey END AS value FROM supplier)
    SELECT city_id, name, value FROM c WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c w WHERE w.prefecture = c.prefecture AND w.parent_city = c.name)""",
    offers=False,
)
def area_targets(spark, sf_dir):
    key, name = F.col("s_suppkey"), lambda c: F.concat(F.lit("S"), c.cast("string"))
    suppliers = table(spark, sf_dir, "supplier")
    cities = suppliers.select(key.alias("city_id"), F.col("s_nationkey").alias("prefecture"), name(key).alias("name"), F.when(key % 10 != 0, name(key - key % 10)).alias("parent_city"), key.cast("string").alias("jis_code"))
    values = suppliers.where("s_acctbal > 0").select(key.alias("city_id"), F.concat(F.lit("v"), key.cast("string")).alias("value"))
    return address.rotated_areas(cities, values, [], by_code=False).select("city_id", "name", "value")


@query(
    """SELECT l_suppkey AS from_name, l_partkey % 50 AS to_name, l_linestatus AS line, CAST(min(l_quantity) AS INTEGER) AS least, CAST(max(l_quantity) AS INTEGER) AS most, count(*) AS samples FROM lineitem WHERE l_suppkey <> l_partkey % 50 GROUP BY 1, 2, 3""",
    offers=False,
)
def rail_segments(spark, sf_dir):
    legs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_name"), (F.col("l_partkey") % 50).alias("to_name"), F.col("l_linestatus").alias("line"), F.col("l_quantity").cast("int").alias("minutes"))
    return stations.segments(legs)


@query(
    """SELECT o, total_minutes, transfers, place FROM (SELECT l_suppkey AS o, CAST(l_quantity AS INTEGER) AS total_minutes, l_linenumber AS transfers, l_orderkey AS place, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_linenumber, l_orderkey) AS n FROM lineitem) WHERE n = 1""",
    offers=False,
)
def fastest_route(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("o"), F.col("l_quantity").cast("int").alias("total_minutes"), F.col("l_linenumber").alias("transfers"), F.col("l_orderkey").alias("place"))
    return stations.fastest(rows, "o")


@query(
    GROUP_SQL
    + """, before AS (SELECT dedup_key, listing_id AS old_id, coalesce(rent_total, price) AS old_cost FROM (
        SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY coalesce(rent_total, price) ASC NULLS LAST, feature_count DESC, site_priority, listing_id) AS n FROM listings WHERE dedup_key IS NOT NULL AND status = 'active' AND first_seen < '1997-01-01') WHERE n = 1)
    SELECT coalesce(b.dedup_key, c.dedup_key) AS dedup_key, old_id, representative_id AS new_id, coalesce(representative_cost < old_cost, false) AS is_cheaper FROM before b FULL JOIN chosen c ON b.dedup_key = c.dedup_key WHERE old_id IS DISTINCT FROM representative_id"""
)
def representative_change(spark, sf_dir):
    offers = listings(spark, sf_dir)
    before = grouping.representatives(offers.where("first_seen < '1997-01-01'"))
    return grouping.group_changes(before, grouping.representatives(offers)).select("dedup_key", "old_id", "new_id", "is_cheaper")


@query(
    """WITH e AS (SELECT event_id, user_id AS unit, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END AS rank, ts FROM events)
    SELECT event_id, unit, kind, rank FROM e WHERE ts >= TIMESTAMP '2024-01-20' AND (rank IS NULL OR rank <= 20) AND NOT EXISTS (SELECT 1 FROM e s WHERE s.ts < TIMESTAMP '2024-01-05' AND s.unit = e.unit AND s.kind = e.kind)""",
    offers=False,
)
def notification_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 40).alias("rank"), "ts")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return reports.notifications(rows.where(F.col("ts") >= at("2024-01-20")), rows.where(F.col("ts") < at("2024-01-05")), "unit", "kind", "rank", 20).select("event_id", "unit", "kind", "rank")


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS token, count(*) AS n FROM events GROUP BY 1, 2", offers=False)
def token_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("token"))
    half = lambda k: stats.counted(rows.where(F.col("event_id") % 2 == k), ["event_type", "token"])
    return stats.added_counts(half(0), half(1), ["event_type", "token"])


@query(
    MUST_SQL
    + """, m AS (SELECT property_family, count(*) AS rows, count(price) AS priced, count(*) FILTER (WHERE must <> 'fail') AS passing FROM judged GROUP BY 1)
    SELECT property_family, rows, passing, round(priced / rows, 6) AS share, priced / rows >= 0.8 AS enough FROM m"""
)
def resolved_gate(spark, sf_dir):
    rows = must.evaluated(listings(spark, sf_dir), WANTED)
    made = rows.groupBy("property_family").agg(F.count(F.lit(1)).alias("rows"), F.count_if("must_passes").alias("passing"), (F.count("price") / F.count(F.lit(1))).alias("share"))
    return made.select("property_family", "rows", "passing", F.round("share", 6).alias("share"), stats.gated(F.col("share"), least=0.8).alias("enough"))


@query(
    """SELECT property_family, site_id, count(*) AS n FROM listings WHERE status = 'active' AND price >= 20000 GROUP BY 1, 2"""
)
def site_facet(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("cost", F.col("price")).where("status = 'active'")
    kept = pages.filtered(rows, pages.ListingFilter(price_min=2))
    return stats.counted(kept, ["property_family", "site_id"])


@query(
    """WITH r AS (SELECT c_custkey, c_name AS a, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS b FROM customer) SELECT c_custkey, coalesce(b, a) AS label FROM r""",
    offers=False,
)
def detail_merge(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label"))
    details = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return snapshot.filled(customers, details, "c_custkey", ["label"])
