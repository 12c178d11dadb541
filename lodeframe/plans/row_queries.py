"""Registered queries of composed rows, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import grouping, rows, want
from lodeframe.plans.frames import listings, table
from lodeframe.plans.queries import FEATURES, MUST_SQL, NUMERICS, SCORE_SQL, query
from lodeframe.plans.text_queries import spelt


@query(
    MUST_SQL + SCORE_SQL
    + """ SELECT listing_id, score, site_id, layout, l_tax >= 0.07 AS is_favourite, l_discount >= 0.09 AS is_excluded, CASE WHEN l_tax >= 0.07 OR l_discount >= 0.09 THEN 1 ELSE 0 END AS memos FROM scores
    JOIN (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS listing_id, l_tax, l_discount FROM lineitem) USING (listing_id)"""
)
def ranking_frame(spark, sf_dir):
    from lodeframe.plans.frames import listing_id

    offers = listings(spark, sf_dir)
    scores = want.scored(offers, FEATURES, NUMERICS).select("listing_id", "score")
    lines = table(spark, sf_dir, "lineitem").select(listing_id(), (F.col("l_tax") >= 0.07).alias("is_favourite"), (F.col("l_discount") >= 0.09).alias("is_excluded"), F.lit(1).cast("long").alias("memos"))
    marks = lines.where("is_favourite or is_excluded")
    return rows.ranking_frame(scores, offers.select("listing_id", "site_id", "layout"), marks).select("listing_id", "score", "site_id", "layout", "is_favourite", "is_excluded", "memos")


@query(
    """ SELECT listing_id, 'new' AS event, CASE WHEN property_family = 'CHINTAI' THEN '月額' ELSE '価格' END AS heading,
    CASE WHEN property_family = 'TOCHI_BUY' THEN concat_ws(' / ', CASE WHEN land_area_sqm IS NULL THEN '土地面積不明' ELSE format('土地{:.1f}㎡', land_area_sqm) END, CASE WHEN walk_minutes IS NULL THEN '徒歩不明' ELSE '徒歩' || walk_minutes || '分' END, '⚠注意')
        ELSE concat_ws(' / ', layout, format('{:.1f}㎡', area_sqm), '築' || age_years || '年', CASE WHEN walk_minutes IS NULL THEN '徒歩不明' ELSE '徒歩' || walk_minutes || '分' END, '⚠注意') END AS summary FROM listings WHERE status = 'active'"""
)
def notice_rows(spark, sf_dir):
    offers = listings(spark, sf_dir).withColumn("commute_minutes", F.lit(None).cast("int")).withColumn("rank", F.lit(None).cast("long")).withColumn("score", F.lit(0.0))
    events = offers.where("status = 'active'").select("listing_id", F.lit("new").alias("event"))
    return rows.notice_rows(offers, events, F.array(F.lit("注意"))).select("listing_id", "event", "heading", "summary")


@query(
    """, gk AS (SELECT *, coalesce('g:' || dedup_key, 'l:' || listing_id) AS gk, coalesce(rent_total, price) AS cost FROM listings)
    SELECT gk, CAST(row_number() OVER (PARTITION BY gk ORDER BY status <> 'active', cost IS NULL, cost, listing_id) - 1 AS INTEGER) AS place, listing_id, status, cost FROM gk"""
)
def members_of_groups(spark, sf_dir):
    return rows.members_of_groups(listings(spark, sf_dir).withColumn("gk", grouping.group_or_self()))


@query(
    """, near AS (SELECT coalesce('g:' || dedup_key, 'l:' || listing_id) AS gk, site_id % 50 AS st, CASE WHEN unit_id % 6 <> 0 THEN unit_id % 15 + 1 END AS walk FROM listings),
    com AS (SELECT s_suppkey % 50 AS st, min(s_nationkey) + 10 AS ride FROM supplier WHERE s_acctbal > 0 GROUP BY 1), b AS (SELECT gk, st, min(walk) AS walk FROM near GROUP BY 1, 2) SELECT gk, st AS station_g_cd, walk, ride FROM b LEFT JOIN com USING (st)"""
)
def stations_of_groups(spark, sf_dir):
    members = listings(spark, sf_dir).withColumn("gk", grouping.group_or_self())
    near = members.select("listing_id", (F.col("site_id") % 50).alias("station_g_cd"), F.when(F.col("unit_id") % 6 != 0, F.col("unit_id") % 15 + 1).alias("walk"))
    commutes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy((F.col("s_suppkey") % 50).alias("station_g_cd")).agg((F.min("s_nationkey") + 10).alias("ride"))
    return rows.stations_of_groups(members, near, commutes)


@query(""" SELECT DISTINCT dedup_key FROM listings WHERE dedup_key IN (SELECT dedup_key FROM listings WHERE status = 'active')""")
def groups_with_members(spark, sf_dir):
    offers = listings(spark, sf_dir)
    return rows.with_members(offers.where("dedup_key is not null").select("dedup_key").distinct(), offers.where("status = 'active'"))


@query("SELECT DISTINCT s_suppkey AS station_g_cd FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)", offers=False)
def stations_where_offers_are(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("prefecture"), F.col("n_nationkey").alias("code"))
    people = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("code"))
    offers = people.select("prefecture", F.when(F.col("c_acctbal") > 9000, "active").otherwise("sold").alias("status"))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_g_cd"), F.col("s_nationkey").alias("prefecture"))
    return rows.groups_in(places, rows.prefectures_of(offers, names))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE l_discount >= 0.1) AS excluded, round(count(*) FILTER (WHERE l_discount >= 0.1) / count(*), 6) AS share, count(*) FILTER (WHERE l_discount >= 0.1) / count(*) <= 0.05 AS few FROM lineitem", offers=False)
def excluded_gate(spark, sf_dir):
    return rows.excluded_gate(table(spark, sf_dir, "lineitem"), F.col("l_discount") >= 0.1)


@query("SELECT user_id AS run, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS steps, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1", offers=False)
def run_log(spark, sf_dir):
    made = rows.run_rows(table(spark, sf_dir, "events").select(F.col("ts").alias("at"), "user_id", (F.col("event_type") == "error").alias("failed")), F.col("user_id"))
    return made.select("run", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("began", "ended")), "steps", "failed")


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS jis_code, 'P' || s_nationkey AS prefecture, 'ケ' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '区' || s_suppkey ELSE '' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'ケ' || s_nationkey END AS parent_city FROM supplier""",
    offers=False,
)
def city_master(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    places = table(spark, sf_dir, "supplier").select(spelt("P", nation).alias("prefecture"), spelt("ヶ", nation).alias("city"), F.when(key % 3 == 0, spelt("区", key)).alias("ward"), key.cast("string").alias("jis_code"))
    return rows.city_master(places.unionByName(places), {"ヶ": "ケ", "ヵ": "カ"})


@query(
    """WITH m AS (SELECT o_orderkey AS listing_id, o_orderpriority = '1-URGENT' AS fav, CASE WHEN o_orderstatus = 'F' THEN 'old' END AS memo FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), a AS (SELECT o_orderkey AS listing_id, CASE WHEN o_custkey % 2 = 0 THEN 'new' END AS memo FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM'))
    SELECT listing_id, coalesce(fav, false) AS is_favourite, CASE WHEN a.listing_id IS NOT NULL THEN a.memo ELSE m.memo END AS memo FROM m FULL JOIN a USING (listing_id) WHERE coalesce(fav, false) OR CASE WHEN a.listing_id IS NOT NULL THEN a.memo ELSE m.memo END IS NOT NULL""",
    offers=False,
)
def memo_marks(spark, sf_dir):
    orders, level = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    marks = orders.where(level.isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("listing_id"), (level == "1-URGENT").alias("is_favourite"), F.lit(False).alias("is_excluded"), F.when(F.col("o_orderstatus") == "F", "old").alias("memo"))
    asked = orders.where(level.isin("2-HIGH", "3-MEDIUM")).select(F.col("o_orderkey").alias("listing_id"), F.when(F.col("o_custkey") % 2 == 0, " new ").otherwise(" ").alias("memo"))
    return rows.memo_set(marks, asked).drop("is_excluded")
