"""What must not grow faster than the input: plans of single steps, and their results on small frames."""

import re

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators import grouping, spatial, stations, upkeep
from lodeframe.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(capsys, rows):
    capsys.readouterr()
    rows.explain(True)
    return capsys.readouterr().out


def test_stations_of_one_name_are_counted_not_listed(spark, capsys):
    stations = spark.createDataFrame([(k, "S", k % 2) for k in range(50)] + [(90, "T", 0), (91, "T", 1), (None, "U", 0)], "station_g_cd long, station_name string, prefecture int")
    names = spark.createDataFrame([(1, "S", 0), (2, "T駅", 1), (3, "T", 7), (4, "V", 0), (5, "U", 0), (6, "T", None)], "id int, name string, prefecture int")
    made = upkeep.looked_up(names, stations, ["id"])
    assert {r.id: (r.station_g_cd, r.status) for r in made.collect()} == {1: (None, "ambiguous"), 2: (91, "matched"), 3: (None, "ambiguous"), 4: (None, "unmatched"), 5: (None, "matched"), 6: (None, "ambiguous")}
    assert "collect_" not in plan(capsys, made)


def test_a_date_is_read_by_two_patterns(spark, capsys):
    rows = spark.createDataFrame([("1799年1月",), ("1800年1月",), ("2200年12月",), ("2201年1月",), ("12000年5月",), ("2000年0月",), ("2000 年 3",)], "t string")
    made = rows.select(text.built_on(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in made.collect()] == [None, "1800-01-01", "2200-12-01", None, "2000-05-01", None, "2000-03-01"]
    assert plan(capsys, made).split("== Physical Plan ==")[1].count("regexp_extract") == 2


@pytest.mark.parametrize("name", ["html_rates", "parse_dates", "station_words", "station_lookup"])
def test_a_table_of_one_row_group_is_dealt_to_all_tasks(spark, capsys, name):
    assert "RoundRobinPartitioning" in plan(capsys, QUERIES[name](spark, SMALL))


def test_a_long_strip_of_polygons_needs_no_second_grid(spark):
    k = F.col("id")
    plots = spark.range(4000).select(k.cast("string").alias("key"), spatial.rectangle(k % 4 * 4, F.floor(k / 4) * 3, k % 4 * 4 + 5, F.floor(k / 4) * 3 + 4).alias("rings"))
    pieces = spatial.gridded(plots, limit=100)
    assert pieces.agg(F.max("level")).first()[0] == 0
    assert pieces.select("cx", "cy").distinct().count() > 4000 * 4 / 100
    made = spatial.union_areas(plots, "key", limit=100).agg(F.count("area").alias("n"), F.min("area").alias("a"), F.max("area").alias("b")).first()
    assert (made.n, made.a, made.b) == (4000, 20.0, 20.0)


@pytest.mark.parametrize("name", ["group_rank", "unset_marks", "scoring_view", "scoring_view_of_site", "price_anomalies", "group_knowledge"])
def test_offers_are_dealt_by_their_group_alone(spark, capsys, name):
    """Neither by long texts nor by the few values of a city, segment, station or address."""
    made = plan(capsys, QUERIES[name](spark, SMALL)).split("== Physical Plan ==")[1]
    dealt = set(re.findall(r"hashpartitioning\((\w+?)#", made))
    assert dealt <= {"_g", "listing_id"}


def test_sites_of_a_group_as_one_text(spark):
    rows = spark.createDataFrame(
        [(1, "a", 12, "active"), (2, "a", 2, "active"), (3, "a", 112, "active"), (4, "a", 2, "active"), (5, "a", 7, "sold"), (6, None, 2, "active"), (7, "b", 3, "sold"), (8, "c", 5, "active")],
        "listing_id long, dedup_key string, site_id long, status string",
    ).select("*", F.lit(1).alias("site_priority"), F.col("listing_id").alias("rent_total"), F.lit(None).cast("long").alias("price"), F.lit(0).alias("feature_count"))
    as_text = {r.listing_id: (r.member_count, r.other_sites, r.is_representative) for r in grouping.membership_texts(rows).collect()}
    assert as_text == {r.listing_id: (r.member_count, ",".join(map(str, r.other_sites)), r.is_representative) for r in grouping.membership(rows).collect()}
    assert as_text[1] == (5, "2,112", True) and as_text[5] == (5, "2,12,112", False) and as_text[6] == (1, "", True) and as_text[7] == (1, "", False)


def test_a_text_of_many_sites_is_joined_of_pieces(spark):
    k = F.col("id")
    large = spark.range(200).select(k.alias("listing_id"), F.lit("a").alias("dedup_key"), (k * 7 % 200 + 1).alias("site_id"), F.when(k % 10 == 3, "sold").otherwise("active").alias("status"))
    odd = [(900, "b", None, "active"), (901, "b", 5, "active"), (902, "b", 6, "active"), (903, None, None, "active"), (904, "c", None, "sold"), (905, "d", 8, "sold"), (906, "e", -4, "active"), (907, "e", 14, "active")]
    rows = large.unionByName(spark.createDataFrame(odd, "listing_id long, dedup_key string, site_id long, status string")).select(
        "*", F.lit(1).alias("site_priority"), F.col("listing_id").alias("rent_total"), F.lit(None).cast("long").alias("price"), F.lit(0).alias("feature_count")
    )
    made = grouping.membership_texts(rows)
    got = {r.listing_id: (r.member_count, r.other_sites, r.is_representative) for r in made.collect()}
    sites = sorted(n * 7 % 200 + 1 for n in range(200) if n % 10 != 3)
    for n in range(200):
        assert got[n] == (200, ",".join(str(x) for x in sites if x != n * 7 % 200 + 1), n == 0)
    assert [got[n] for n in range(900, 908)] == [(3, "", True), (3, "6", False), (3, "5", False), (1, "", True), (1, "", False), (1, "", False), (2, "14", True), (2, "-4", False)]


def test_members_meet_their_group_sorted_and_offers_are_read_twice(spark, capsys):
    made = plan(capsys, QUERIES["group_members"](spark, SMALL)).split("== Physical Plan ==")[1]
    assert made.count("FileScan parquet") == 2 and "SortMergeJoin" in made and "Broadcast" not in made
    assert "trim(" not in made and "instr(" not in made


def test_legs_keep_a_key_of_any_type(spark):
    body = "乗換：1回\n所要時間：1時間2分\n08:00発 A\n↓ 本線\n↓ 9分\n09:00着 B"
    made = stations.legs(spark.createDataFrame([((1, "x"), body), ((2, "y"), None)], "k struct<a: int, b: string>, t string"), "k", "t").collect()
    assert [(tuple(r.k), r.leg, r.transfers, r.total_minutes, r.from_name, r.to_name, r.minutes) for r in made] == [((1, "x"), 0, 1, 62, "A", "B", 9)]
