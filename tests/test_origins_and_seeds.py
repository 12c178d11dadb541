"""Stations that routes start from, links of index pages, seeds, coverage of sites, retyped offers, medians of bills."""

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import origins, reports, snapshot, stats
from lodeframe.sources import html, masters


def test_origins(spark):
    stations = spark.createDataFrame([(12, 1, "町屋駅前", 13), (11, 1, "町屋", 13), (20, 2, "三田", 28), (30, 3, "x", 1)], "station_cd int, station_g_cd int, station_name string, pref_cd int")
    groups = spark.createDataFrame([(1,), (2,), (2,), (9,)], "station_g_cd int")
    prefectures = spark.createDataFrame([(13, "東京都")], "pref_cd int, prefecture string")
    found = origins.origin_stations(stations, groups, prefectures)
    got = {r["station_g_cd"]: (r["station_name"], r["prefecture"], r["alias_names"]) for r in found.collect()}
    assert got == {1: ("町屋", "東京都", ["町屋", "町屋駅前"]), 2: ("三田", None, ["三田"])}
    words = {r["w"] for r in found.select(origins.search_words(F.col("station_name"), F.col("prefecture")).alias("w")).collect()}
    assert words == {"町屋（東京都）", "三田"}
    routes = spark.createDataFrame(
        [(1, "町屋駅前", "d1", "d1"), (1, "町屋［京成］", "d1", "d1"), (1, "町田", "d1", "d1"), (1, None, "d1", "d1"), (1, "町屋駅", "d1", "d2"), (2, "三田", "d1", None), (7, "a", "d1", "d1")],
        "station_g_cd int, origin_label string, asked_on string, answered_on string",
    )
    assert [r["fault"] for r in origins.checked_routes(routes.coalesce(1), found).orderBy("station_g_cd", F.monotonically_increasing_id()).collect()].count(None) == 2
    faults = {(r["origin_label"], r["answered_on"]): r["fault"] for r in origins.checked_routes(routes, found).collect()}
    assert faults[("町田", "d1")] == faults[(None, "d1")] == faults[("a", "d1")] == "station" and faults[("町屋駅", "d2")] == faults[("三田", None)] == "date"
    commutes = spark.createDataFrame([(1, 5, "timetable"), (2, 5, "estimate"), (3, 6, "timetable")], "origin int, destination int, source string")
    estimates = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "origin int, minutes int")
    assert {tuple(r) for r in origins.kept_estimates(estimates, commutes, 5, "timetable").collect()} == {(2, 20), (3, 30)}
    offers = spark.createDataFrame([("active", "東京都"), ("sold", "大阪府")], "status string, prefecture string")
    codes = spark.createDataFrame([("東京都", 13), ("大阪府", 27), ("沖縄県", 47)], "prefecture string, code int")
    assert [r[0] for r in origins.segment_prefectures(offers, codes, None).collect()] == [13]
    assert {r[0] for r in origins.segment_prefectures(offers, codes, [47, 27]).collect()} == {27, 47}


def test_links_of_index_pages(spark):
    page = (
        '<p><input type="checkbox" value="13101"><a href="/tokyo/chiyoda/"> 千代田<b>区</b> </a><a href="/osaka/kita/">北区</a>'
        '<article><a data-jis="13102" href="/tokyo/chuo/"></a><a  href="/tokyo/chuo/">中央区</a><a href="/tokyo/minato/">港区</a><a href="/about">x</a></article>'
    )
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<a name=1>none</a>")], "id int, h string")
    got = {r["slug"]: (r["code"], r["label"]) for r in html.city_links(pages, "id", "h", "^/tokyo/([a-z]+)/$").collect()}
    assert got == {"chiyoda": ("13101", "千代田 区"), "chuo": ("13102", "中央区"), "minato": (None, "港区")}


def test_seeds_are_written_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "sites_1.csv").write_text("code,name\na,A\n")
    (tmp_path / "sites_2.csv").write_text("code,name\nb,B（%）\n")
    (tmp_path / "kinds.csv").write_text("kind\nx\n")
    tables = {"sites": (["code", "name"], 2), "kinds": (["kind"], 1)}
    for _ in range(2):
        assert masters.seeded(spark, str(tmp_path), str(tmp_path / "out"), tables) == {"sites": 2, "kinds": 1}
    with pytest.raises(ValueError, match="fewer rows"):
        masters.seeded(spark, str(tmp_path), str(tmp_path / "out"), {"sites": (["code"], 1), "kinds": (["kind"], 2)})
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "sites")).collect()} == {("a", "A"), ("b", "B（%）")}
    with pytest.raises(ValueError, match="columns missing"):
        masters.seeded(spark, str(tmp_path), str(tmp_path / "out"), {"sites": (["color"], 1)})


def test_coverage_names_sites_that_are_read_but_not_wired_up(spark):
    rows = spark.createDataFrame([(1, "s", True, 5), (2, "s", True, None), (3, "t", True, 1), (4, "s", False, 2)], "listing_id int, site string, detail_fetched boolean, price int")
    features = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "listing_id int, code string")
    got = {r["site"]: tuple(r)[1:] for r in stats.site_coverage(rows, "site", features, ["price"]).collect()}
    assert got == {"s": (3, 2, 2, 1.5, 1, 2, 2), "t": (1, 1, 0, 0.0, 0, 0, 1)}


def test_retyped_offers_lose_what_was_known_of_the_old_one(spark):
    stored = "id int, type string, family string, price long, status string, first_seen string, last_seen string"
    old = spark.createDataFrame([(1, "new", "f", 5, "sold", "0", "0"), (2, "new", "f", 5, "active", "0", "0")], stored)
    batch = spark.createDataFrame([(1, "used", "f", 6), (2, "new", "f", 6)], "id int, type string, family string, price long")
    after = snapshot.upserted(old, batch, ["id"], ["price"], [], "1")
    features = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id int, code string")
    assert {r["id"] for r in snapshot.without_retyped(features, after, ["id"]).collect()} == {2, 3}


def test_medians_of_bills(spark):
    rows = spark.createDataFrame([("city", 10, 1), ("city", 20, 2), ("city", 40, 3), ("lpg", None, 4), (None, 7, 5), (None, 9, 6)], "gas string, yen long, rank int")
    got = {r["gas"]: (r["rows"], r["median_yen"], r["in_top"], r["share"]) for r in reports.utility_report(rows, "gas", "yen", "rank", 2).collect()}
    assert got == {"city": (3, 20.0, 2, 0.5), "lpg": (1, None, 0, 0.1667), None: (2, 8.0, 0, 0.3333)}
