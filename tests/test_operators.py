import pytest
from pyspark.sql import functions as F

from lodeframe.operators import enrich, features, graph, grouping, marks, must, pages, snapshot, stats, want


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


VIEW = "listing_id long, property_family string, price long, rent_total long, area_sqm double, layout string, walk_minutes int, floor_num int, detail_fetched boolean, feature_codes array<string>, leasehold boolean"


def view(spark, **over):
    row = {"listing_id": 1, "property_family": "CHINTAI", "price": 60000, "rent_total": 63000, "area_sqm": 35.0, "layout": "1LDK", "walk_minutes": 10, "floor_num": 3, "detail_fetched": True, "feature_codes": [], "leasehold": None} | over
    return frame(spark, VIEW, [tuple(row.values())])


@pytest.mark.parametrize(
    ("over", "wanted", "result"),
    [
        ({}, {"rent_total_max": 63000}, "pass"),
        ({"rent_total": None}, {"rent_total_max": 63000}, "unknown"),
        ({}, {"rent_total_max": 62999}, "fail"),
        ({}, {"rent_total_max": 0}, "fail"),
        ({}, {"rent_total_max": None, "layouts": [], "freehold_only": False, "features": []}, "pass"),
        ({"layout": "1LDK～3LDK"}, {"layouts": ["1LDK"]}, "unknown"),
        ({"layout": "1SLDK"}, {"layouts": ["1LDK"]}, "pass"),
        ({}, {"features": ["A"]}, "fail"),
        ({"detail_fetched": False}, {"features": ["A"]}, "unknown"),
        ({"feature_codes": ["A", "B"]}, {"features": ["A"]}, "pass"),
        ({}, {"freehold_only": True}, "unknown"),
        ({"leasehold": True}, {"freehold_only": True}, "fail"),
        ({"walk_minutes": None}, {"walk_minutes_max": 5, "area_min": 50}, "fail"),
    ],
)
def test_requirements(spark, over, wanted, result):
    assert must.evaluated(view(spark, **over), wanted).first().must == result


def test_list_stage_and_policy(spark):
    rows = must.evaluated(view(spark), {"floor_min": 10, "area_min": 10, "unknown_policy": "drop"}, list_stage=True).first()
    assert (rows.must, rows.must_passes) == ("unknown", False)
    assert must.evaluated(view(spark), {"floor_min": 1}, list_stage=True).first().must_passes
    with pytest.raises(ValueError, match="unknown requirements"):
        must.evaluated(view(spark), {"colour": 1})


def test_scores(spark):
    numerics = [want.Numeric("rent_total", 30, 50000, 70000), want.Numeric("walk_minutes", 10, 5, 15)]
    whole = [want.Feature(("A", "B"), 20)]
    one = lambda **over: want.scored(view(spark, **over), whole, numerics).first()
    assert one(feature_codes=["B"]).score == round(100 * (20 + 30 * 0.35 + 10 * 0.5) / 60, 3)
    assert one(rent_total=None).score == round(100 * 5 / 30, 3)
    zero = want.scored(view(spark, rent_total=None), whole, [want.Numeric("rent_total", 30, 50000, 70000, "zero")]).first()
    assert zero.score == 0.0 and zero.unknown_items == 1
    late = one(detail_fetched=False, feature_codes=["A"])
    assert late.unknown_items == 1 and late.score == round(100 * (10.5 + 5) / 60, 3)
    assert want.scored(view(spark), [], []).first().score == 0.0
    assert want.scored(view(spark, feature_codes=["A"]), whole, numerics).select(want.top_hits(F.col("score_items"), 2).alias("h")).first().h == ["A|B", "rent_total"]


def test_ranks(spark):
    rows = frame(spark, "pattern string, listing_id long, score double, ok boolean", [("p", 3, 5.0, True), ("p", 1, 5.0, True), ("p", 2, 9.0, False), ("p", 4, 7.0, True), ("q", 5, 1.0, True), ("p", 6, None, None)])
    found = {r.listing_id: r["rank"] for r in want.ranked(rows, ["pattern"], F.col("ok")).collect()}
    assert found == {4: 1, 1: 2, 3: 3, 2: None, 5: 1, 6: None}


def listings(spark):
    schema = "listing_id long, site_id long, site_priority int, property_family string, address_normalized string, layout string, area_sqm double, floor_num int, land_area_sqm double, building_area_sqm double, price long, rent_total long, feature_count int, status string, feature_codes array<string>"
    unit = ("CHINTAI", "東京都足立区東和5丁目", "1K", 25.64, 4, None, None)
    rows = [
        (1, 1, 2, *unit, 100000, 104500, 1, "active", ["A"]),
        (2, 2, 1, *unit, 99000, 103500, 0, "active", []),
        (3, 3, 1, *unit, 90000, 94000, 0, "sold", ["S"]),
        (4, 1, 2, "CHINTAI", unit[1], "1K", 25.64, 5, None, None, 1, 1, 0, "active", []),
        (5, 1, 2, "CHINTAI", None, "1K", 25.64, 4, None, None, 1, 1, 0, "active", ["X"]),
        (6, 1, 2, "TOCHI_BUY", unit[1], None, None, None, 80.0, None, 5, None, 0, "sold", []),
    ]
    return frame(spark, schema, rows).withColumn("dedup_key", grouping.dedup_key())


def test_groups(spark):
    rows = listings(spark)
    keys = {r.listing_id: r.dedup_key for r in rows.collect()}
    assert keys[1] == keys[2] == keys[3] != keys[4] and keys[5] is None and keys[6]
    best = {r.dedup_key: r.representative_id for r in grouping.representatives(rows).collect()}
    assert best == {keys[1]: 2, keys[4]: 4}
    member = {r.listing_id: (r.member_count, r.other_sites, r.is_representative) for r in grouping.membership(rows).collect()}
    assert member == {1: (3, [2], False), 2: (3, [1], True), 3: (3, [1, 2], False), 4: (1, [], True), 5: (1, [], True), 6: (1, [], False)}
    union = {r.listing_id: r.feature_codes for r in grouping.union_features(rows).collect()}
    assert union[2] == ["A", "S"] and union[5] == ["X"] and union[4] == []


def test_representative_ties_and_changes(spark):
    rows = listings(spark)
    tied = rows.withColumn("rent_total", F.lit(1).cast("long"))
    assert {r.representative_id for r in grouping.representatives(tied).collect()} == {1, 4}
    changed = grouping.group_changes(grouping.representatives(rows.where("listing_id <> 2")), grouping.representatives(rows)).collect()
    assert [(r.old_id, r.new_id, r.is_cheaper) for r in changed] == [(1, 2, True)]


def test_unknown_family_is_an_error(spark):
    with pytest.raises(Exception, match="unknown family"):
        listings(spark).withColumn("property_family", F.lit("BOAT")).withColumn("k", grouping.dedup_key()).select("k").collect()


def test_latest_fallback_pairs(spark):
    rates = frame(spark, "city int, period string, source string, rate double", [(1, "2025Q1", "a", 5.0), (1, "2026Q1", "b", 7.0), (2, "2025Q4", "a", 0.0)])
    newest = enrich.latest(rates, ["city"], "period", "source")
    assert {(r.city, r.period, r.rate) for r in newest.collect()} == {(1, "2026Q1", 7.0), (2, "2025Q4", 0.0)}
    offers = frame(spark, "id int, city int, price double", [(1, 1, 14.0), (2, 2, 3.0), (3, 1, None), (4, 9, 1.0)])
    ratio = {r.id: (r.market_rate_ratio, r["rate"]) for r in enrich.market_ratio(offers, newest, ["city"], F.col("price"), "rate").collect()}
    assert ratio == {1: (2.0, 7.0), 2: (None, 0.0), 3: (None, 7.0), 4: (None, None)}
    levels = frame(spark, "key string, v double", [("a1", 0.0), ("a", 3.0)])
    rows = frame(spark, "fine string, coarse string", [("a1", "a"), ("a2", "a"), ("b1", "b")])
    assert [(r.v, r.level_used) for r in enrich.with_fallback(rows, levels, "fine", "coarse", "key", ["v"]).orderBy("fine").collect()] == [(0.0, "fine"), (3.0, "coarse"), (None, None)]
    pairs = frame(spark, "id int, station int, walk int, ride int", [(1, 1, 3, 40), (1, 2, 10, 20), (1, 3, 20, 10), (2, 1, 5, None), (2, 2, None, 7), (3, 4, 9, None)])
    assert sorted(tuple(r) for r in enrich.best_pairs(pairs, "id", "walk", "ride", "station").select("id", "walk", "ride").collect()) == [(1, 10, 20), (2, 5, 7), (3, 9, None)]


def test_hazard_values(spark):
    parts = frame(spark, "k string, rank int, area double, total double", [("a", 2, 30.0, 100.0), ("a", 5, 10.0, 100.0), ("b", 3, 200.0, 100.0), ("c", 3, 2.0, 0.0)])
    found = {r.k: (r.area_ratio, r.rank_avg, r.rank_max) for r in enrich.area_weighted(parts, ["k"], "rank", "area", "total").collect()}
    assert found == {"a": (0.4, 1.1, 5.0), "b": (1.0, 3.0, 3.0), "c": (0.0, 0.0, 3.0)}
    graded = enrich.graded(frame(spark, "k string, level int, area double", [("a", 1, 10.0), ("a", 4, 30.0), ("a", 6, 999.0), ("b", 6, 5.0)]), ["k"], "level", "area").collect()
    assert [tuple(r) for r in graded] == [("a", 0.25, 2.75, 5.0)]


def test_statistics(spark):
    schema, perfect = "g string, x double, y double", [(float(k), float(2 * k)) for k in range(5)]
    rows = [("up", *p) for p in perfect] + [("down", x, -y) for x, y in perfect] + [("flat", x, 1.0) for x, _ in perfect] + [("one", 1.0, 2.0)]
    found = {r.g: r.spearman for r in stats.spearman(frame(spark, schema, rows), ["g"], "x", "y").collect()}
    assert found == {"up": 1.0, "down": -1.0, "flat": None, "one": None}
    made = stats.nearest_percentile(frame(spark, "g int, v int", [(1, k) for k in range(10)] + [(2, 5)]), ["g"], "v", [0.1, 0.5, 0.9]).orderBy("g").collect()
    assert [tuple(r) for r in made] == [(1, 1, 5, 9), (2, 5, 5, 5)]
    unit = frame(spark, "k int, v double, p boolean", [(1, float(x), x < 12) for x in range(20)] + [(2, float(x), False) for x in range(10)] + [(3, 1.0, True)])
    assert sorted((r.k, r.rate_value, r.basis) for r in enrich.median_with_fallback(unit, ["k"], "v", F.col("p")).collect()) == [(1, 5.5, "primary"), (2, 4.5, "all")]
    with pytest.raises(Exception, match="not unique"):
        stats.unique_or_fail(frame(spark, "k int", [(1,), (1,)]), ["k"]).collect()
    assert frame(spark, "v double", [(0.7,), (None,)]).select(stats.gated(F.col("v"), most=0.6).alias("g")).collect()[0].g is False


def test_upsert_policies(spark):
    stored = frame(spark, "id int, type string, family string, status string, price long, note string, first_seen string, last_seen string", [(1, "t", "f", "active", 10, "n", "1", "1"), (2, "t", "f", "sold", 10, "n", "1", "1"), (3, "t", "f", "active", 10, "n", "1", "1"), (4, "t", "f", "sold", 10, "n", "1", "1"), (5, "t", "f", "sold", 10, "n", "1", "1"), (6, "t", "f", "active", 10, "n", "1", "1")])
    batch = frame(spark, "id int, type string, family string, price long, note string", [(1, "t", "f", 12, None), (2, "t", "f", 9, None), (3, "u", "f", 1, "x"), (4, "u", "f", 1, None), (5, "u", "g", 1, None), (7, "t", "f", None, None)])
    found = {r.id: (r.relation, r.event, r.price, r.note, r.price_prev, r.status, r.first_seen) for r in snapshot.upserted(stored, batch, ["id"], ["price"], ["note"], "2").collect()}
    assert found == {
        1: ("same_type", "price_up", 12, "n", 10, "active", "1"), 2: ("same_type", "new", 9, "n", 10, "active", "1"), 3: ("type_mismatch", None, 10, "n", None, "active", "1"),
        4: ("retype", "new", 1, None, None, "active", "1"), 5: ("family_mismatch", None, 10, "n", None, "sold", "1"), 6: (None, None, 10, "n", None, "active", "1"), 7: ("new", "new", None, None, None, "active", "2"),
    }


def test_suppression_and_marks(spark):
    candidates = frame(spark, "unit string, kind string, price long", [("a", "new", 1), ("a", "cheaper", None), ("b", "new", 1)])
    sent = frame(spark, "unit string, kind string, price long", [("a", "new", 9), ("a", "cheaper", None)])
    assert {(r.unit, r.kind) for r in snapshot.unsent(candidates, sent).collect()} == {("b", "new")}
    assert {(r.unit, r.kind) for r in snapshot.unsent(candidates, sent, by_price=True).collect()} == {("a", "new"), ("b", "new")}
    offers = frame(spark, "listing_id int, gk string", [(1, "g"), (2, "g"), (3, "l")])
    stored = frame(spark, "listing_id int, is_favourite boolean, is_excluded boolean, memo string", [(1, True, False, None), (3, False, False, "m")])
    assert {r.listing_id: (r.is_favourite, r.memos) for r in marks.group_marks(offers, stored).collect()} == {1: (True, 0), 2: (True, 0), 3: (False, 1)}
    asked = frame(spark, "listing_id int", [(2,)])
    assert {r.listing_id for r in marks.flag_set(offers, stored, asked, "is_favourite", False).collect()} == {3}
    assert {r.listing_id for r in marks.flag_set(offers, stored, asked, "is_excluded", True).collect()} == {1, 2, 3}


def test_pages(spark):
    rows = frame(spark, "listing_id long, rank long, cost long, area_sqm double, walk_minutes int, must string, site_id long, city string, age_years int, first_seen string", [(k, k if k % 2 else None, 10000 * k, 20.0, 5, "pass", 1, "c", 1, "x") for k in range(1, 8)])
    got = pages.page(rows, pages.ListingFilter.from_query({"price_min": "2", "page": "2"}), size=2).collect()
    assert sorted(r.listing_id for r in got) == [2, 7] and got[0].total == 6
    for bad in ({"page": "0"}, {"sort": "colour"}, {"price_min": "5", "price_max": "1"}, {"walk_max": "x"}):
        with pytest.raises(ValueError):
            pages.ListingFilter.from_query(bad)
    queue = pages.detail_queue(frame(spark, "id int, seen string", [(k, f"{k:02d}") for k in range(10)]), 5, "seen", "id").collect()
    assert {(r.id, r.part) for r in queue} == {(0, "oldest"), (1, "oldest"), (9, "newest"), (8, "newest"), (7, "newest")}
    assert [r.code for r in pages.rotated(frame(spark, "code string", [(c,) for c in "abcd"]), "code", "b", 3).collect()] == ["c", "d", "a"]
    excluded = frame(spark, "listing_id long", [(1,)])
    assert [r.listing_id for r in pages.digest(rows, 5, excluded, "listing_id").collect()] == [3, 5, 7, 2, 4]


def test_features(spark):
    dictionary = [features.Entry("LOCK", ("オートロック",), ("オートロックなし",)), features.Entry("BATH", ("バス・トイレ別", "バストイレ別"), (), ("CHINTAI",))]
    rows = frame(spark, "id int, family string, t string", [(1, "CHINTAI", "バストイレ別、オートロック"), (2, "CHINTAI", "オートロックなし"), (3, "TOCHI_BUY", "バストイレ別、角部屋、12")])
    found = {r.id: [(x.code, x.matched) for x in r.features] for r in features.extracted(rows, dictionary, "t", "family").collect()}
    assert found == {1: [("BATH", "バストイレ別"), ("LOCK", "オートロック")], 2: [], 3: []}
    assert [(r.token, r.n) for r in features.unknown_tokens(rows, dictionary, "t", []).collect()] == [("角部屋", 1)]
    derived = frame(spark, "f int, t int, a int", [(1, 1, None), (5, 5, 2), (None, 3, 10)]).select(features.derived(F.col("f"), F.col("t"), F.col("a")).alias("d")).collect()
    assert [r.d for r in derived] == [["LOC_FLOOR_1"], ["FEAT_NEW", "LOC_FLOOR_2UP", "LOC_TOP_FLOOR"], []]


def test_shortest_paths(spark):
    stations = frame(spark, "station_cd long, station_g_cd long, lat double, lon double", [(101, 1101, 35.7, 139.0), (102, 1102, 35.7, 139.022), (103, 1103, 35.7, 139.044), (203, 1103, 35.7, 139.044), (202, 1202, 35.7, 139.066), (999, 1999, 0.0, 0.0)])
    links = frame(spark, "a long, b long", [(101, 102), (102, 103), (203, 202), (101, 12345)])
    origins = stations.where("station_g_cd = 1101").select(F.col("station_cd").alias("node"))
    found = {r.station_g_cd: r for r in graph.group_estimates(graph.shortest(graph.rail_edges(stations, links), origins), stations).collect()}
    assert found[1101].minutes == 0 and abs(found[1103].km - 4.0) < 0.3 and found[1103].transfers == 0
    assert found[1202].transfers == 1 and 1999 not in found
