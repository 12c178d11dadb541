import pytest
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators import enrich, must, snapshot, stations, upkeep, views, want
from lodeframe.plans import pattern


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_a_key_that_repeats_in_a_batch_is_stored_once(spark):
    schema = "unit int, type string, family string, status string, price int, note string, first_seen string, last_seen string"
    stored = frame(spark, schema, [(1, "a", "F", "active", 10, None, "1", "1")])
    batch = frame(spark, "unit int, type string, family string, price int, note string, at int", [(1, "a", "F", 30, None, 2), (1, "a", "F", 20, "x", 1), (2, "a", "F", 5, None, 1), (2, "a", "F", 5, None, 1)])
    made = {r.unit: (r.price, r.event, r.price_prev) for r in snapshot.upserted(stored, batch, ["unit"], ["price"], ["note"], "2", order="at").collect()}
    assert made == {1: (30, "price_up", 10), 2: (5, "new", None)}
    assert snapshot.upserted(stored, batch, ["unit"], ["price"], ["note"], "2").count() == 2


def test_equal_texts_stay_rows(spark):
    rows = frame(spark, "scope string, t string", [("p", "x ab"), ("p", "x ab"), ("q", "x ab"), ("p", None)])
    names = frame(spark, "scope string, name string", [("p", "a"), ("p", "ab"), ("p", "b"), ("p", None)])
    found = sorted((r.scope, r.t or "", r.name or "") for r in enrich.longest_contained(rows, names, "scope", "t", "name").collect())
    assert found == [("p", "", ""), ("p", "x ab", "ab"), ("p", "x ab", "ab"), ("q", "x ab", "")]


def test_ranks_over_many_ranges(spark):
    rows = frame(spark, "pattern string, listing_id long, score double", [(p, k, float(k % 3)) for p in "ab" for k in range(200)])
    made = want.ranked(rows, ["pattern"], F.col("listing_id") != 5).collect()
    for p in "ab":
        ranked = sorted((r["rank"], r.listing_id) for r in made if r.pattern == p and r["rank"])
        assert [n for n, _ in ranked] == list(range(1, 200))
        assert [i for _, i in ranked] == sorted((k for k in range(200) if k != 5), key=lambda k: (-(k % 3), k))
    assert [r["rank"] for r in made if r.listing_id == 5] == [None, None]
    assert [r.listing_id for r in want.top(rows.where("pattern = 'a'"), 2).orderBy("rank").collect()] == [2, 5]


def test_requirements_without_a_layout(spark):
    rows = frame(spark, "layout string, price int", [("1K", 5), ("1K～2K", 5), (None, 50)])
    made = must.evaluated(rows, {"layouts": ["1k"], "price_max": 10}).collect()
    assert [r.must for r in made] == ["pass", "unknown", "fail"] and made[0].must_passes and "_layout" not in made[0].asDict()


def test_best_of_a_pattern_is_the_head_of_its_ranking(spark):
    columns = "listing_id long, dedup_key string, property_family string, site_id long, site_priority int, price long, rent_total long, area_sqm double, feature_count int, status string, layout string, feature_codes array<string>, detail_fetched boolean"
    rows = frame(spark, columns, [(k, f"g{k % 7}" if k % 4 else None, "CHINTAI", k % 3, k % 3, 1000 * k, 1000 * k, 20.0 + k, k % 5, "sold" if k % 6 == 0 else "active", "1K", [], True) for k in range(60)])
    one = pattern.Pattern("p", "CHINTAI", {"rent_total_max": 50000}, (), (want.Numeric("area_sqm", 10, 90, 10), want.Numeric("rent_total", 5, 0, 60000)))
    from lodeframe.operators.grouping import with_groups

    whole = pattern.scored(with_groups(rows), one).where("rank <= 9").orderBy("rank").collect()
    head = pattern.best(rows, one, 9).orderBy("rank").collect()
    assert [(r.listing_id, r.score, r["rank"], r.member_count) for r in whole] == [(r.listing_id, r.score, r["rank"], r.member_count) for r in head]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("common:\n- {code: A, patterns: [x, y], negatives: [z]}\n", encoding="utf-8")
    (tmp_path / "b.yaml").write_text("RENT:\n- {code: B, patterns: [w]}\n", encoding="utf-8")
    made = upkeep.load_dictionary(spark, str(tmp_path), {"RENT": ("CHINTAI",)})
    assert sorted(made, key=lambda e: e.code) == upkeep.dictionary_of(upkeep.dictionary_rows(spark, made))
    for bad in ([{"common": []}, {"common": []}], [{"RENT": []}], [{"common": [{"code": "A", "patterns": []}, {"code": "A", "patterns": []}]}]):
        with pytest.raises(ValueError, match="repeats|unknown"):
            upkeep.dictionary(bad, {})
    assert upkeep.regions({"east": [1, 2], "west": [3]}, {1, 2, 3})[3] == "west"
    for spec in ({"east": [1, 1]}, {"east": [1]}):
        with pytest.raises(ValueError, match="is in|in no"):
            upkeep.regions(spec, {1, 2})


def test_access_words(spark):
    given = ["東武東上線「志木」駅バス7分「水谷」下車 徒歩3分", "千葉駅/バス乗車30分/中央バス 大和田入口/徒歩2分", "中央：本町 徒歩4分", "役場前バス停から徒歩9分 / Ａ線「北」駅より徒歩5分"]
    rows = [r.r for r in spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").orderBy("k").select(stations.read("t").alias("r")).collect()]
    assert [r.named for r in rows] == [["志木"], ["千葉"], [], ["北"]]
    assert rows[1].walks == {} and rows[2].loose == []


def test_variants_keep_their_digits(spark):
    row = spark.range(1).select(stations.variants(F.lit("S10")).alias("a"), stations.variants(F.lit("徒歩5分本線1S01")).alias("b"), text.without_note(F.lit("駅[新]")).alias("c")).first()
    assert row.a == ["S10"] and row.b[-1] == "1S01" and row.c == ["駅[新]", "駅"]


def test_city_fallback_is_unique_in_scope(spark):
    cities = frame(spark, "prefecture string, name string, city_id int", [("P県", "北区", 1), ("Q県", "北区", 2), ("Q県", "大市北区", 3), ("R県", "南区", 4), ("Q県", "ヶ市", 5)])
    texts = frame(spark, "a string", [("Q県大市北区1",), ("Q県町",), ("北区1",), ("南区2",), ("ケ市",), (None,)])
    found = {r.a: (r.prefecture, r.city_id) for r in views.resolved_city(texts, cities, "a", ["P県", "Q県"]).collect()}
    assert found == {"Q県大市北区1": ("Q県", 3), "Q県町": ("Q県", None), "北区1": (None, None), "南区2": (None, None), "ケ市": ("Q県", 5), None: (None, None)}


def test_what_a_group_knows_comes_from_all_its_members(spark):
    none = "cast(null as string)"
    offers = spark.range(5).selectExpr(
        "id as listing_id", "case when id < 3 then 'home' end as dedup_key", "case id when 0 then array('GAS_CITY') when 1 then array('STOVE_IH') else array() end as feature_codes",
        f"map('rights', case id when 0 then '所有権' when 2 then '一部借地権' when 3 then '所有権' else {none} end, 'raw', case id when 0 then '-' when 1 then '?' else {none} end, 'saved', case id when 1 then 'true' when 2 then 'false' when 4 then 'true' else {none} end) as attributes",
    )
    near = spark.createDataFrame(
        [(0, 7, "B", None, "matched"), (1, 7, "A", 9, "matched"), (2, 8, "C", 3, "matched"), (2, 9, "Bus", 1, "unmatched"), (3, 8, "C", None, "matched")], "listing_id long, station_g_cd int, name string, walk int, status string"
    )
    commutes = spark.createDataFrame([(8, 30), (8, 40)], "station_g_cd int, ride int")
    made = views.with_group_knowledge(offers.select("listing_id"), offers, near, commutes, ["rights"], "raw", "saved", F.array_join("feature_codes", "+"))
    got = {r["listing_id"]: (r["leasehold"], r["build_condition"], [tuple(s) for s in r["stations"] or []], r["utility"]) for r in made.collect()}
    # one lease is a lease; a member's text counts before its own stored flag; a station once, nearest first
    home = (True, False, [(8, "C", 3, 40), (7, "A", 9, None)], "GAS_CITY+STOVE_IH")
    assert got[0] == got[1] == got[2] == home
    assert got[3] == (False, None, [(8, "C", None, 40)], "") and got[4] == (None, True, [], "")
