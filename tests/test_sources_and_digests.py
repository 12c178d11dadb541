"""Page adapters, embedded JSON, digests that fit a message, wards of designated cities, syncs of repeated keys."""

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators import cities, digests, pages, reports, upkeep, views, want
from lodeframe.sources import adapters, variants


def page(json_text):
    return f'<html><script id="__DATA__" type="application/json">{json_text}</script></html>'


def test_two_levels_of_embedded_json(spark):
    rows = spark.createDataFrame(
        [
            (1, page('{"r": {"b": [{"name": "A", "rooms": [{"id": 1, "rent": 50000}, {"id": "2", "rent": "x"}]}, {"name": 7, "rooms": []}, {"rooms": [{"id": 3}]}]}}')),
            (2, page('{"r": {"b": "none"}}')), (3, page('{"r": {"b": [')), (4, "<html></html>"), (5, None), (6, page('{"r": {"b": [{"name": {"x": 1}, "rooms": [[], null, {"id": 9, "rent": 1.0}]}]}}')),
        ], "k int, html string",
    )
    found, seen = variants.two_levels(rows, variants.embedded(F.col("html"), "__DATA__"), "$.r.b", "$.rooms", [variants.Field("name", "$.name")], [variants.Field("id", "$.id", "int"), variants.Field("rent", "$.rent", "long")])
    got = [tuple(r) for r in found.select("k", "outer_place", "inner_place", "name", "id", "rent").collect()]
    got.sort(key=lambda r: r[:3])
    assert got[:3] == [(1, 0, 0, "A", 1, 50000), (1, 0, 1, "A", 2, None), (1, 2, 0, None, 3, None)]
    assert [r[4:] for r in got[3:]] == [(None, None), (None, None), (9, 1)]
    assert seen.get == {"documents": 4, "malformed": 1, "without_outer": 1}


LIST = adapters.Adapter("A", "RENT", r'<div class="e">(.*?)</div>', (adapters.Found("title", r"<b>(.*?)</b>", needed=True), adapters.Found("rent", r"([0-9]+) yen", type="int")), (adapters.Found("title", r"<h1>(.*?)</h1>", needed=True),))
JSON = adapters.Adapter("B", "RENT", ("__DATA__", "$.items"), (adapters.Found("title", path="$.name", needed=True), adapters.Found("rent", path="$.rent", type="long")))
PAGES = [
    ("A", "RENT", "a1", '<div class="e"><b>One <i>x</i></b> 500 yen</div>\n<div class="e"><b></b> many yen</div>'), ("A", "RENT", "a2", "<p>broken"), ("A", "RENT", "a3", None), ("A", "BUY", "a4", "<b>x</b>"),
    ("B", "RENT", "b1", page('{"items": [{"name": "Two", "rent": 7}, {"rent": "z"}]}')), ("B", "RENT", "b2", page("{")),
]


def test_adapters_read_lists_and_count_bad_pages(spark):
    pages_ = spark.createDataFrame(PAGES, "site string, kind string, url string, html string")
    registry = adapters.Registry(LIST, JSON)
    rows = registry.listed(pages_, ["title", "rent"])
    got = {(r["url"], r["place"]): (r["title"], r["rent"], r["error"]) for r in rows.collect()}
    assert got == {
        ("a1", 0): ("One x", "500", None), ("a1", 1): (None, None, "missing title"), ("a2", None): (None, None, "no entries"), ("a3", None): (None, None, "no entries"),
        ("a4", None): (None, None, "no adapter"), ("b1", 0): ("Two", "7", None), ("b1", 1): (None, None, "missing title"), ("b2", None): (None, None, "no entries"),
    }
    assert {tuple(r) for r in adapters.counted(rows).collect()} == {("A", "RENT", 4, 3), ("A", "BUY", 1, 1), ("B", "RENT", 3, 2)}
    assert [r["title"] for r in registry.detailed(pages_.where("url = 'a2'").withColumn("html", F.lit("<h1> T&nbsp; </h1>")), ["title"]).collect()] == ["T&nbsp;"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Scan ") == 1
    with pytest.raises(ValueError, match="two adapters"):
        adapters.Registry(LIST, LIST)


def test_adapters_read_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame(PAGES, "site string, kind string, url string, html string").write.mode("overwrite").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("site string, kind string, url string, html string").json(str(tmp_path / "in"))
    found = adapters.Registry(LIST, JSON).listed(stream, ["title", "rent"])
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def fit(spark, lines, used, most):
    rows = spark.createDataFrame([(lines,)], "l array<string>")
    return tuple(rows.select(digests.fitted(F.col("l"), F.lit(used), most, note="~").alias("m")).select("m.*").first())


def test_digest_bodies_fit_to_the_character(spark):
    # 10 spent before; each line counts two more; one character is kept for the note
    assert fit(spark, ["aaaa", "bbbb"], 10, 23) == ("aaaa\n\nbbbb", 2, 0)
    assert fit(spark, ["aaaa", "bbbb"], 10, 22) == ("aaaa\n\n~", 1, 1)
    assert fit(spark, ["a" * 90, "b"], 10, 50) == ("~", 0, 2)  # the first line is too long: nothing after it is shown
    assert fit(spark, ["📊📊📊📊", "字字字字"], 10, 23) == ("📊📊📊📊\n\n字字字字", 2, 0)  # code points, not bytes
    assert fit(spark, [], 10, 22) == fit(spark, None, 10, 22) == (digests.NOTHING, 0, 0)
    entries = spark.createDataFrame([("p", 2, "second"), ("p", 1, "first"), ("p", 3, "third")], "pattern string, rank int, line string")
    named = spark.createDataFrame([("p", "G"), ("q", None)], "pattern string, digest_group string")
    got = {r["pattern"]: tuple(r)[1:] for r in digests.digests(entries, named, 2).collect()}
    assert got["p"] == ("📊 [G] **p** の上位 2 件", "first\n\nsecond", 2, 0) and got["q"] == ("📊 **q** の上位 0 件", digests.NOTHING, 0, 0)


def test_wards_belong_to_the_longest_city(spark):
    schema = "jis_code string, prefecture string, city string"
    towns = spark.createDataFrame([("1", "K", "川崎市"), ("2", "T", "市川市"), ("3", "M", "四日市市"), ("4", "M", "四日市"), ("5", "K", "川町"), ("6", "O", "川崎市")], schema)
    wards = spark.createDataFrame([("7", "K", "川崎市川崎区"), ("8", "K", "川崎市"), ("9", "M", "四日市市北区")], schema)
    got = {r["jis_code"]: (r["city_name"], r["parent_city"], r["canonical_name"]) for r in cities.city_rows(towns, wards, {"5": "川の町"}).collect()}
    assert got["7"] == ("川崎区", "川崎市", "川崎市川崎区") and got["9"] == ("北区", "四日市市", "四日市市北区") and "8" not in got
    assert got["1"] == ("川崎市", None, "川崎市") and got["5"] == ("川町", None, "川の町")
    with pytest.raises(Exception, match="no city of the ward"):
        cities.city_rows(towns, spark.createDataFrame([("7", "K", "横浜市西区")], schema)).collect()
    with pytest.raises(Exception, match="not unique"):
        cities.city_rows(towns.union(towns.limit(1)), wards).collect()
    assert {tuple(r) for r in cities.indexed(spark.createDataFrame([("13101", "T", "a"), ("13102", "T", "b")], schema)).collect()} == {("13", "T")}


def test_syncs_of_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "s", 1.0), (2, "s", 2.0)], "city_id int, segment string, rate_value double")
    fresh = spark.createDataFrame([("A", "s", 5.0), ("A", "s", 7.0), ("B", "s", 9.0), ("C", "t", 3.0), ("Z", "s", 1.0)], "city string, segment string, rate_value double")
    named = spark.createDataFrame([("A", 1), ("B", 2), ("B", 4), ("C", 3)], "name string, city_id int")
    rates, lost, counts = upkeep.synced_rates(stored, fresh, named, ["segment"])
    assert {tuple(r) for r in rates.collect()} == {(1, "s", 7.0), (2, "s", 2.0), (3, "t", 3.0)}
    assert {tuple(r) for r in lost.collect()} == {("B", 1), ("Z", 1)} and tuple(counts.first()) == (1, 1)
    scores = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 6.0)], "pattern string, listing_id int, score double")
    new = spark.createDataFrame([("p", 1, 8.0), ("p", 1, 7.0), ("q", 1, 1.0)], "pattern string, listing_id int, score double")
    assert {tuple(r) for r in views.upserted_scores(scores, new).collect()} == {("p", 1, 8.0), ("p", 2, 6.0), ("q", 1, 1.0)}


def test_every_walk_of_a_text_is_read(spark):
    rows = spark.createDataFrame([("徒歩3分 " * 1200 + "徒歩1分",)], "t string")
    found = rows.select(text.after_word(F.col("t"), "徒歩", "分").alias("w")).first()["w"]
    assert len(found) == 1201 and min(found) == 1


def test_anomaly_lines_leave_out_what_is_unknown(spark):
    rows = spark.createDataFrame(
        [("CHINTAI", 1, 90000, None, 85000, 25.0, None, "1K", 0.1234, "a" * 30), ("KODATE_BUY", 2, 5000, 1000000, None, 9.0, 80.25, None, None, None), ("MANSION_BUY", 3, None, None, None, None, None, "", 0.05, "")],
        "property_family string, listing_id int, rent_total long, price long, x long, area_sqm double, building_area_sqm double, layout string, market_rate_ratio double, title string",
    )
    got = [r["t"] for r in rows.select(views.anomaly_text(F.lit("S"), F.col("title")).alias("t")).collect()]
    assert got == [f"S id=1 / 月額90,000円 / 25.0㎡ / 1K / 相場比0.123 / 「{'a' * 24}」", "S id=2 / 価格1,000,000円 / 延床80.25㎡", "S id=3 / 相場比0.050"]


def test_places_before_the_digest_and_targets_by_score(spark):
    rows = spark.createDataFrame([(k, float(k % 4), k % 3 == 0, f"2025-{k:02d}") for k in range(1, 12)], "listing_id long, score double, is_excluded boolean, seen string")
    ranked = want.ranked(rows.drop("is_excluded"), [], F.lit(True))
    for most in (0, 1, 4, 50):
        assert reports.excluded_ahead(rows, most).first()["n"] == reports.excluded_in_digest(ranked, rows.select("listing_id", "is_excluded"), most).first()["n"]
        plain = {tuple(r) for r in pages.check_targets(ranked, most, 3, "listing_id", "seen").collect()}
        assert {tuple(r) for r in pages.check_targets_by_score(rows, most, 3, "listing_id", "seen").collect()} == plain
