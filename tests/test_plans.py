import pytest

from pyspark.sql import functions as F

from lodeframe.plans import pattern
from lodeframe.plans.registry import ORACLE, QUERIES
from lodeframe.sources import html, masters
from lodeframe.streaming import changes

RAW = {
    "name": "p", "property_type": "CHINTAI", "must": {"rent_total_max": 80000, "unknown_policy": "keep"},
    "want": {"features": [{"code": "A", "weight": 10}, {"any_of": ["B", "C"], "weight": 5}], "numeric": [{"metric": "rent_total", "weight": 40, "best": 50000, "worst": 90000}]},
}


def changed(**over):
    return RAW | over


def test_pattern_hash_is_stable_and_follows_scores():
    one = pattern.parse(RAW)
    assert one.config_hash == pattern.parse(RAW).config_hash and len(one.config_hash) == 64
    assert pattern.parse(changed(must={})).config_hash == one.config_hash
    other = {**RAW["want"], "numeric": [{**RAW["want"]["numeric"][0], "on_missing": "zero"}]}
    assert pattern.parse(changed(want=other)).config_hash != one.config_hash
    assert pattern.unknown_codes(one, {"A", "B"}) == ["C"]


@pytest.mark.parametrize(
    "raw",
    [
        changed(colour=1), changed(property_type="BOAT"), changed(must={"price_max": 1}), changed(must={"colour": 1}), changed(must={"commute_minutes_max": 30}),
        changed(want={"features": [{"weight": 1}]}), changed(want={"features": [{"any_of": ["A", "A"], "weight": 1}]}), changed(want={"features": [{"code": "A", "weight": 1}, {"code": "A", "weight": 1}]}),
        changed(want={"numeric": [{"metric": "rent_total", "weight": 1, "best": 1, "worst": 1}]}), changed(want={"numeric": [{"metric": "luck", "weight": 1, "best": 1, "worst": 2}]}),
        changed(want={"numeric": [{"metric": "living_cost", "weight": 1, "best": 1, "worst": 2}]}),
    ],
)
def test_pattern_rules(raw):
    with pytest.raises(pattern.PatternError):
        pattern.parse(raw)


def test_select():
    one = pattern.parse(RAW)
    assert pattern.select([one], ["p"]) == [one] and pattern.select([one], None, {"TOCHI_BUY"}) == []
    with pytest.raises(pattern.PatternError):
        pattern.select([one], ["q"])


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)


def test_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_text("normalized_key,level,hazard_type,area_ratio,rank_avg,rank_max\na,chome,flood,0.5,1.2,3\nb,town,liquefaction,0,0,0\n")
    rows = masters.hazard_levels(spark, str(tmp_path / "h.csv")).collect()
    assert len(rows) == 6 and {r.value for r in rows if r.normalized_key == "b"} == {0.0}
    (tmp_path / "bad.csv").write_text("normalized_key,level,hazard_type,area_ratio,rank_avg,rank_max\na,chome,flood,1.5,1,3\n")
    with pytest.raises(Exception, match="out of range"):
        masters.hazard_levels(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "less.csv").write_text("normalized_key,level\na,chome\n")
    with pytest.raises(ValueError, match="columns missing"):
        masters.hazard_levels(spark, str(tmp_path / "less.csv"))
    (tmp_path / "a").mkdir()
    head = "prefecture,city,town,latitude,longitude,kind,city_code\n"
    (tmp_path / "a" / "1.csv").write_text(head + "P,C,大字原町,1,2,1,01\nP,C,原町,9,9,1,01\nP,C,中央3丁目,3,4,3,02\n")
    (tmp_path / "a" / "2.csv").write_text(head + "P,C,原町,7,7,1,01\nP,C,坂4丁目,x,4,1,03\n")
    found, seen = masters.address_points(spark, str(tmp_path / "a"))
    points = {r.key: (r.level, r.city_code, r.town_key, r.chome_number, r.longitude, r.latitude, r.merged) for r in found.collect()}
    # the first row of the first file counts, the others are named; a town keeps a name that ends like a block's
    assert points == {"PC原町": ("town", "01", "PC原町", None, 2.0, 1.0, ["原町", "原町"]), "PC中央3丁目": ("chome", "02", "PC中央", 3, 4.0, 3.0, []), "PC坂4丁目": ("town", "03", "PC坂4丁目", None, 4.0, None, [])}
    assert seen.get == {"rows": 5, "blocks": 1, "towns": 4, "without_place": 1}


def test_stations_and_their_counts_come_from_one_scan(spark, tmp_path):
    (tmp_path / "s.csv").write_text("station_cd,station_g_cd,station_name,line_cd,pref_cd,lon,lat,e_status\n1,1,A,10,13,0,0,0\n2,2,B,10,13,0,0,2\n3,3,C,11,13,0,0,0\n4,4,D,99,13,0,0,0\n")
    (tmp_path / "l.csv").write_text("line_cd,line_name,company_cd,e_status\n10,L,5,0\n11,M,5,1\n")
    (tmp_path / "c.csv").write_text("company_cd,company_name\n5,K\n")
    found, seen = masters.stations(spark, *(str(tmp_path / f"{x}.csv") for x in "slc"))
    assert [(r.station_cd, r.line_name, r.company_name) for r in found.collect()] == [("1", "L", "K")]
    assert seen.get == {"rows": 4, "closed_stations": 1, "closed_lines": 2}


def test_synced(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    table, counts = masters.synced(old, new, ["k"], ["v"])
    assert {tuple(r) for r in table.collect()} == {(1, "a"), (2, "x"), (4, "d")}
    assert counts.first().asDict() == {"inserted": 1, "removed": 1, "updated": 1}


def test_rate_tables(spark):
    page = "<p>x</p><table><tr><td>no</td></tr></table><table><tr><th>間取り</th><th>家賃相場</th></tr><tr><td>1 LDK</td><td>12.9 万円</td></tr><tr><td>1K</td><td>-</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id long, h string")
    rows = html.table_rows(pages, "id", "h", ("間取り", "家賃相場"))
    assert [tuple(r) for r in html.rates(rows, "id").collect()] == [(1, "1LDK", 129000)]


def test_stream_of_changes(spark, tmp_path):
    offers = "id int, type string, family string, price long, note string"
    stored = offers + ", status string, first_seen string, last_seen string"
    source = tmp_path / "in"

    def run():
        stream = spark.readStream.schema(offers).option("maxFilesPerTrigger", 1).json(str(source))
        changes.incremental(stream, str(tmp_path / "snap"), str(tmp_path / "events"), str(tmp_path / "check"), ["id"], ["price"], ["note"], lambda s: s.createDataFrame([], stored)).awaitTermination()

    source.mkdir()
    (source / "1.json").write_text('{"id":1,"type":"t","family":"f","price":10,"note":"n"}\n{"id":2,"type":"t","family":"f","price":5}\n')
    run()
    (source / "2.json").write_text('{"id":1,"type":"t","family":"f","price":8}\n')
    run()
    events = spark.read.parquet(str(tmp_path / "events")).collect()
    assert sorted((r.batch, r.id, r.event) for r in events) == [(0, 1, "new"), (0, 2, "new"), (1, 1, "price_down")]
    assert {(r.id, r.price, r.note) for r in changes.stored_rows(spark, str(tmp_path / "snap"), 1, spark.createDataFrame([], stored)).collect()} == {(1, 8, "n"), (2, 5, None)}


def test_a_scan_is_one_micro_batch(spark, tmp_path):
    """Requirements of the list page, upsert of touched buckets, groups, scores and events, batch by batch."""
    import json

    from lodeframe.operators import want
    from lodeframe.plans import pattern

    offers = "listing_id long, type string, family string, price long, note string, layout string, site_id long"
    stored = offers + ", status string, first_seen string, last_seen string"
    one = pattern.Pattern("p", "CHINTAI", {"rent_total_max": 100}, (), (want.Numeric("rent_total", 1, 0, 100),))

    def views(rows):
        price = F.col("price")
        return rows.select(
            "listing_id", "site_id", "layout", "status", price, price.alias("rent_total"), F.lit("CHINTAI").alias("property_family"), F.lit(1).alias("site_priority"), F.lit(0).alias("feature_count"),
            F.array().cast("array<string>").alias("feature_codes"), F.lit(True).alias("detail_fetched"), F.col("note").alias("dedup_key"),
        )

    def run(number, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(offers).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        step = changes.scores_of_changes(one, str(tmp_path / "scores"), views, ["listing_id"])
        changes.incremental(
            stream, str(tmp_path / "snap"), str(tmp_path / "events"), str(tmp_path / "check"), ["listing_id"], ["price", "layout", "site_id"], ["note"],
            lambda s: s.createDataFrame([], stored), {"layouts": ["1K"]}, step, buckets=8,
        ).awaitTermination()

    row = {"type": "t", "family": "F", "layout": "1K", "site_id": 1}
    run(0, [row | {"listing_id": k, "price": 10 * k, "note": f"g{k // 2}"} for k in range(1, 7)] + [row | {"listing_id": 9, "price": 1, "layout": "3LDK"}])
    before = changes.versions(spark, str(tmp_path / "snap"), 0)
    run(1, [row | {"listing_id": 3, "price": 5, "note": None}])
    after = changes.versions(spark, str(tmp_path / "snap"), 1)
    assert [k for k in before if before[k] != after[k]] and sum(v == 1 for v in after.values()) == 1
    rows = changes.stored_rows(spark, str(tmp_path / "snap"), 1, spark.createDataFrame([], stored)).collect()
    assert sorted((r.listing_id, r.price) for r in rows) == [(1, 10), (2, 20), (3, 5), (4, 40), (5, 50), (6, 60)]
    scores = spark.read.parquet(str(tmp_path / "scores")).collect()
    assert sorted((r.batch, r.dedup_key, r.listing_id, r.event) for r in scores) == [(0, "g0", 1, "new"), (0, "g1", 2, "new"), (0, "g2", 4, "new"), (0, "g3", 6, "new"), (1, "g1", 3, "price_down")]
