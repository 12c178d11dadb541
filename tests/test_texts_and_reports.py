import pytest
from pyspark.sql import functions as F

from lodeframe.functions import text
from lodeframe.operators import address, reports, stations
from lodeframe.sources.params import Param, query
from lodeframe.sources.robots import Robots


def column(spark, rows, f):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_addresses(spark):
    given = ["東京都足立区東和五丁目1-2", "足立区　東和5丁目地図を見る", "千葉県茂原市大字早野１２", "埼玉県霞ヶ関二十三丁目", None]
    made = column(spark, given, lambda c: address.comparable(text.nfkc(c), F.lit("東京都")))
    assert made == ["東京都足立区東和5丁目1-2", "東京都足立区東和5丁目", "千葉県茂原市早野12", "埼玉県霞が関23丁目", None]
    assert column(spark, ["十", "二十", "三十四", "九", "〇", "百"], address.kanji_number) == [10, 20, 34, 9, 0, None]


def test_blocks_are_confirmed_by_the_master(spark):
    master = spark.createDataFrame([("P町", None), ("P町", 3), ("Q村", None), ("早野", None)], "town_key string, chome_number int")
    rows = spark.createDataFrame([("P町3-1",), ("P町9-1",), ("Q村12",), ("R町4",), ("早野字下夕田1079",), ("P町3丁目5",), ("Q村",), (None,)], "a string")
    found = {r.a: r.address_normalized for r in address.resolved(rows, master, "a").collect()}
    assert found == {"P町3-1": "P町3丁目", "P町9-1": "P町", "Q村12": "Q村", "R町4": "R町4丁目", "早野字下夕田1079": "早野", "P町3丁目5": "P町3丁目", "Q村": "Q村", None: None}


def test_station_keys(spark):
    given = ["押上〈スカイツリー前〉", "押上駅", "ひばりヶ丘", "ひばりケ丘駅", "一之関", "一ノ関", "センター北"]
    made = column(spark, given, lambda c: address.station_key(text.nfkc(c)))
    assert made[0] == made[1] and made[2] == made[3] and made[4] == made[5] and made[6] == "センタ北"


ACCESS = [
    ("ＪＲ総武本線 千葉駅/バス乗車30分/千葉中央バス 大和田入口/徒歩2分", ["ＪＲ総武本線 千葉駅".split()[1][:-1]]),
    ("川越観光 「高坂ニュータウン入口」駅 徒歩3分", []),
    ("ＪＲ京浜東北線 「北浦和」駅 徒歩10分", ["北浦和"]),
    ("茅ヶ崎駅 「芹沢入口」駅 徒歩8分", ["茅ヶ崎"]),
]


@pytest.mark.parametrize(("given", "expected"), ACCESS)
def test_station_names(spark, given, expected):
    assert column(spark, [given], lambda c: stations.names(c)[0]) == [expected]


def test_walks_belong_to_stations(spark):
    given = ["武蔵小金井駅 歩5分 / 新小金井駅 バス12分 (バス停)中町4丁目 歩2分", "柏駅 大井まで徒歩6分", "小岩 歩10分", None]
    assert column(spark, given, stations.walks) == [{"武蔵小金井": 5}, {}, {"小岩": 10}, None]


def test_station_match(spark):
    master = spark.createDataFrame([(1, "赤羽"), (2, "浅草"), (3, "浅草"), (4, "本納")], "station_g_cd long, station_name string")
    rows = spark.createDataFrame([(1, "赤羽駅 歩5分 / 浅草駅 歩3分 / 無駅駅 歩1分"), (2, "ＪＲ外房線本納 徒歩9分"), (3, "どこか 徒歩9分"), (4, None)], "id int, t string")
    found = sorted((r.id, r.position, r.name, r.station_g_cd, r.status) for r in stations.matched(rows, master, "id", "t").collect())
    assert found == [(1, 0, "赤羽", 1, "matched"), (1, 1, "浅草", None, "ambiguous"), (1, 2, "無駅", None, "unmatched"), (2, 0, "本納", 4, "matched")]


def test_route_texts(spark):
    body = "乗換：1回\n所要時間：1時間3分\n08:32発　赤羽\n↓　ＪＲ埼京線　新宿行\n↓　6分　　200円\n08:38着　板橋\n08:40発 板橋\n↓　徒歩\n↓　4分\n(直通) 新板橋\n↓　三田線\n↓　10分\n08:55着 巣鴨\n09:00発 巣鴨\n09:10着 どこ"
    rows = stations.legs(spark.createDataFrame([(1, body), (2, None)], "id int, t string"), "id", "t").orderBy("leg").collect()
    assert [(r.line, r.minutes, r.from_name, r.to_name, r.is_walk) for r in rows] == [("ＪＲ埼京線", 6, "赤羽", "板橋", False), ("徒歩", 4, "板橋", "新板橋", True), ("三田線", 10, "新板橋", "巣鴨", False)]
    assert {(r.transfers, r.total_minutes) for r in rows} == {(1, 63)}
    made = stations.segments(spark.createDataFrame([("a", "b", "x", 3), ("a", "b", "x", 5), ("c", "c", "x", 1)], "from_name string, to_name string, line string, minutes int")).collect()
    assert [tuple(r) for r in made] == [("a", "b", "x", 3, 5, 2)]


def test_rotation_claim(spark):
    state = spark.createDataFrame([("s", "p", "2026-01-02", "1"), ("s", "q", "2026-01-01", "2"), ("t", "p", None, None), ("t", "q", "2020-01-01", "9")], "site string, pattern string, scanned_at string, cursor string")
    assert {tuple(r) for r in address.claimed(state, ["p", "q"]).collect()} == {("s", "q", "2"), ("t", "p", None)}


def test_display(spark):
    prices = spark.createDataFrame([(None,), (35_000_000,), (128_000_000,), (200_000_000,), (12_345_678,)], "v long")
    assert [r.x for r in prices.select(reports.man_yen(F.col("v")).alias("x")).collect()] == ["価格未定", "3,500万円", "1億2,800万円", "2億円", "1,234.6万円"]
    assert [r.x for r in prices.select(reports.yen_text(F.col("v")).alias("x")).limit(2).collect()] == ["—", "35,000,000円"]
    offer = spark.createDataFrame([("1K", 20.5, None, 5, None, ["注意"], 90.0)], "layout string, area_sqm double, age_years int, walk_minutes int, commute_minutes int, caveats array<string>, land_area_sqm double")
    assert offer.select(reports.summary_line(F.lit(False)).alias("a"), reports.summary_line(F.lit(True)).alias("b")).first()[:] == ("1K / 20.5㎡ / 築年不明 / 徒歩5分 / ⚠注意", "土地90.0㎡ / 徒歩5分 / ⚠注意")
    places = spark.createDataFrame([([("a", 1, 2), ("b", None, None)],), ([],)], "s array<struct<name:string,walk:int,ride:int>>")
    assert [r.x for r in places.select(reports.access_lines(F.col("s"), 1).alias("x")).collect()] == ["・a 徒歩1分 → 通勤2分\n（ほか1駅）", None]
    assert [r.x for r in spark.createDataFrame([(None,), (0.0,), (1.5,)], "v double").select(reports.hazard_text(F.col("v")).alias("x")).collect()] == ["unresolved", "outside", "1.50"]
    market = "city_name string, layout string, price long, rate_value double, market_rate_ratio double"
    rows = spark.createDataFrame([(None, "1K", 1, None, None), ("足立区", None, 1, None, None), ("足立区", "1K", 1, 70000.0, None), ("足立区", "1K", 1, 70000.0, 0.9)], market)
    assert [r.x for r in rows.select(reports.market_text(F.lit("CHINTAI")).alias("x")).collect()] == ["相場不明（市区を特定できず）", "相場不明（間取り不明）", "相場7万円/月（比較不可）", "相場比0.90（相場7万円/月）"]


def test_market_report(spark):
    rows = spark.createDataFrame([("g", float(k), 10.0 - k, k % 2 == 0) for k in range(10)] + [("g", None, 1.0, True)], "g string, ratio double, price double, ok boolean")
    made = reports.market_report(rows, ["g"], "ratio", "price", F.col("ok")).first()
    assert (round(made.share, 4), made.enough, made.spearman, made.distinct, made.p50) == (0.9091, True, -1.0, False, 4.0)


def test_robots():
    rules = Robots("User-agent: *\nDisallow: /api/\n# note\nUser-agent: bot\nAllow: /x\nDisallow: /\n\nUser-agent: *\nDisallow: /*?*sort=\nDisallow: /end$\n")
    allowed = {u: rules.allows("reader/1.0", "https://a.b" + u) for u in ("/api/1", "/list?x=1&sort=2", "/end", "/end2", "/", "")}
    assert allowed == {"/api/1": False, "/list?x=1&sort=2": False, "/end": False, "/end2": True, "/": True, "": True}
    assert rules.allows("My-Bot/2", "https://a.b/x/1") and not rules.allows("My-Bot/2", "https://a.b/y")
    assert Robots("").allows("any", "https://a.b/") and Robots("User-agent: *\nDisallow:").allows("any", "https://a.b/")


def test_params_round_outwards():
    rent = Param("rent_total_max", "cb", divisor=10_000, grid=("3.0", "100.0", "0.5"))
    assert rent.render(82_000) == {"cb": ["8.5"]} and rent.render(20_000) == {"cb": ["3.0"]} and rent.render(2_000_000) is None
    area = Param("area_min", "mb", upper=False, choices=(20, 25, 30), codes={"20": "k1", "25": "k2", "30": "k3"})
    assert area.render(27) == {"mb": ["k2"]} and area.render(10) is None
    sets = Param("layouts", "md", mapping={"1K": "02", "1LDK": "04"})
    assert sets.render(["1K", "1LDK"]) == {"md": ["02", "04"]} and sets.render(["1K", "9Z"]) is None and sets.render([]) is None
    assert query([sets, area, rent], {"layouts": ["1K"], "rent_total_max": 82_000}) == [("md", "02"), ("cb", "8.5")]
    with pytest.raises(ValueError, match="no code"):
        Param("area_min", "mb", upper=False, choices=(20,), codes={"1": "k"}).render(20)
