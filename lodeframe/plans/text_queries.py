"""Registered queries of text parsing, addresses, stations, masters and display.

Every text is spelt from columns of a table, row by row, so the twin can say from the same columns
what a parser must find.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import numbers, text
from lodeframe.operators import address, features, must, reports, stations, want
from lodeframe.plans.frames import listings, spread, table
from lodeframe.plans.queries import FEATURES, MUST_SQL, NUMERICS, SCORE_SQL, query
from lodeframe.sources import html, masters
from lodeframe.sources.robots import Robots
from lodeframe.sources.stored import shared_dir, written


def spelt(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _csv(rows: DataFrame) -> str:
    """A derived table as a CSV file in the shared folder: what the masters read."""
    path = f"{shared_dir(rows.sparkSession)}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return path


def _whole(name: str) -> Column:
    return F.floor(name).cast("long")


@query(
    """WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 997 AS p FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN p >= 100000000 THEN p // 10000 * 10000 WHEN p >= 10000 THEN p ELSE p END AS yen FROM p""",
    offers=False,
)
def parse_money(spark, sf_dir):
    p = _whole("o_totalprice") * 997
    large, middle, rest = F.floor(p / 100_000_000), F.floor(p % 100_000_000 / 10_000), p % 10_000
    words = F.when(F.col("o_orderkey") % 7 == 0, "価格未定").when(p >= 100_000_000, spelt(large, "億", F.when(middle > 0, spelt(F.format_number(middle, 0), "万")).otherwise(""), "円"))
    words = words.when(p >= 10_000, spelt(middle, "万", F.when(rest > 0, spelt(rest)).otherwise(""), "円")).otherwise(spelt(F.format_number(p, 0), "円"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.yen(words).alias("yen"))


@query(
    """WITH p AS (SELECT o_orderkey, o_orderpriority AS k, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
    SELECT o_orderkey, CASE k WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN p WHEN '4-NOT SPECIFIED' THEN NULL ELSE 0 END AS fee,
        CASE k WHEN '1-URGENT' THEN CAST(round_even(p * 1.5, 0) AS BIGINT) WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN p WHEN '4-NOT SPECIFIED' THEN NULL ELSE 0 END AS deposit FROM p""",
    offers=False,
)
def parse_fees(spark, sf_dir):
    k, p = F.col("o_orderpriority"), _whole("o_totalprice")
    said = F.when(k == "1-URGENT", "-").when(k == "2-HIGH", "なし").when(k == "3-MEDIUM", spelt(F.format_number(p, 0), "円")).when(k == "4-NOT SPECIFIED", F.lit(None)).otherwise("")
    months = F.when(k == "1-URGENT", "1.5ヶ月").otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.fee(said).alias("fee"), text.months_fee(months, p).alias("deposit"))


@query(
    """SELECT p_partkey, p_size + 0.5 AS area, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN NULL ELSE p_size END AS age, p_size % 20 + 1 AS walk,
        CASE WHEN p_size % 4 = 0 THEN -(p_size % 3 + 1) ELSE p_size % 9 + 1 END AS floor, p_size % 30 + 2 AS total FROM part""",
    offers=False,
)
def parse_sizes(spark, sf_dir):
    n = F.col("p_size")
    age = F.when(n % 5 == 0, "新築").when(n % 5 == 1, "中古").otherwise(spelt("築", n, "年"))
    floor = F.when(n % 4 == 0, spelt("地下", n % 3 + 1, "階")).otherwise(spelt(n % 9 + 1, "-", n % 9 + 1, "階"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.area(text.nfkc(spelt("専有 ", n, ".5㎡"))).alias("area"), text.age(age).alias("age"),
        text.walk(spelt("Ａ駅 徒歩", n % 20 + 9, "分 / Ｂ駅 歩", n % 20 + 1, "分")).alias("walk"), text.floor(floor).alias("floor"), text.total_floors(spelt("地上", n % 30 + 2, "階地下1階建")).alias("total"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01') AS built, CAST(greatest(1998 - year(o_orderdate) - CASE WHEN 6 < month(o_orderdate) THEN 1 ELSE 0 END, 0) AS INTEGER) AS years FROM orders""",
    offers=False,
)
def parse_dates(spark, sf_dir):
    at = text.built_on(spelt(F.year("o_orderdate"), "年", F.month("o_orderdate"), "月築"))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", at.alias("at"))  # read once, referred to several times
    return rows.select("o_orderkey", F.col("at").cast("string").alias("built"), text.full_years(F.col("at"), F.lit("1998-06-15").cast("date")).alias("years"))


@query(
    """WITH p AS (SELECT p_partkey, p_size AS a, p_size + CAST(floor(p_retailprice) AS BIGINT) % 50 AS b FROM part)
    SELECT p_partkey, CASE WHEN a % 6 <> 0 THEN least(a, b) * 10000 END AS least, CASE WHEN a % 6 <> 0 THEN greatest(a, b) * 10000 END AS most FROM p""",
    offers=False,
)
def parse_ranges(spark, sf_dir):
    a, b = F.col("p_size").cast("long"), F.col("p_size") + _whole("p_retailprice") % 50
    words = F.when(a % 6 == 0, "価格未定").when(a % 6 == 1, spelt(a, "万円・", b, "万円")).otherwise(spelt(a, "万円台～", b, "万円台※1万円単位／予定 9999万円"))
    low, high = text.price_range(words)
    return table(spark, sf_dir, "part").select("p_partkey", low.alias("least"), high.alias("most"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 9 * 60 + event_id % 60 END AS INTEGER) AS minutes FROM events", offers=False)
def parse_durations(spark, sf_dir):
    n = F.col("event_id")
    words = F.when(n % 5 == 0, "不明").when(n % 9 == 0, spelt(n % 60, "分")).otherwise(spelt(n % 9, "時間", n % 60, "分"))
    return table(spark, sf_dir, "events").select("event_id", text.minutes(words).alias("minutes"))


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN false WHEN '3-MEDIUM' THEN true END AS leasehold,
        CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN false WHEN '3-MEDIUM' THEN false END AS build_condition,
        concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN '条件付' END, CASE WHEN o_orderstatus = 'F' THEN '再建築不可' END) AS caveats, o_orderstatus = 'F' AS no_rebuild FROM orders""",
    offers=False,
)
def parse_rights(spark, sf_dir):
    k, f = F.col("o_orderpriority"), F.col("o_orderstatus") == "F"
    rights = F.when(k == "1-URGENT", "所有権・借地権").when(k == "2-HIGH", "所有権の共有").when(k == "3-MEDIUM", "地上権（旧）").when(k == "4-NOT SPECIFIED", "‐")
    condition = F.when(k == "1-URGENT", " 付").when(k == "2-HIGH", "-").when(k == "3-MEDIUM", "なし").when(k == "4-NOT SPECIFIED", "一部建築条件付")
    attributes = F.create_map(F.lit("condition"), (k == "1-URGENT").cast("string"), F.lit("rebuild"), F.when(f, "true").otherwise("付"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.leasehold(rights).alias("leasehold"), text.build_condition(condition).alias("build_condition"),
        F.concat_ws(",", text.caveats(attributes, {"condition": "条件付", "rebuild": "再建築不可"})).alias("caveats"), text.rebuild_prohibited(F.array(F.lit(None), F.when(f, "※再建築不可"))).alias("no_rebuild"),
    )


@query(
    """SELECT c_custkey, '市' || c_custkey AS address, '区' || c_custkey || '-3001' AS town, CASE WHEN c_custkey % 3 = 0 THEN '駅' || c_custkey END AS note,
        CASE WHEN c_custkey % 2 = 0 THEN '/rank/' || c_custkey ELSE '/' END AS next FROM customer""",
    offers=False,
)
def parse_addresses(spark, sf_dir):
    n = F.col("c_custkey")
    target = F.when(n % 2 == 0, spelt("/rank/", n)).when(n % 3 == 0, spelt("//x/", n)).otherwise(spelt("http://x/", n))
    return table(spark, sf_dir, "customer").select(
        n, text.address_cleaned(spelt("市", n, "地図を見る 周辺地図")).alias("address"), text.address_without_lot(spelt("区", n, "-3001（地番）ほか")).alias("town"),
        F.get(text.without_note(F.when(n % 3 == 0, spelt("駅", n, "〔新線〕")).otherwise(spelt("駅", n))), F.lit(1)).alias("note"), text.safe_next(target).alias("next"),
    )


ALLEYS = "一二三四五六七八九"


@query(
    """SELECT c_custkey, '千葉県' || c_mktsegment || '町' || CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 9 + 1) || '丁目' || c_custkey % 20 || '-3' WHEN c_custkey % 3 = 1 THEN (c_custkey % 12) || '-' || c_custkey % 20 ELSE '' END AS comparable,
        '千葉県' || c_mktsegment || '町' || CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 9 + 1) || '丁目' WHEN c_custkey % 3 = 1 AND c_custkey % 12 BETWEEN 1 AND 5 THEN (c_custkey % 12) || '丁目' ELSE '' END AS resolved FROM customer""",
    offers=False,
)
def address_blocks(spark, sf_dir):
    n, town = F.col("c_custkey"), spelt("大字", F.col("c_mktsegment"), "町")
    alley = F.substring(F.lit(ALLEYS), (n % 9 + 1).cast("int"), F.lit(1))
    words = F.when(n % 3 == 0, spelt(" ", town, alley, "丁目", n % 20, "－3")).when(n % 3 == 1, spelt(town, n % 12, "ー", n % 20, "地図")).otherwise(town)
    rows = table(spark, sf_dir, "customer").select(n, "c_mktsegment", address.comparable(text.nfkc(words), F.lit("千葉県")).alias("comparable"))
    known = rows.select(spelt("千葉県", F.col("c_mktsegment"), "町").alias("town_key")).distinct().withColumn("chome_number", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5)))))
    return address.resolved(rows, known, "comparable").select("c_custkey", "comparable", F.col("address_normalized").alias("resolved"))


@query(
    """WITH g AS (SELECT n_name, count(DISTINCT s_suppkey % 2) AS groups, min(s_suppkey % 2) AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT c_custkey, 0 AS position, n_name AS name, CASE WHEN groups = 1 THEN g END AS station_g_cd, CASE WHEN groups = 1 THEN 'matched' WHEN groups > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN g USING (n_name)""",
    offers=False,
)
def station_matches(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 2).alias("station_g_cd"), F.col("n_name").alias("station_name"))
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = people.select("c_custkey", spelt("本線「", F.col("n_name"), "」駅 徒歩", F.col("c_custkey") % 9 + 1, "分").alias("access"))
    return stations.matched(rows, named, "c_custkey", "access")


@query(
    """SELECT c_custkey, 'S' || c_custkey % 50 || 'ノ' AS station, 'ケ' || c_custkey || 'ノ' AS city, c_custkey % 30 + 1 AS walk, 'W' || c_custkey || 'x' AS alone FROM customer""",
    offers=False,
)
def station_words(spark, sf_dir):
    n = F.col("c_custkey")
    found = stations.read(spelt("Ａ線 「駅前", n, "」駅 徒歩", n % 30 + 1, "分 / 港町", n, "駅 バス9分 (バス停)橋 歩1分"))
    walk = F.element_at(found["walks"], spelt("駅前", n))
    return spread(table(spark, sf_dir, "customer").select(n)).select(
        n, F.upper(address.station_key(spelt("S・", n % 50, "之〈南〉駅"))).alias("station"), address.city_key(spelt("ヶ", n, "之")).alias("city"), walk.alias("walk"),
        F.element_at(stations.variants(spelt("徒歩5分新線W", n, "x")), -1).alias("alone"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'P' || l_partkey % 40 AS from_name, 'P' || l_suppkey % 30 AS to_name, CAST(l_quantity AS INTEGER) AS minutes, l_linenumber % 4 AS transfers, CAST(60 + l_quantity AS INTEGER) AS total_minutes FROM lineitem""",
    offers=False,
)
def route_legs(spark, sf_dir):
    n = F.col("l_quantity").cast("int")
    body = spelt("乗換：", F.col("l_linenumber") % 4, "回\n所要時間：1時間", n, "分\n08:00発 P", F.col("l_partkey") % 40, "\n↓ 本線 急行\n↓ ", n, "分 200円\n09:00着 P", F.col("l_suppkey") % 30)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(F.struct(*keys).alias("k"), body.alias("t"))
    return stations.legs(rows, "k", "t").select("k.*", "from_name", "to_name", "minutes", "transfers", "total_minutes")


@query(
    """SELECT p_partkey, unnest(['1R', '2LDK']) AS layout, unnest([p_size * 1000, p_size * 2000]) AS rent_yen FROM part WHERE p_size % 10 <> 0""",
    offers=False,
)
def html_rates(spark, sf_dir):
    n = F.col("p_size")
    cells = spelt("<tr><td>ワンルーム</td><td> ", F.round(n / 10, 1), "万円</td></tr><tr><td>2ＬＤＫ</td><td>", F.round(n / 5, 1), "万円</td></tr>")
    page = spelt("<table><tr><td>地図</td></tr></table><table><tr><th>間取り</th><th>", F.when(n % 10 == 0, "駐車場").otherwise("家賃相場"), "</th></tr>", cells, "</table>")
    rows = html.table_rows(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", page.alias("html")), "p_partkey", "html", ("間取り", "家賃相場"))
    return html.rates(rows, "p_partkey")


RULES = "User-agent: *\nDisallow: /a/\nAllow: /b\nUser-agent: own\nDisallow: /*?page=\nAllow: /\n"


@query("SELECT page_id, url, NOT contains(url, '?page=') AS own, NOT starts_with(regexp_replace(url, '^https?://[^/]+', ''), '/a/') AS other FROM pages", offers=False)
def robots_rules(spark, sf_dir):
    rules = Robots(RULES)
    allowed = lambda agent: F.pandas_udf(lambda urls: urls.map(lambda u: rules.allows(agent, u)), "boolean")
    return table(spark, sf_dir, "pages").select("page_id", "url", allowed("own/1.0")("url").alias("own"), allowed("else")("url").alias("other"))


@query(
    """WITH r AS (SELECT p_brand AS city, p_type AS layout, CAST(max(p_size) * 1000 + 10000 AS DOUBLE) AS rate_value FROM part GROUP BY 1, 2) SELECT city, layout, rate_value, 'rent_listed_mansion' AS stat_basis FROM r""",
    offers=False,
)
def rent_rate_master(spark, sf_dir):
    rates = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("city"), F.col("p_type").alias("layout")).agg((F.max("p_size") * 1000 + 10000).alias("rate_value"))
    path = _csv(rates.withColumn("stat_basis", F.lit("rent_listed_mansion")).withColumn("period", F.lit("2026-09")))
    return masters.rent_rates(spark, path).select("city", "layout", "rate_value", "stat_basis")


@query(
    """SELECT s_nationkey AS family_key, CAST(count(*) + 9 AS INTEGER) AS sample_count, CAST(floor(max(s_acctbal)) + 20000 AS DOUBLE) AS rate_value FROM supplier GROUP BY 1""",
    offers=False,
)
def purchase_rate_master(spark, sf_dir):
    made = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("city")).agg((F.count(F.lit(1)) + 9).alias("sample_count"), (F.floor(F.max("s_acctbal")) + 20000).alias("rate_value"))
    path = _csv(made.select(F.lit("MANSION_BUY").alias("family"), "city", F.lit("AREA_SQM").alias("segment"), "rate_value", F.lit("trade").alias("stat_basis"), "sample_count", F.lit("2026Q1").alias("period")))
    return masters.purchase_rates(spark, path).select(F.col("city").cast("long").alias("family_key"), "sample_count", "rate_value")


@query(
    """WITH s AS (SELECT s_suppkey AS station_cd, s_nationkey AS line_cd, s_acctbal >= 0 AS runs, s_nationkey % 5 <> 0 AS line_runs FROM supplier)
    SELECT station_cd, line_cd, (SELECT count(*) FROM s WHERE NOT runs) AS closed_stations, (SELECT count(*) FROM s WHERE runs AND NOT line_runs) AS closed_lines FROM s WHERE runs AND line_runs""",
    offers=False,
)
def station_master(spark, sf_dir):
    n = F.col("s_nationkey")
    places = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_cd"), F.col("s_suppkey").alias("station_g_cd"), F.col("s_name").alias("station_name"), n.alias("line_cd"), n.alias("pref_cd"), F.lit(139.0).alias("lon"), F.lit(35.0).alias("lat"),
        F.when(F.col("s_acctbal") >= 0, 0).otherwise(2).alias("e_status"),
    )
    lines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line_cd"), F.col("n_name").alias("line_name"), F.col("n_regionkey").alias("company_cd"), F.when(F.col("n_nationkey") % 5 != 0, 0).otherwise(2).alias("e_status"))
    companies = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("company_cd"), F.col("r_name").alias("company_name"))
    found, seen = masters.stations(spark, _csv(places), _csv(lines), _csv(companies))
    stored = written(found.select(F.col("station_cd").cast("long"), F.col("line_cd").cast("long")))  # rows and counts of one scan
    counts = seen.get
    return stored.select("*", *(F.lit(counts[x]).alias(x) for x in ("closed_stations", "closed_lines")))


@query(
    """SELECT DISTINCT l_suppkey % 100 AS a, l_partkey % 100 AS b FROM lineitem WHERE l_suppkey % 100 <> l_partkey % 100""",
    offers=False,
)
def link_master(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("station_cd1"), (F.col("l_partkey") % 100).alias("station_cd2")).where("station_cd1 <> station_cd2").distinct()
    return masters.links(spark, _csv(pairs))


@query(
    """WITH k AS (SELECT p_brand AS k, 'town' AS level, 'flood' AS h, count(*) AS n, max(p_size) AS m FROM part GROUP BY 1)
    SELECT k AS normalized_key, unnest(['area_ratio', 'rank_avg', 'rank_max']) AS aggregation, unnest([0.5, CAST(m AS DOUBLE), CAST(n AS DOUBLE)]) AS value FROM k""",
    offers=False,
)
def hazard_master(spark, sf_dir):
    made = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("normalized_key")).agg(F.count(F.lit(1)).alias("rank_max"), F.max("p_size").alias("rank_avg"))
    path = _csv(made.select("normalized_key", F.lit("town").alias("level"), F.lit("flood").alias("hazard_type"), F.lit(0.5).alias("area_ratio"), "rank_avg", "rank_max"))
    return masters.hazard_levels(spark, path).select("normalized_key", "aggregation", "value")


@query(
    """SELECT '千葉県' || '市' || p_brand || '町' || p_size || '丁目' AS key, 'chome' AS level, '千葉県市' || p_brand || '町' AS town_key, CAST(p_size AS INTEGER) AS chome_number, 35.5 AS latitude FROM part GROUP BY ALL""",
    offers=False,
)
def address_master(spark, sf_dir):
    towns = table(spark, sf_dir, "part").select(F.lit("千葉県").alias("prefecture"), F.lit("市").alias("city"), spelt("大字", F.col("p_brand"), "町", F.col("p_size"), "丁目").alias("town"), F.lit(35.5).alias("latitude"), F.lit(140.1).alias("longitude"), F.lit("3").alias("kind")).distinct()
    return masters.address_points(spark, _csv(towns))[0].select("key", "level", "town_key", "chome_number", "latitude")


@query(
    """SELECT o_orderkey, CASE WHEN p >= 100000000 THEN p // 100000000 || '億' || CASE WHEN p % 100000000 >= 10000 THEN format('{:,}', p % 100000000 // 10000) || '万' ELSE '' END || '円'
        WHEN p % 10000 = 0 THEN format('{:,}', p // 10000) || '万円' ELSE format('{:,.1f}', p / 10000.0) || '万円' END AS man_yen, format('{:,}', p) || '円' AS yen FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS p FROM orders)""",
    offers=False,
)
def money_texts(spark, sf_dir):
    p = _whole("o_totalprice") * 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.man_yen(p).alias("man_yen"), reports.yen_text(p).alias("yen"))


@query(
    """ SELECT listing_id, CASE WHEN property_family = 'TOCHI_BUY' THEN concat_ws(' / ', CASE WHEN land_area_sqm IS NULL THEN '土地面積不明' ELSE format('土地{:.1f}㎡', land_area_sqm) END, CASE WHEN walk_minutes IS NULL THEN '徒歩不明' ELSE '徒歩' || walk_minutes || '分' END)
        ELSE concat_ws(' / ', layout, format('{:.1f}㎡', area_sqm), '築' || age_years || '年', CASE WHEN walk_minutes IS NULL THEN '徒歩不明' ELSE '徒歩' || walk_minutes || '分' END) END AS line FROM listings"""
)
def summary_lines(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("commute_minutes", F.lit(None).cast("int")).withColumn("caveats", F.array().cast("array<string>"))
    return rows.select("listing_id", reports.summary_line(F.col("property_family") == "TOCHI_BUY").alias("line"))


@query(
    """WITH s AS (SELECT l_partkey AS unit, l_suppkey AS p, l_linenumber AS w FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p, w) AS k, count(*) OVER (PARTITION BY unit) AS c FROM s)
    SELECT unit, string_agg('・S' || p || ' 徒歩' || w || '分', chr(10) ORDER BY k) FILTER (WHERE k <= 4) || CASE WHEN max(c) > 4 THEN chr(10) || '（ほか' || (max(c) - 4) || '駅）' ELSE '' END AS lines FROM n GROUP BY 1""",
    offers=False,
)
def access_texts(spark, sf_dir):
    near = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("p"), F.col("l_linenumber").alias("w")).distinct()
    made = near.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("s"))
    places = F.transform("s", lambda x: F.struct(F.concat(F.lit("S"), x["p"].cast("string")).alias("name"), x["w"].alias("walk"), F.lit(None).cast("int").alias("ride")))
    return made.select("unit", reports.access_lines(places).alias("lines"))


@query(
    MUST_SQL + SCORE_SQL
    + """, w AS (SELECT listing_id, list_filter([{'p': -p4, 'c': 'rent_total'}, {'p': -p1, 'c': 'GAS_CITY|GAS_LPG'}, {'p': -p3, 'c': 'area_sqm'}, {'p': -p2, 'c': 'STOVE_IH'}, {'p': -p5, 'c': 'walk_minutes'}], lambda x: x.p < 0) AS h FROM points)
    SELECT listing_id, array_to_string(list_transform(list_sort(h)[1:3], lambda x: x.c), ',') AS top FROM w"""
)
def top_hits(spark, sf_dir):
    made = want.scored(listings(spark, sf_dir), FEATURES, NUMERICS)
    return made.select("listing_id", F.array_join(want.top_hits(F.col("score_items")), ",").alias("top"))


@query(
    """ SELECT listing_id, CASE WHEN unit_id % 3 = 0 THEN 'unknown' WHEN unit_id % 3 = 1 THEN 'fail' ELSE 'pass' END AS freehold, CASE WHEN unit_id % 5 = 0 THEN 'unknown' WHEN unit_id % 5 = 1 THEN 'fail' ELSE 'pass' END AS condition FROM listings"""
)
def must_flags(spark, sf_dir):
    unit = F.col("unit_id")
    rows = listings(spark, sf_dir).withColumn("leasehold", F.when(unit % 3 != 0, unit % 3 == 1)).withColumn("build_condition", F.when(unit % 5 != 0, unit % 5 == 1))
    made = must.evaluated(rows, {"freehold_only": True, "exclude_build_condition": True})
    by = lambda name: F.get(F.filter("must_checks", lambda x: x["name"] == name), F.lit(0))["result"]
    return made.select("listing_id", by("freehold_only").alias("freehold"), by("exclude_build_condition").alias("condition"))


LIMITS = {"price_max": ("price", 30000), "area_max": ("area_sqm", 30), "land_area_min": ("land_area_sqm", 60), "building_area_min": ("building_area_sqm", 40), "age_max": ("age_years", 20)}


@query(
    """ SELECT listing_id, CASE WHEN price IS NULL THEN 'unknown' WHEN price <= 30000 THEN 'pass' ELSE 'fail' END AS price_max, CASE WHEN area_sqm <= 30 THEN 'pass' ELSE 'fail' END AS area_max,
        CASE WHEN land_area_sqm IS NULL THEN 'unknown' WHEN land_area_sqm >= 60 THEN 'pass' ELSE 'fail' END AS land_area_min, CASE WHEN building_area_sqm IS NULL THEN 'unknown' WHEN building_area_sqm >= 40 THEN 'pass' ELSE 'fail' END AS building_area_min,
        CASE WHEN age_years <= 20 THEN 'pass' ELSE 'fail' END AS age_max FROM listings"""
)
def must_limits(spark, sf_dir):
    made = must.evaluated(listings(spark, sf_dir), {name: limit for name, (_, limit) in LIMITS.items()})
    by = F.map_from_entries("must_checks")
    return made.select("listing_id", *(F.element_at(by, name).alias(name) for name in LIMITS))


@query(""" SELECT listing_id, CASE WHEN price IS NULL THEN mgmt_fee_monthly ELSE price + coalesce(mgmt_fee_monthly, 0) END AS monthly, CASE WHEN walk_minutes = 1 THEN 0 ELSE CAST(ceil(8.7 + area_sqm * 1.14 + unit_id % 3 * 5.6) AS INTEGER) END AS commute FROM listings""")
def monthly_and_commute(spark, sf_dir):
    here = F.coalesce(F.col("walk_minutes") == 1, F.lit(False))
    return listings(spark, sf_dir).select("listing_id", numbers.monthly_cost(F.col("price"), F.col("mgmt_fee_monthly")).alias("monthly"), numbers.commute_estimate(F.col("area_sqm"), F.col("unit_id") % 3, here).alias("commute"))


@query(
    """ SELECT listing_id, concat_ws(',', CASE WHEN age_years <= 3 THEN 'FEAT_NEW' END, CASE WHEN floor_num = 1 THEN 'LOC_FLOOR_1' END, CASE WHEN floor_num >= 2 THEN 'LOC_FLOOR_2UP' END, CASE WHEN unit_id % 12 + 1 > 1 AND floor_num = unit_id % 12 + 1 THEN 'LOC_TOP_FLOOR' END) AS codes FROM listings"""
)
def derived_features(spark, sf_dir):
    made = features.derived(F.col("floor_num"), F.col("unit_id") % 12 + 1, F.col("age_years"))
    return listings(spark, sf_dir).select("listing_id", F.concat_ws(",", made).alias("codes"))


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize(lower(CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END)), '\\s+', ' ', 'g'), ' ') AS t FROM (SELECT doc_id, 'A  B' || doc_id || chr(10) || ' c' AS text FROM documents)", offers=False)
def normalised_texts(spark, sf_dir):
    n = F.col("doc_id")
    words = F.when(n % 4 != 0, spelt("Ａ　 B", n, "\n ｃ "))
    return table(spark, sf_dir, "documents").select(n, text.normalized(words).alias("t"))


@query(
    """SELECT s_suppkey, CAST(floor((139.0 + s_suppkey % 70 / 100.0 + 180) / 360 * 1024) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(35.0 + s_suppkey % 50 / 100.0))) / pi()) / 2 * 1024) AS BIGINT) AS y FROM supplier""",
    offers=False,
)
def map_tiles(spark, sf_dir):
    key = F.col("s_suppkey")
    made = numbers.tile(F.lit(35.0) + key % 50 / 100.0, F.lit(139.0) + key % 70 / 100.0, 10)
    return table(spark, sf_dir, "supplier").select(key, made["x"].alias("x"), made["y"].alias("y"))


@query("SELECT o_orderkey, 'a' || chr(10) || o_orderkey AS memo, CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved' WHEN o_orderkey % 3 = 1 THEN 'outside' ELSE format('{:,.2f}', o_orderkey / 4.0) END AS hazard FROM orders", offers=False)
def memo_and_hazard_texts(spark, sf_dir):
    n = F.col("o_orderkey")
    value = F.when(n % 3 == 1, F.lit(0.0)).when(n % 3 == 2, n / 4.0)
    return table(spark, sf_dir, "orders").select(n, text.memo(spelt("a\r\n", n, "\x07")).alias("memo"), reports.hazard_text(value).alias("hazard"))


@query(
    """SELECT o_orderkey, 'S' || o_custkey || '駅 / T' || o_custkey || '駅' AS names, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 15 + 2 AS INTEGER) END AS walk, quarters FROM (
        SELECT *, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) || CASE WHEN quarter(o_orderdate) = 1 THEN '' ELSE '-1999Q1' END AS quarters FROM orders)""",
    offers=False,
)
def access_choices(spark, sf_dir):
    n, q = F.col("o_custkey"), spelt(F.year("o_orderdate"), F.quarter("o_orderdate"))
    first = F.when(n % 3 == 0, spelt("Ａ線｢S", n, "｣駅バス7分 徒歩1～11分")).otherwise(spelt("Ａ線「S", n, "」駅 徒歩", n % 15 + 2, "～", n % 15 + 9, "分 または バス3分 徒歩1分"))
    names, walk = text.access_choices(F.array(first, spelt("Ｂ線「T", n, "」駅バス9分 徒歩1分")))
    last = F.when(F.quarter("o_orderdate") == 1, q).otherwise("19991")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.alias("names"), walk.alias("walk"), text.quarter_label(q, last).alias("quarters"))


@query(
    """SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) + 5 END, 0) AS rent FROM orders""",
    offers=False,
)
def room_rents(spark, sf_dir):
    p = _whole("o_totalprice")
    rent = F.when(F.col("o_orderkey") % 2 == 0, spelt(F.format_number(p, 0), "円")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.room_rent(rent, spelt(p + 5, "円")).alias("rent"))
