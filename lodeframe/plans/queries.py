"""Registered queries of the offer operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions import numbers, text
from lodeframe.operators import enrich, features, graph, grouping, marks, must, pages, snapshot, stats, want
from lodeframe.plans import pattern as patterns
from lodeframe.plans.frames import LISTINGS_SQL, listing_id, listings, table
from lodeframe.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, offers: bool = True):
    """Register a query with its twin; `offers` puts the derived offers in front of the SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {LISTINGS_SQL} {sql}" if offers else sql
        return f

    return register


WANTED = {"rent_total_max": 40000, "layouts": ["1K", "1LDK"], "area_min": 10, "walk_minutes_max": 15, "floor_min": 2, "features": ["STOVE_IH"]}
FEATURES = [want.Feature(("STOVE_IH",), 10), want.Feature(("GAS_CITY", "GAS_LPG"), 20)]
NUMERICS = [want.Numeric("rent_total", 40, 10000, 60000), want.Numeric("area_sqm", 20, 50, 10), want.Numeric("walk_minutes", 10, 1, 20, "zero")]

MUST_SQL = """, verdicts AS (
    SELECT *,
        CASE WHEN rent_total IS NULL THEN 1 WHEN rent_total <= 40000 THEN 0 ELSE 2 END AS c1,
        CASE WHEN plain_layout IN ('1K', '1LDK') THEN 0 ELSE 2 END AS c2,
        CASE WHEN area_sqm >= 10 THEN 0 ELSE 2 END AS c3,
        CASE WHEN walk_minutes IS NULL THEN 1 WHEN walk_minutes <= 15 THEN 0 ELSE 2 END AS c4,
        CASE WHEN floor_num IS NULL THEN 1 WHEN floor_num >= 2 THEN 0 ELSE 2 END AS c5,
        CASE WHEN NOT detail_fetched THEN 1 WHEN ih THEN 0 ELSE 2 END AS c6
    FROM listings
), judged AS (
    SELECT *, CASE greatest(c1, c2, c3, c4, c5, c6) WHEN 0 THEN 'pass' WHEN 1 THEN 'unknown' ELSE 'fail' END AS must FROM verdicts
)"""
SCORE_SQL = """, points AS (
    SELECT *,
        CASE WHEN detail_fetched AND (city_gas OR lpg) THEN 20.0 ELSE 0.0 END AS p1,
        CASE WHEN detail_fetched AND ih THEN 10.0 ELSE 0.0 END AS p2,
        CASE WHEN area_sqm IS NULL THEN 0.0 ELSE 20.0 * greatest(0.0, least(1.0, (10.0 - area_sqm) / -40.0)) END AS p3,
        CASE WHEN rent_total IS NULL THEN 0.0 ELSE 40.0 * greatest(0.0, least(1.0, (60000.0 - rent_total) / 50000.0)) END AS p4,
        CASE WHEN walk_minutes IS NULL THEN 0.0 ELSE 10.0 * greatest(0.0, least(1.0, (20.0 - walk_minutes) / 19.0)) END AS p5,
        CASE WHEN rent_total IS NULL THEN 60.0 ELSE 100.0 END AS weights
    FROM judged
), scores AS (SELECT *, round((p1 + p2 + p3 + p4 + p5) * 100.0 / weights, 3) AS score FROM points)"""
GROUP_SQL = """, chosen AS (
    SELECT dedup_key, listing_id AS representative_id, coalesce(rent_total, price) AS representative_cost FROM (
        SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY coalesce(rent_total, price) ASC NULLS LAST, feature_count DESC, site_priority, listing_id) AS n
        FROM listings WHERE dedup_key IS NOT NULL AND status = 'active'
    ) WHERE n = 1
), members AS (
    SELECT l.listing_id, coalesce(g.n, 1) AS member_count,
        CASE WHEN l.dedup_key IS NULL THEN true ELSE coalesce(c.representative_id = l.listing_id, false) END AS is_representative
    FROM listings l LEFT JOIN (SELECT dedup_key, count(*) AS n FROM listings WHERE dedup_key IS NOT NULL GROUP BY 1) g USING (dedup_key)
    LEFT JOIN chosen c ON c.dedup_key = l.dedup_key
)"""


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.with_groups(listings(spark, sf_dir))


@query("SELECT listing_id, dedup_key FROM listings")
def dedup_key(spark, sf_dir):
    return listings(spark, sf_dir).select("listing_id", "dedup_key")


@query(GROUP_SQL + " SELECT * FROM chosen")
def representative(spark, sf_dir):
    return grouping.representatives(listings(spark, sf_dir))


@query(
    GROUP_SQL
    + """, sites AS (SELECT DISTINCT dedup_key, site_id FROM listings WHERE dedup_key IS NOT NULL AND status = 'active')
    SELECT l.listing_id, m.member_count, m.is_representative,
        coalesce((SELECT string_agg(CAST(s.site_id AS VARCHAR), ',' ORDER BY s.site_id) FROM sites s WHERE s.dedup_key = l.dedup_key AND s.site_id <> l.site_id), '') AS other_sites
    FROM listings l JOIN members m USING (listing_id)"""
)
def group_members(spark, sf_dir):
    return grouping.membership_texts(listings(spark, sf_dir))


@query(
    MUST_SQL
    + """ SELECT listing_id, must, must = 'pass' OR must = 'unknown' AS must_passes, concat_ws(',', CASE WHEN c1 = 2 THEN 'rent_total_max' END, CASE WHEN c2 = 2 THEN 'layouts' END,
        CASE WHEN c3 = 2 THEN 'area_min' END, CASE WHEN c4 = 2 THEN 'walk_minutes_max' END, CASE WHEN c5 = 2 THEN 'floor_min' END, CASE WHEN c6 = 2 THEN 'features' END) AS failed FROM judged"""
)
def must_eval(spark, sf_dir):
    made = must.evaluated(listings(spark, sf_dir), WANTED)
    return made.select("listing_id", "must", "must_passes", F.concat_ws(",", must.names(F.col("must_checks"), must.FAIL)).alias("failed"))


@query(MUST_SQL + " SELECT listing_id, CASE WHEN greatest(c1, c2, c3, c4) = 2 THEN 'fail' ELSE 'unknown' END AS must FROM judged")
def must_list_stage(spark, sf_dir):
    return must.evaluated(listings(spark, sf_dir), WANTED, list_stage=True).select("listing_id", "must")


@query(MUST_SQL + SCORE_SQL + " SELECT listing_id, score, CAST(CASE WHEN detail_fetched THEN 0 ELSE 2 END + CASE WHEN rent_total IS NULL THEN 1 ELSE 0 END + CASE WHEN walk_minutes IS NULL THEN 1 ELSE 0 END AS INTEGER) AS unknown_items FROM scores")
def score(spark, sf_dir):
    return want.scored(listings(spark, sf_dir), FEATURES, NUMERICS).select("listing_id", "score", "unknown_items")


@query(
    MUST_SQL + SCORE_SQL + GROUP_SQL
    + """, ranks AS (SELECT s.listing_id, row_number() OVER (ORDER BY score DESC, s.listing_id) AS rank FROM scores s JOIN members m USING (listing_id) WHERE must <> 'fail' AND is_representative)
    SELECT s.listing_id, s.score, s.must, r.rank FROM scores s LEFT JOIN ranks r USING (listing_id)"""
)
def rank_pattern(spark, sf_dir):
    rows = want.scored(must.evaluated(_views(spark, sf_dir), WANTED), FEATURES, NUMERICS).select("listing_id", "score", "must", "is_representative")
    return want.ranked(rows, [], (F.col("must") != must.FAIL) & F.col("is_representative")).select("listing_id", "score", "must", "rank")


@query(
    MUST_SQL + SCORE_SQL + GROUP_SQL
    + """, ranks AS (SELECT s.*, m.member_count, row_number() OVER (ORDER BY score DESC, s.listing_id) AS rank FROM scores s JOIN members m USING (listing_id) WHERE must <> 'fail' AND is_representative AND property_family = 'CHINTAI')
    SELECT listing_id, site_id, score, must, rank, member_count FROM ranks ORDER BY rank LIMIT 15"""
)
def representative_ranking(spark, sf_dir):
    """Flagship: the cheapest of every group of equal offers, judged, scored and ranked by a declared pattern; the top 15."""
    pattern = patterns.Pattern("rent", "CHINTAI", WANTED, tuple(FEATURES), tuple(NUMERICS))
    return patterns.best(listings(spark, sf_dir), pattern, 15).select("listing_id", "site_id", "score", "must", "rank", "member_count")


@query(
    MUST_SQL + SCORE_SQL
    + """, ranks AS (SELECT *, row_number() OVER (ORDER BY score DESC, listing_id) AS rank FROM scores WHERE must <> 'fail')
    SELECT listing_id, rank, score FROM ranks r WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.order_id AND o.o_orderpriority = '1-URGENT') ORDER BY rank LIMIT 30"""
)
def digest_topn(spark, sf_dir):
    rows = want.scored(must.evaluated(listings(spark, sf_dir), WANTED), FEATURES, NUMERICS).where(F.col("must") != must.FAIL).select("listing_id", "order_id", "score")
    rows = want.ranked(rows, [], F.lit(True))
    excluded = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("order_id"))
    return pages.digest(rows, 30, excluded, "order_id").select("listing_id", "rank", "score")


@query(
    """, kept AS (SELECT listing_id, rent_total AS cost, area_sqm, walk_minutes, first_seen FROM listings WHERE rent_total >= 10000 AND rent_total <= 50000 AND area_sqm >= 5 AND walk_minutes <= 20)
    SELECT listing_id, cost, walk_minutes, (SELECT count(*) FROM kept) AS total FROM kept ORDER BY cost ASC NULLS LAST, listing_id LIMIT 50 OFFSET 50"""
)
def page_filter(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("cost", F.col("rent_total")).withColumn("rank", F.lit(None).cast("long"))
    flt = pages.ListingFilter.from_query({"price_min": "1", "price_max": "5", "area_min": "5", "walk_max": "20", "sort": "price", "page": "2"})
    return pages.page(rows, flt).select("listing_id", "cost", "walk_minutes", "total")


ORDER_COLUMNS = ("o_orderkey", "o_orderdate")


@query(
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS seen FROM orders WHERE o_orderstatus = 'O'),
    old AS (SELECT o_orderkey, seen, 'oldest' AS part FROM o ORDER BY seen, o_orderkey LIMIT 20),
    new AS (SELECT o_orderkey, seen, 'newest' AS part FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old) ORDER BY seen DESC, o_orderkey DESC LIMIT 21)
    SELECT * FROM old UNION ALL SELECT * FROM new""",
    offers=False,
)
def detail_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"))
    return pages.detail_queue(rows, 41, "seen", "o_orderkey")


@query(
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS seen, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    (SELECT o_orderkey, rank FROM o ORDER BY rank, o_orderkey LIMIT 30) UNION (SELECT o_orderkey, rank FROM o ORDER BY seen, o_orderkey LIMIT 25)""",
    offers=False,
)
def check_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"), F.col("o_totalprice").alias("score"))
    return pages.check_targets_by_score(rows, 30, 25, "o_orderkey", "seen")


RATES_SQL = """rates AS (
    SELECT c_nationkey AS nation, strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS segment, count(*) AS samples, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation, segment ORDER BY period DESC) AS n FROM rates) WHERE n = 1)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("segment"), F.floor("o_totalprice").alias("v"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return orders.join(customers, "o_custkey").groupBy("nation", "period", "segment").agg(F.count(F.lit(1)).alias("samples"), F.sum("v").alias("total"))


@query(f"WITH {RATES_SQL} SELECT nation, segment, period, samples, total FROM newest", offers=False)
def latest_rate(spark, sf_dir):
    return enrich.latest(_rates(spark, sf_dir), ["nation", "segment"], "period").select("nation", "segment", "period", "samples", "total")


@query(
    f"""WITH {RATES_SQL} SELECT o_orderkey, period, round(floor(o_totalprice) * samples / total, 6) AS market_rate_ratio
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN newest ON nation = c_nationkey AND segment = o_orderpriority AND n = 1""",
    offers=False,
)
def market_ratio(spark, sf_dir):
    rates = enrich.latest(_rates(spark, sf_dir), ["nation", "segment"], "period").withColumn("rate_value", F.col("total") / F.col("samples"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey").withColumnRenamed("o_orderpriority", "segment")
    made = enrich.market_ratio(rows, rates, ["nation", "segment"], F.floor("o_totalprice"))
    return made.select("o_orderkey", "period", F.round("market_rate_ratio", 6).alias("market_rate_ratio"))


@query(
    """WITH fine AS (SELECT p_brand || '|' || p_size AS k, max(p_retailprice) FILTER (WHERE p_retailprice > 1200) AS top, count(*) FILTER (WHERE p_retailprice > 1200) AS n FROM part GROUP BY 1 HAVING n > 0),
    coarse AS (SELECT p_brand AS k, max(p_retailprice) FILTER (WHERE p_retailprice > 1200) AS top, count(*) FILTER (WHERE p_retailprice > 1200) AS n FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1 HAVING n > 0)
    SELECT p_partkey, coalesce(f.top, c.top) AS top, CASE WHEN f.k IS NOT NULL THEN f.n ELSE c.n END AS n, CASE WHEN f.k IS NOT NULL THEN 'fine' WHEN c.k IS NOT NULL THEN 'coarse' END AS level_used
    FROM part LEFT JOIN fine f ON f.k = p_brand || '|' || p_size LEFT JOIN coarse c ON c.k = p_brand""",
    offers=False,
)
def fallback_key(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("fine", F.concat_ws("|", "p_brand", F.col("p_size").cast("string"))).withColumn("coarse", F.col("p_brand"))
    dear = F.when(F.col("p_retailprice") > 1200, F.col("p_retailprice"))
    values = lambda k, rows: rows.groupBy(F.col(k).alias("k")).agg(F.max(dear).alias("top"), F.count(dear).alias("n")).where("n > 0")
    levels = values("fine", parts).unionByName(values("coarse", parts.where("p_brand <> 'Brand#1'")))
    return enrich.with_fallback(parts.select("p_partkey", "fine", "coarse"), levels, "fine", "coarse", "k", ["top", "n"]).select("p_partkey", "top", "n", "level_used")


@query(
    """SELECT l_suppkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS flood_rank, max(l_discount) FILTER (WHERE l_returnflag = 'R') AS slide_ratio,
    max(l_tax) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS soil_rank FROM lineitem GROUP BY 1""",
    offers=False,
)
def hazard_pivot(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    cells = {"flood_rank": ((flag == "A") & (status == "F"), "l_quantity"), "slide_ratio": (flag == "R", "l_discount"), "soil_rank": ((flag == "N") & (status == "O"), "l_tax")}
    return enrich.pivoted(table(spark, sf_dir, "lineitem"), ["l_suppkey"], cells)


@query(
    """WITH parts AS (SELECT l_suppkey AS k, l_linenumber AS r, CAST(l_quantity AS DOUBLE) AS a FROM lineitem WHERE l_returnflag = 'A'), whole AS (SELECT l_suppkey AS k, sum(l_quantity) AS t FROM lineitem GROUP BY 1)
    SELECT k, round(least(sum(a) / t, 1.0), 4) AS area_ratio, round(least(sum(r * a) / t, max(r)), 4) AS rank_avg, CAST(max(r) AS DOUBLE) AS rank_max FROM parts JOIN whole USING (k) GROUP BY k, t""",
    offers=False,
)
def area_weighted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("a"), "l_returnflag")
    whole = lines.groupBy("k").agg(F.sum("a").alias("t"))
    return enrich.area_weighted(lines.where("l_returnflag = 'A'").join(whole, "k"), ["k"], "r", "a", "t")


@query(
    """WITH parts AS (SELECT l_suppkey AS k, l_linenumber AS v, l_quantity AS a FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5)
    SELECT k, round(sum(CASE WHEN 6 - v IN (4, 5) THEN a ELSE 0.0 END) / sum(a), 4) AS area_ratio, round(sum((6 - v) * a) / sum(a), 4) AS rank_avg, CAST(max(6 - v) AS DOUBLE) AS rank_max FROM parts GROUP BY 1 HAVING sum(a) > 0""",
    offers=False,
)
def graded_levels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v"), F.col("l_quantity").alias("a"))
    return enrich.graded(lines, ["k"], "v", "a")


@query(
    """WITH p AS (SELECT l_partkey AS unit, l_suppkey AS place, CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber END AS walk, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_quantity AS INTEGER) END AS ride FROM lineitem),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY walk + ride, walk, place) AS n FROM p WHERE walk IS NOT NULL AND ride IS NOT NULL) WHERE n = 1),
    mins AS (SELECT unit, min(walk) AS w, min(ride) AS r FROM p GROUP BY 1)
    SELECT m.unit, b.place, CASE WHEN b.unit IS NULL THEN m.w ELSE b.walk END AS walk, CASE WHEN b.unit IS NULL THEN m.r ELSE b.ride END AS ride FROM mins m LEFT JOIN best b ON b.unit = m.unit""",
    offers=False,
)
def best_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("place"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linenumber")).alias("walk"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity").cast("int")).alias("ride"),
    )
    return enrich.best_pairs(rows, "unit", "walk", "ride", "place")


@query(
    """, gk AS (SELECT *, coalesce('g:' || dedup_key, 'l:' || listing_id) AS gk FROM listings),
    u AS (SELECT gk, bool_or(city_gas) AS a, bool_or(lpg) AS b, bool_or(electric) AS c, bool_or(ih) AS d, bool_or(fa) AS e, bool_or(fr) AS f FROM gk GROUP BY 1)
    SELECT listing_id, concat_ws(',', CASE WHEN c THEN 'ALL_ELECTRIC' END, CASE WHEN e THEN 'FEAT_A' END, CASE WHEN f THEN 'FEAT_R' END, CASE WHEN a THEN 'GAS_CITY' END, CASE WHEN b THEN 'GAS_LPG' END, CASE WHEN d THEN 'STOVE_IH' END) AS codes
    FROM gk JOIN u USING (gk)"""
)
def or_join(spark, sf_dir):
    made = grouping.union_features(listings(spark, sf_dir))
    return made.select("listing_id", F.concat_ws(",", "feature_codes").alias("codes"))


@query(
    """WITH m AS (SELECT l_suppkey, l_linestatus, median(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS p, count(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS np, median(l_quantity) AS a, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, l_linestatus, CASE WHEN np >= 10 THEN p ELSE a END AS rate_value, CASE WHEN np >= 10 THEN 'primary' ELSE 'all' END AS basis, CASE WHEN np >= 10 THEN np ELSE n END AS samples FROM m WHERE np >= 10 OR n >= 10""",
    offers=False,
)
def median_fallback(spark, sf_dir):
    return enrich.median_with_fallback(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linestatus"], "l_quantity", F.col("l_returnflag") == "A")


@query(
    """WITH l AS (SELECT l_partkey * 8 + l_linenumber AS cell, l_returnflag = 'A' AS first, l_quantity FROM lineitem), a AS (SELECT cell, max(l_quantity) AS v FROM l WHERE first GROUP BY 1), b AS (SELECT cell, max(l_quantity) AS v FROM l WHERE NOT first GROUP BY 1)
    SELECT cell, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'mansion' ELSE 'apart' END AS basis FROM a FULL JOIN b USING (cell)""",
    offers=False,
)
def merge_cells(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("cell", F.col("l_partkey") * 8 + F.col("l_linenumber"))
    side = lambda on: lines.where(on).groupBy("cell").agg(F.max("l_quantity").alias("v"))
    first = F.col("l_returnflag") == "A"
    return enrich.preferred(side(first), side(~first), ["cell"], "v", ("mansion", "apart"))


@query(
    """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0 AS ry FROM lineitem)
    SELECT l_suppkey, count(*) AS pairs, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
    offers=False,
)
def spearman(spark, sf_dir):
    return stats.spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")


@query(
    """WITH g AS (SELECT o_orderpriority, list_sort(list(CAST(floor(o_totalprice) AS BIGINT))) AS v FROM orders GROUP BY 1)
    SELECT o_orderpriority, v[CAST(least(floor(len(v) * 0.1), len(v) - 1) AS BIGINT) + 1] AS p10, v[CAST(least(floor(len(v) * 0.5), len(v) - 1) AS BIGINT) + 1] AS p50, v[CAST(least(floor(len(v) * 0.9), len(v) - 1) AS BIGINT) + 1] AS p90 FROM g""",
    offers=False,
)
def pct_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.floor("o_totalprice").alias("v"))
    return stats.nearest_percentile(rows, ["o_orderpriority"], "v", [0.1, 0.5, 0.9])


@query(
    """SELECT o_orderpriority, CAST(round(quantile_cont(CAST(floor(o_totalprice) AS DOUBLE), 0.25)) AS BIGINT) AS q25, CAST(round(quantile_cont(CAST(floor(o_totalprice) AS DOUBLE), 0.5)) AS BIGINT) AS q50,
    CAST(round(quantile_cont(CAST(floor(o_totalprice) AS DOUBLE), 0.75)) AS BIGINT) AS q75 FROM orders GROUP BY 1""",
    offers=False,
)
def pct_cont(spark, sf_dir):
    return stats.quartiles(table(spark, sf_dir, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("double").alias("v")), ["o_orderpriority"], "v")


@query(" SELECT site_id, count(*) AS rows, count(price) AS has_price, count(floor_num) AS has_floor_num, count(walk_minutes) AS has_walk_minutes, count(dedup_key) AS has_dedup_key FROM listings GROUP BY 1")
def coverage(spark, sf_dir):
    return stats.coverage(listings(spark, sf_dir), ["site_id"], ["price", "floor_num", "walk_minutes", "dedup_key"])


@query(
    """, s AS (SELECT dedup_key, min(site_id) <> max(site_id) AS shared FROM listings WHERE dedup_key IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT site_id, dedup_key FROM listings),
    x AS (SELECT site_id, count(*) FILTER (WHERE shared) AS n FROM d JOIN s USING (dedup_key) GROUP BY 1)
    SELECT l.site_id, count(*) AS listings, count(dedup_key) AS keyed, count(DISTINCT dedup_key) AS groups, coalesce(max(x.n), 0) AS shared_groups, round(count(dedup_key) / count(*), 4) AS key_rate,
    round(CASE WHEN count(dedup_key) = 0 THEN 0.0 ELSE count(DISTINCT dedup_key) / count(dedup_key) END, 4) AS unique_rate FROM listings l LEFT JOIN x ON x.site_id = l.site_id GROUP BY 1"""
)
def dedup_stats(spark, sf_dir):
    return grouping.group_stats(listings(spark, sf_dir))


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) AS price, lag(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS price_prev FROM events)
    SELECT event_id, price, price_prev, CASE WHEN price_prev IS NULL THEN 'new' WHEN price > price_prev THEN 'price_up' WHEN price < price_prev THEN 'price_down' END AS event FROM e""",
    offers=False,
)
def price_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("price", F.floor(F.col("value") * 100))
    rows = rows.withColumn("price_prev", F.lag("price").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.select("event_id", "price", "price_prev", snapshot.price_event(F.col("price_prev").isNull(), F.lit(False), F.col("price"), F.col("price_prev")).alias("event"))


@query(
    """WITH a AS (SELECT o_custkey AS unit, max(o_orderkey) AS k FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS unit, max(o_orderkey) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1),
    s AS (SELECT unit, o_orderpriority AS type, 'F' || (unit % 2) AS family, CASE o_orderstatus WHEN 'F' THEN 'sold' ELSE 'active' END AS status, CAST(floor(o_totalprice) AS BIGINT) AS price, CASE WHEN k % 3 <> 0 THEN k END AS note, '1' AS first_seen FROM a JOIN orders ON o_orderkey = k),
    n AS (SELECT unit, o_orderpriority AS type, CASE WHEN unit % 7 = 0 THEN 'FX' ELSE 'F' || (unit % 2) END AS family, CAST(floor(o_totalprice) AS BIGINT) AS price, CASE WHEN k % 3 <> 1 THEN k END AS note FROM b JOIN orders ON o_orderkey = k),
    j AS (SELECT s.unit AS su, n.unit AS nu, s.type AS st, n.type AS nt, s.family AS sf, n.family AS nf, s.status AS ss, s.price AS sp, n.price AS np, s.note AS sn, n.note AS nn, s.first_seen AS fs,
        CASE WHEN n.unit IS NULL THEN NULL WHEN s.unit IS NULL THEN 'new' WHEN s.family <> n.family THEN 'family_mismatch' WHEN s.type = n.type THEN 'same_type' WHEN s.status IN ('sold', 'removed') THEN 'retype' ELSE 'type_mismatch' END AS relation FROM s FULL JOIN n ON s.unit = n.unit),
    t AS (SELECT *, coalesce(relation IN ('new', 'same_type', 'retype'), false) AS taken, coalesce(relation IN ('new', 'retype'), false) AS fresh FROM j)
    SELECT coalesce(su, nu) AS unit, CASE WHEN taken THEN nt ELSE st END AS type, CASE WHEN taken THEN 'active' ELSE ss END AS status, CASE WHEN taken THEN np ELSE sp END AS price,
        CASE WHEN NOT taken THEN sn WHEN fresh THEN nn ELSE coalesce(nn, sn) END AS note, CASE WHEN taken AND NOT fresh THEN sp END AS price_prev, relation,
        CASE WHEN NOT taken THEN NULL WHEN relation = 'new' OR ss IN ('sold', 'removed') THEN 'new' WHEN np > sp THEN 'price_up' WHEN np < sp THEN 'price_down' END AS event FROM t""",
    offers=False,
)
def upsert_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("late", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    cols = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    newest = orders.groupBy("late", F.col("o_custkey").alias("unit")).agg(F.max_by(F.struct(*cols), "o_orderkey").alias("r")).select("late", "unit", "r.*")
    unit, key = F.col("unit"), F.col("o_orderkey")
    shared = [unit, F.col("o_orderpriority").alias("type"), F.floor("o_totalprice").alias("price")]
    family = F.concat(F.lit("F"), (unit % 2).cast("string"))
    stored = newest.where("not late").select(*shared, family.alias("family"), F.when(F.col("o_orderstatus") == "F", "sold").otherwise("active").alias("status"), F.when(key % 3 != 0, key).alias("note"), F.lit("1").alias("first_seen"), F.lit("1").alias("last_seen"))
    batch = newest.where("late").select(*shared, F.when(unit % 7 == 0, "FX").otherwise(family).alias("family"), F.when(key % 3 != 1, key).alias("note"))
    return snapshot.upserted(stored, batch, ["unit"], ["price"], ["note"], "2").select("unit", "type", "status", "price", "note", "price_prev", "relation", "event")


@query(
    """WITH e AS (SELECT event_id, user_id AS unit, event_type AS kind, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value) AS BIGINT) END AS price, ts FROM events),
    sent AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15'), c AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15')
    SELECT event_id, unit, kind, price FROM c WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.unit = c.unit AND s.kind = c.kind AND s.price IS NOT DISTINCT FROM c.price)""",
    offers=False,
)
def suppression(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 10 != 0, F.floor("value")).alias("price"), "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return snapshot.unsent(rows.where(F.col("ts") >= cut), rows.where(F.col("ts") < cut), by_price=True).select("event_id", "unit", "kind", "price")


@query(
    """WITH d AS (SELECT source, CASE WHEN quality = 1 THEN true WHEN quality = 0 AND toxic = 0 THEN false END AS flag FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, CASE WHEN bool_or(flag) THEN true WHEN bool_or(NOT flag) THEN false END AS flag FROM d GROUP BY 1""",
    offers=False,
)
def bool_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flag = F.when(F.col("quality") == 1, True).when((F.col("quality") == 0) & (F.col("toxic") == 0), False)
    return rows.withColumn("f", flag).groupBy("source").agg(grouping.folded_flag(F.col("f")).alias("flag"))


DICTIONARY = [
    features.Entry("FEAT_THE", ("the and", "the"), ("pathetic",)),
    features.Entry("FEAT_ING", ("ingly", "tion"), ("the the",)),
    features.Entry("FEAT_DER", ("der ", "die "), ()),
]


@query(
    """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), m AS (SELECT doc_id,
        CASE WHEN contains(t, 'pathetic') THEN NULL WHEN contains(t, 'the and') THEN 'the and' WHEN contains(t, 'the') THEN 'the' END AS a,
        CASE WHEN contains(t, 'the the') THEN NULL WHEN contains(t, 'ingly') THEN 'ingly' WHEN contains(t, 'tion') THEN 'tion' END AS b,
        CASE WHEN contains(t, 'der ') THEN 'der ' WHEN contains(t, 'die ') THEN 'die ' END AS c FROM d)
    SELECT doc_id, concat_ws(',', 'FEAT_DER=' || c, 'FEAT_ING=' || b, 'FEAT_THE=' || a) AS found FROM m""",
    offers=False,
)
def dict_match(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    made = features.extracted(rows, DICTIONARY, "t")
    return made.select("doc_id", F.concat_ws(",", F.transform("features", lambda x: F.concat_ws("=", x["code"], x["matched"]))).alias("found"))


@query(
    """WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[、,，/／｜|\\n\\r\\t;；]+'), lambda x: trim(x, ' 　()（）[]【】「」')), lambda x: x <> ''))) AS token FROM documents)
    SELECT token, count(*) AS n FROM t WHERE regexp_matches(token, '\\p{L}') AND length(token) BETWEEN 2 AND 40 AND NOT contains(token, 'the') AND NOT contains(token, 'pathetic') AND NOT contains(token, 'ingly') AND NOT contains(token, 'tion') AND NOT contains(token, 'der ') AND NOT contains(token, 'die ')
      AND NOT contains('the and', token) AND NOT contains('the', token) AND NOT contains('pathetic', token) AND NOT contains('ingly', token) AND NOT contains('tion', token) AND NOT contains('der ', token) AND NOT contains('die ', token) AND NOT contains('the the', token)
      GROUP BY 1""",
    offers=False,
)
def token_unknown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    return features.unknown_tokens(rows, DICTIONARY, "t", [])


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
    SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links, min(link) AS first_link FROM l GROUP BY 1""",
    offers=False,
)
def html_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("link").alias("distinct_links"), F.min("link").alias("first_link"))


@query(
    """SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, CASE WHEN regexp_matches(url, '^https?://[^/\\s]+') THEN url END AS safe FROM pages""",
    offers=False,
)
def url_norm(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract(url, "^https?://([^/?#]+)", 1)).alias("host"), F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1).alias("path"), text.safe_link(url).alias("safe")
    )


@query(
    """SELECT event_type, key, count(*) AS n, max(CAST(v AS INTEGER)) AS top FROM (SELECT event_type, 'k' AS key, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT event_type, 'u', CAST(user_id % 5 AS VARCHAR) FROM events) WHERE v IS NOT NULL GROUP BY 1, 2""",
    offers=False,
)
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    more = F.create_map(F.lit("u"), (F.col("user_id") % 5).cast("string"))
    whole = snapshot.merged_maps(F.from_json("props", "map<string,string>"), more)
    return rows.select("event_type", F.explode(whole).alias("key", "v")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("v").cast("int")).alias("top"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    s AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS leg FROM t)
    SELECT conv_id, CAST(leg AS BIGINT) AS leg, min(role) AS role, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY conv_id, leg""",
    offers=False,
)
def turns(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("new", (~F.lag("role").over(order).eqNullSafe(F.col("role"))).cast("int"))
    rows = rows.withColumn("leg", F.sum("new").over(order))
    return rows.groupBy("conv_id", "leg").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as stations of nations; lines between suppliers of neighbouring numbers within a line of ten."""
    stations = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_cd"), (F.col("s_nationkey") + 100000).cast("long").alias("station_g_cd"),
        (F.lit(35.0) + (F.col("s_suppkey") % 50) / 100.0).alias("lat"), (F.lit(139.0) + (F.col("s_suppkey") % 70) / 100.0).alias("lon"),
    )
    return stations, stations.where("station_cd % 10 <> 0").select(F.col("station_cd").alias("a"), (F.col("station_cd") + 1).alias("b"))


@query(
    """WITH RECURSIVE s AS (SELECT s_suppkey AS cd, CAST(s_nationkey + 100000 AS BIGINT) AS g, 35.0 + (s_suppkey % 50) / 100.0 AS lat, 139.0 + (s_suppkey % 70) / 100.0 AS lon FROM supplier),
    l AS (SELECT a.cd AS a, b.cd AS b, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM s a JOIN s b ON b.cd = a.cd + 1 WHERE a.cd % 10 <> 0),
    e AS (SELECT a AS src, b AS dst, km * 1.15 / 35.0 * 60 AS m FROM l UNION ALL SELECT b, a, km * 1.15 / 35.0 * 60 FROM l UNION ALL SELECT cd, -g, 5.0 FROM s UNION ALL SELECT -g, cd, 5.0 FROM s),
    p(node, m) USING KEY (node) AS (SELECT cd, CAST(0.0 AS DOUBLE) FROM s WHERE g = 100000 + (SELECT min(s_nationkey) FROM supplier)
        UNION SELECT e.dst, min(p.m + e.m) FROM p JOIN e ON e.src = p.node LEFT JOIN recurring.p AS q ON q.node = e.dst WHERE q.m IS NULL OR p.m + e.m < q.m GROUP BY e.dst)
    SELECT g AS station_g_cd, round(min(m), 6) AS minutes FROM p JOIN s ON s.cd = p.node GROUP BY 1""",
    offers=False,
)
def shortest_path(spark, sf_dir):
    stations, links = _network(spark, sf_dir)
    first = stations.agg(F.min("station_g_cd").alias("station_g_cd"))
    origins = stations.join(F.broadcast(first), "station_g_cd").select(F.col("station_cd").alias("node"))
    found = graph.shortest(graph.rail_edges(stations, links), origins)
    return graph.group_estimates(found, stations).select("station_g_cd", F.round("minutes", 6).alias("minutes"))


@query(
    """SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians((s_nationkey % 7) * 0.1) / 2), 2) + cos(radians(35.0)) * cos(radians(35.0 + (s_nationkey % 7) * 0.1)) * pow(sin(radians((s_suppkey % 9) * 0.1) / 2), 2))), 6) AS km FROM supplier""",
    offers=False,
)
def haversine(spark, sf_dir):
    lat, lon = F.lit(35.0) + (F.col("s_nationkey") % 7) * 0.1, (F.col("s_suppkey") % 9) * 0.1
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(numbers.haversine_km(F.lit(35.0), F.lit(0.0), lat, lon), 6).alias("km"))


@query(
    """WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 1.7 AS v FROM part)
    SELECT p_partkey, round(CASE WHEN v <= 0 THEN 0.0 WHEN v <= 20 THEN 759.0 + v * 185.13 WHEN v <= 80 THEN 1056.0 + v * 170.28 ELSE 1232.0 + v * 168.08 END, 4) AS city_gas,
        round(CASE WHEN v <= 0 THEN 0.0 WHEN v <= 10 THEN 5960.0 + (v - 5) * (9736.0 - 5960.0) / 5 WHEN v <= 20 THEN 9736.0 + (v - 10) * (16744.0 - 9736.0) / 10 ELSE 16744.0 + (v - 20) * (35790.0 - 16744.0) / 30 END, 4) AS lpg,
        round(935.25 + least(v * 5, 120.0) * 29.80 + greatest(least(v * 5, 300.0) - 120.0, 0.0) * 36.40 + greatest(v * 5 - 300.0, 0.0) * 40.49 + v * 5 * (-5.80 + 4.18), 4) AS power FROM v""",
    offers=False,
)
def utility_tariffs(spark, sf_dir):
    v = F.col("p_size").cast("double") * 1.7
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(numbers.city_gas_bill(v), 4).alias("city_gas"), F.round(numbers.lpg_bill(v), 4).alias("lpg"), F.round(numbers.power_bill(v * 5), 4).alias("power")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_totalprice > 0 THEN CAST(round_even(floor(o_totalprice) * (0.005 / 12 * pow(1 + 0.005 / 12, 420) / (pow(1 + 0.005 / 12, 420) - 1)), 0) AS BIGINT) END AS monthly FROM orders""",
    offers=False,
)
def loan(spark, sf_dir):
    price = F.when(F.col("o_custkey") % 10 != 0, F.floor("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.loan_payment(price).alias("monthly"))


@query(
    """, r AS (SELECT unit_id % 50 AS cell, avg(price / area_sqm) AS rate FROM listings WHERE price IS NOT NULL GROUP BY 1),
    x AS (SELECT listing_id, property_family, round(price / area_sqm / rate, 6) AS ratio FROM listings JOIN r ON r.cell = unit_id % 50 WHERE price IS NOT NULL)
    SELECT listing_id, ratio FROM x WHERE ratio < CASE WHEN property_family IN ('MANSION_BUY', 'KODATE_BUY') THEN 0.7 ELSE 0.75 END ORDER BY ratio, listing_id LIMIT 10"""
)
def anomaly(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("cell", F.col("unit_id") % 50)
    unit = F.col("price") / F.col("area_sqm")
    rates = rows.where("price is not null").groupBy("cell").agg(F.avg(unit).alias("rate_value"))
    made = enrich.market_ratio(rows, rates, ["cell"], unit).withColumn("ratio", F.round("market_rate_ratio", 6))
    limit = F.when(F.col("property_family").isin("MANSION_BUY", "KODATE_BUY"), 0.7).otherwise(0.75)
    return made.where(F.coalesce(F.col("ratio") < limit, F.lit(False))).orderBy("ratio", "listing_id").limit(10).select("listing_id", "ratio")


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", offers=False)
def facets(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return pages.facet(table(spark, sf_dir, "orders").select("o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")), "n_name")


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0)""",
    offers=False,
)
def bands(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    band = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))
    return snapshot.banded(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), band, ["o_custkey"])


@query("SELECT c_name FROM (SELECT c_name, c_name <= 'Customer#000000200' AS passed FROM customer) ORDER BY passed, c_name LIMIT 15", offers=False)
def rotation(spark, sf_dir):
    return pages.rotated(table(spark, sf_dir, "customer").select("c_name"), "c_name", "Customer#000000200", 15)


@query(
    """, gk AS (SELECT *, coalesce('g:' || dedup_key, 'l:' || listing_id) AS gk FROM listings),
    m AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS listing_id, l_tax >= 0.07 AS fav, l_discount >= 0.09 AS exc, CASE WHEN l_quantity = 50 THEN 'memo' END AS memo FROM lineitem WHERE l_tax >= 0.07 OR l_discount >= 0.09 OR l_quantity = 50),
    f AS (SELECT gk, bool_or(fav) AS fav, bool_or(exc) AS exc, count(memo) AS memos FROM gk JOIN m USING (listing_id) GROUP BY 1)
    SELECT listing_id, coalesce(fav, false) AS is_favourite, coalesce(exc, false) AS is_excluded, coalesce(memos, 0) AS memos FROM gk LEFT JOIN f USING (gk)"""
)
def group_marks(spark, sf_dir):
    offers = listings(spark, sf_dir).select("listing_id", grouping.group_or_self().alias("gk"))
    made = table(spark, sf_dir, "lineitem").select(
        listing_id(), (F.col("l_tax") >= 0.07).alias("is_favourite"), (F.col("l_discount") >= 0.09).alias("is_excluded"), F.when(F.col("l_quantity") == 50, "memo").alias("memo")
    )
    return marks.group_marks(offers, made.where("is_favourite or is_excluded or memo is not null"))


@query(
    """, est AS (SELECT listing_id, CASE WHEN city_gas AND lpg THEN 'unknown' WHEN city_gas THEN 'city' WHEN lpg THEN 'lpg' WHEN electric THEN 'electric' ELSE 'unknown' END AS gas,
        CASE WHEN city_gas AND lpg THEN 'conflict' WHEN city_gas OR lpg OR electric THEN 'listing' ELSE 'prior' END AS gas_basis, ih FROM listings)
    SELECT listing_id, gas, gas_basis, CASE WHEN ih OR gas = 'electric' THEN 'ih' ELSE 'gas' END AS stove, CASE WHEN ih THEN 'listing' ELSE 'assumed' END AS stove_basis FROM est"""
)
def utility_class(spark, sf_dir):
    made = listings(spark, sf_dir).withColumn("u", numbers.estimated_utility(F.col("feature_codes"), 2, 0.3))
    return made.select("listing_id", "u.gas", "u.gas_basis", "u.stove", "u.stove_basis")


@query(
    """, g AS (SELECT dedup_key, count(*) AS n FROM listings WHERE dedup_key IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN l.dedup_key IS NULL THEN 'none' WHEN contains(address_normalized, '丁目') THEN 'chome' ELSE 'town' END AS granularity, coalesce(g.n, 1) > 1 AS grouped, count(*) AS n FROM listings l LEFT JOIN g USING (dedup_key) GROUP BY 1, 2"""
)
def granularity_histogram(spark, sf_dir):
    rows = _views(spark, sf_dir)
    level = F.when(F.col("dedup_key").isNull(), "none").otherwise(grouping.granularity(F.col("address_normalized")))
    return rows.groupBy(level.alias("granularity"), (F.col("member_count") > 1).alias("grouped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT user_id, event_id, epoch(ts) AS a, epoch(ts) + 600 + CAST(floor(value) AS BIGINT) % 600 AS b, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events WHERE event_type IN ('view', 'purchase'))
    SELECT x.event_id AS left_id, y.event_id AS right_id, CAST(round(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS overlap FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.b AND y.a < x.b""",
    offers=False,
)
def interval_overlap(spark, sf_dir):
    """Overlapping intervals of one user, by equi-join on the user and hour buckets; each pair counts in its first common bucket."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')").select("user_id", "event_id", at.alias("a"), (at + 600 + F.floor("value") % 600).alias("b"))
    hours = rows.withColumn("h", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("b") / 3600))))
    x, y = hours.alias("x"), hours.alias("y")
    on = (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.event_id") < F.col("y.event_id")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))
    first = F.col("x.h") == F.floor(F.greatest("x.a", "y.a") / 3600)
    return x.join(y, on & first).select(F.col("x.event_id").alias("left_id"), F.col("y.event_id").alias("right_id"), F.round(F.least("x.b", "y.b") - F.greatest("x.a", "y.a")).cast("long").alias("overlap"))


@query(
    """WITH q AS (SELECT DISTINCT strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS period FROM orders ORDER BY 1 DESC LIMIT 4)
    SELECT strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS period, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) IN (SELECT period FROM q) GROUP BY 1""",
    offers=False,
)
def newest_quarters(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("period"))
    return snapshot.newest_periods(rows, "period", 4).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH n AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT c_custkey, r_name, n_name || ' ' || c_name AS address FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, (SELECT n.n_name FROM n WHERE n.r_name = a.r_name AND contains(a.address, n.n_name) ORDER BY length(n.n_name) DESC, n.n_name LIMIT 1) AS n_name FROM a""",
    offers=False,
)
def city_resolution(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = people.select("c_custkey", "r_name", F.concat_ws(" ", "n_name", "c_name").alias("address"))
    return enrich.longest_contained(texts, nations.select("r_name", "n_name"), "r_name", "address", "n_name").select("c_custkey", "n_name")


@query(MUST_SQL + " SELECT site_id, count(*) AS rows, count(*) FILTER (WHERE must = 'pass') AS passing, count(*) FILTER (WHERE must = 'unknown') AS unknown FROM judged GROUP BY 1")
def pattern_summary(spark, sf_dir):
    rows = must.evaluated(listings(spark, sf_dir), WANTED).withColumn("rank", F.lit(None).cast("long")).withColumn("score", F.lit(None).cast("double"))
    return pages.summary(rows, ["site_id"]).select("site_id", "rows", "passing", "unknown")
