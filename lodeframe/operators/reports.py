"""Statistics reports and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import stats


def limits_passed(rows: DataFrame, groups: list[str], value: str, limits: list[float]) -> DataFrame:
    """For each limit: how many known values are within it, and their share."""
    known = F.col(value).isNotNull()
    made = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("known"), *(F.count_if(known & (F.col(value) <= x)).alias(f"_{k}") for k, x in enumerate(limits)))
    each = F.array(*(F.struct(F.lit(float(x)).alias("limit"), F.col(f"_{k}").alias("passed")) for k, x in enumerate(limits)))
    return made.select(*groups, "rows", "known", F.inline(each)).withColumn("share", F.round(F.col("passed") / F.nullif(F.col("known"), F.lit(0)), 4))


def saturation(rows: DataFrame, groups: list[str], value: str, worsts: list[float]) -> DataFrame:
    """For each candidate of the worst value: the share of known values at or beyond it, which would score nothing."""
    made = rows.groupBy(*groups).agg(F.count(value).alias("known"), *(F.count_if(F.col(value) >= x).alias(f"_{k}") for k, x in enumerate(worsts)))
    each = F.array(*(F.struct(F.lit(float(x)).alias("worst"), F.col(f"_{k}").alias("stuck")) for k, x in enumerate(worsts)))
    return made.select(*groups, "known", F.inline(each)).withColumn("share", F.round(F.col("stuck") / F.nullif(F.col("known"), F.lit(0)), 4))


def market_report(rows: DataFrame, groups: list[str], ratio: str, price: str, passing: Column, resolved: float = 0.80, correlation: float = 0.60) -> DataFrame:
    """Resolved share of all rows and its gate; spread and rank correlation with the price of passing rows and its gate."""
    share = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), (F.count(ratio) / F.count(F.lit(1))).alias("share"))
    known = rows.where(passing)
    spread = stats.nearest_percentile(known, groups, ratio, [0.1, 0.5, 0.9])
    alike = stats.spearman(known, groups, price, ratio)
    made = share.join(spread, groups, "left").join(alike, groups, "left")
    return made.withColumn("enough", stats.gated(F.col("share"), least=resolved)).withColumn("distinct", stats.gated(F.col("spearman"), most=correlation))


def resolution(rows: DataFrame, site: str, value: str) -> DataFrame:
    """Per site: rows, resolved ones, those that are exactly 0 (checked, outside), and shares."""
    made = rows.groupBy(site).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("resolved"), F.count_if(F.col(value) == 0).alias("zero"))
    return made.withColumn("share", F.round(F.col("resolved") / F.col("rows"), 4)).withColumn("zero_share", F.round(F.col("zero") / F.nullif(F.col("resolved"), F.lit(0)), 4))


def utility_report(rows: DataFrame, gas: str, yen: str, rank: str, top: int = 100) -> DataFrame:
    """By energy source: rows, share of all, median bill, mean rank, rows among the first `top`."""
    made = rows.groupBy(gas).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(rank), 2).alias("mean_rank"), F.count_if(F.col(rank) <= top).alias("in_top"))
    # bills are placed by ranges of values: no source's bills meet in one buffer
    placed = stats.placed_values(rows.where(F.col(yen).isNotNull()).select(F.coalesce(F.col(gas).cast("string"), F.lit("")).alias("_g"), yen), ["_g"], yen)
    middle = placed.groupBy("_g").agg(stats.interpolated(0.5, F.col(yen)).alias("median_yen"))
    made = made.withColumn("_g", F.coalesce(F.col(gas).cast("string"), F.lit(""))).join(middle, "_g", "left").select(gas, "rows", "median_yen", "mean_rank", "in_top")
    total = rows.agg(F.count(F.lit(1)).alias("_all")).withColumn("_k", F.lit(1))
    return made.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").withColumn("share", F.round(F.col("rows") / F.col("_all"), 4)).drop("_k", "_all")


# --- display -----------------------------------------------------------------------------------


def yen_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(value, 0), F.lit("円")), F.lit("—"))


def man_yen(value: Column) -> Column:
    """Prices in ten thousands and hundred millions; unknown is said so."""
    large, rest = F.floor(value / 100_000_000), F.floor((value % 100_000_000) / 10_000)
    many = F.concat(large.cast("string"), F.lit("億"), F.when(rest > 0, F.concat(F.format_number(rest, 0), F.lit("万"))).otherwise(""), F.lit("円"))
    few = F.concat(F.when(value % 10_000 == 0, F.format_number(value / 10_000, 0)).otherwise(F.format_number(value / 10_000, 1)), F.lit("万円"))
    return F.when(value.isNull(), "価格未定").when(value >= 100_000_000, many).otherwise(few)


def summary_line(land: Column) -> Column:
    """One line of an offer; what is missing is named, caveats come last."""
    said = lambda c, pattern, none: F.coalesce(F.format_string(pattern, c), F.lit(none))
    known = lambda c, pattern, none: F.when(F.col(c).isNull(), none).otherwise(said(F.col(c), pattern, none))
    walk = known("walk_minutes", "徒歩%d分", "徒歩不明")
    commute = F.when(F.col("commute_minutes").isNotNull(), F.format_string("通勤%d分", "commute_minutes"))
    caveats = F.when(F.size("caveats") > 0, F.concat(F.lit("⚠"), F.array_join("caveats", "・")))
    flat = F.concat_ws(" / ", F.coalesce("layout", F.lit("—")), known("area_sqm", "%.1f㎡", "—"), known("age_years", "築%d年", "築年不明"), walk, commute, caveats)
    plot = F.concat_ws(" / ", known("land_area_sqm", "土地%.1f㎡", "土地面積不明"), walk, commute, caveats)
    return F.when(land, plot).otherwise(flat)


def access_lines(stations: Column, most: int = 4) -> Column:
    """A line per station (struct name, walk, ride), at most `most` and how many are left out; null without any."""
    line = lambda s: F.concat(F.lit("・"), s["name"], F.lit(" "), F.when(s["walk"].isNull(), "徒歩不明").otherwise(F.format_string("徒歩%d分", s["walk"])), F.when(s["ride"].isNotNull(), F.format_string(" → 通勤%d分", s["ride"])).otherwise(""))
    rest = F.when(F.size(stations) > most, F.array(F.format_string("（ほか%d駅）", F.size(stations) - most))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(stations) > 0, F.array_join(F.concat(F.transform(F.slice(stations, 1, most), line), rest), "\n"))


def market_text(family: Column) -> Column:
    """Short market line: missing for what reason, rate without ratio, or ratio and rate."""
    buy = family.isin("MANSION_BUY", "KODATE_BUY")
    cell = F.when(buy, F.col("city_name")).otherwise(F.concat_ws("・", "city_name", "layout"))
    missing = F.when(F.col("city_name").isNull(), "相場不明（市区を特定できず）").when(~buy & F.col("layout").isNull(), "相場不明（間取り不明）").otherwise(F.concat(F.lit("相場不明（"), cell, F.lit(" の相場は相場マスタに無い）")))
    unit = F.concat(man_yen(F.bround("rate_value").cast("long")), F.when(buy, "/㎡").otherwise("/月"))
    same = man_yen((F.bround(F.col("price") / F.nullif(F.col("market_rate_ratio"), F.lit(0.0)) / 10_000) * 10_000).cast("long"))
    with_ratio = F.concat(F.format_string("相場比%.2f（相場", "market_rate_ratio"), F.when(buy, same).otherwise(unit), F.lit("）"))
    alone = F.concat(F.lit("相場"), unit, F.when(buy, "（換算不可）").otherwise("（比較不可）"))
    comparable = F.col("market_rate_ratio").isNotNull() & (~buy | F.col("price").isNotNull())
    return F.when(family == "TOCHI_BUY", "相場未収録").when(F.col("rate_value").isNull(), missing).when(comparable, with_ratio).otherwise(alone)


def hazard_text(value: Column) -> Column:
    """Unresolved and checked-outside are different things."""
    return F.when(value.isNull(), "unresolved").when(value == 0, "outside").otherwise(F.format_number(value, 2))


def breakdown(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row per score item with points, rounded to four decimals."""
    rows = scores.select(*keys, F.explode("score_items").alias("i"))
    return rows.select(*keys, "i.code", "i.kind", "i.weight", F.round("i.s", 4).alias("s"), F.round(F.col("i.weight") * F.col("i.s"), 4).alias("points"), "i.status", "i.missing", "i.value")


def notifications(changes: DataFrame, sent: DataFrame, unit: str, kind: str, rank: str, most: int | None) -> DataFrame:
    """Changes not sent yet and within the rank limit (no rank passes), ranked ones first."""
    rows = changes.join(sent.select(unit, kind).distinct(), [unit, kind], "left_anti")
    if most is not None:
        rows = rows.where(F.col(rank).isNull() | (F.col(rank) <= most))
    return rows.orderBy(F.col(rank).asc_nulls_last(), unit)


def price_field(monthly_note: Column, land_note: Column) -> tuple[Column, Column]:
    """(heading, body) of an offer's price: homes to buy and land by price, homes to let by what is paid each month."""
    family = F.col("property_family")
    rent = F.concat(yen_text(F.col("rent_total")), F.lit("\n（賃料 "), yen_text(F.col("price")), F.lit(" + 管理費 "), yen_text(F.col("mgmt_fee_monthly")), F.lit("）"))
    heading = F.when(family == "CHINTAI", "月額").otherwise("価格")
    body = F.when(family == "TOCHI_BUY", F.concat(man_yen(F.col("price")), land_note)).when(family == "CHINTAI", rent).otherwise(F.concat(man_yen(F.col("price")), monthly_note))
    return heading, body


def number_text(value: Column) -> Column:
    """Whole numbers without decimals, others with two at most, trailing zeros dropped."""
    fine = F.rtrim(F.format_number(value, 2), F.lit("0"))
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(fine)


def must_text(value: Column, unit: str = "") -> Column:
    """A required or found value with its unit; unknown is said so."""
    return F.coalesce(F.concat(number_text(value.cast("double")), F.lit(unit)), F.lit("不明"))


def choice_text(values: Column) -> Column:
    return F.when(values.isNull(), "不明").when(F.size(values) == 0, "なし").otherwise(F.array_join(F.array_sort(values), "、"))


def attribute_rows(attributes: Column) -> Column:
    """Attributes as an array of (name, text) by name; true and false in words, null as a dash."""
    said = lambda v: F.when(v.isNull(), "—").when(v == "true", "はい").when(v == "false", "いいえ").otherwise(v)
    return F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.struct(e["key"].alias("name"), said(e["value"]).alias("text")))


def local_time(at: Column, zone: str = "Asia/Tokyo") -> Column:
    """A UTC time as shown to the user."""
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at), "yyyy-MM-dd HH:mm"), F.lit("—"))


def excluded_ahead(scores: DataFrame, most: int) -> DataFrame:
    """How many excluded offers stand before the last of the digest's places; only those places are sorted. scores: listing_id, score, is_excluded."""
    hidden = F.coalesce("is_excluded", F.lit(False))
    shown = scores.where(~hidden).orderBy(F.desc("score"), "listing_id").limit(most)
    last = shown.agg(F.min(F.struct("score", (-F.col("listing_id")).alias("id"))).alias("_edge"))
    ahead = (F.col("score") > F.col("_edge.score")) | ((F.col("score") == F.col("_edge.score")) & (F.col("listing_id") < -F.col("_edge.id")))
    return scores.where(hidden).crossJoin(F.broadcast(last)).agg(F.count_if(ahead).alias("n"))  # one row


def excluded_in_digest(ranked: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """How many excluded offers the digest's places would have shown. marks: listing_id, is_excluded."""
    first = ranked.where("rank is not null").join(marks, "listing_id", "left").select("rank", F.coalesce("is_excluded", F.lit(False)).alias("_x"))
    edge = first.where("not _x").orderBy("rank").limit(most).agg(F.max("rank").alias("_edge")).withColumn("_k", F.lit(1))
    return first.where("_x").withColumn("_k", F.lit(1)).join(edge, "_k").agg(F.count_if(F.col("rank") <= F.col("_edge")).alias("n"))
