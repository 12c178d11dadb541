"""Addresses: comparable form, numbered blocks confirmed by joins with the address master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: digits of block numbers, hyphens, trailing notes
DIGITS = "一二三四五六七八九"
HYPHENS = "[-‐‑‒–—―ー−ｰ]"
NOTES = "(周辺地図|地図を見る|地図|以下未定|その他)+$"
PREFECTURE = "^(北海道|東京都|(?:京都|大阪)府|[^都道府県]{2,3}県)"


def kanji_number(word: Column) -> Column:
    """1 to 99 in kanji numerals, 〇 as 0; null for anything else."""
    digit = lambda c: F.when(c == "", None).otherwise(F.nullif(F.instr(F.lit(DIGITS), c), F.lit(0)))
    tens, ones = F.regexp_extract(word, f"^([{DIGITS}]?)十([{DIGITS}]?)$", 1), F.regexp_extract(word, f"^([{DIGITS}]?)十([{DIGITS}]?)$", 2)
    by_ten = F.coalesce(digit(tens), F.lit(1)) * 10 + F.coalesce(digit(ones), F.lit(0))
    return F.when(word == "〇", 0).when(word.rlike(f"^[{DIGITS}]?十[{DIGITS}]?$"), by_ten).when(word.rlike(f"^[{DIGITS}]$"), digit(word)).cast("int")


def comparable(address: Column, prefecture: Column) -> Column:
    """An NFKC address without blanks, notes and old village marks, hyphens unified, block numbers in digits.

    The prefecture goes in front unless the address starts with one.
    """
    value = F.regexp_replace(F.regexp_replace(address, r"[\s　]+", ""), NOTES, "")
    value = F.regexp_replace(value, HYPHENS, "-")
    value = F.when(value.rlike(PREFECTURE), value).otherwise(F.concat(F.coalesce(prefecture, F.lit("")), value))
    value = F.regexp_replace(F.replace(value, F.lit("大字"), F.lit("")), "(?<=[町村])字", "")
    value = F.translate(value, "ヶケ", "がが")
    word = F.regexp_extract(value, f"([〇十{DIGITS}]+)丁目", 1)
    number = kanji_number(word).cast("string")
    value = F.when((word != "") & number.isNotNull(), F.replace(value, F.concat(word, F.lit("丁目")), F.concat(number, F.lit("丁目")))).otherwise(value)
    return F.nullif(value, F.lit(""))


def resolved(rows: DataFrame, master: DataFrame, value: str) -> DataFrame:
    """rows and `address_normalized`: cut after a written block, else the first number is a block only where the master has it.

    master: town_key, chome_number (null for towns). A town the master knows without that block
    keeps its name alone; an unknown town keeps the number as a block. Lookups are equi-joins on
    the town, and on what stands before a sub-village mark.
    """
    towns = master.groupBy(F.col("town_key").alias("_t")).agg(F.collect_set("chome_number").alias("_chomes"))
    written = F.regexp_extract(value, "^(.*?丁目)", 1)
    before, number = F.regexp_extract(value, "^([^0-9]*)([0-9]+)", 1), F.regexp_extract(value, "^([^0-9]*)([0-9]+)", 2).try_cast("int")
    town = F.regexp_replace(before, "-+$", "")
    short = F.when(F.instr(town, "字") > 1, F.left(town, F.instr(town, "字") - 1))
    made = rows.withColumn("_town", town).withColumn("_short", short)
    made = made.join(towns.select(F.col("_t").alias("_town"), F.col("_chomes").alias("_c1")), "_town", "left").join(towns.select(F.col("_t").alias("_short"), F.col("_chomes").alias("_c2")), "_short", "left")
    block = F.concat(before, number.cast("string"), F.lit("丁目"))
    by = lambda chomes, name: F.when(F.array_contains(chomes, number), block).otherwise(name)
    answer = (
        F.when(F.col(value).isNull(), None).when(written != "", written).when(number.isNull(), F.col(value))
        .when(F.col("_c1").isNotNull(), by(F.col("_c1"), F.col("_town"))).when(F.col("_c2").isNotNull(), by(F.col("_c2"), F.col("_short"))).otherwise(block)
    )
    return made.select(*rows.columns, answer.alias("address_normalized"))


def station_key(name: Column) -> Column:
    """Comparable station name (NFKC): sub-names, the word for station and separators dropped, spellings unified."""
    plain = F.translate(F.regexp_replace(name, "[〈(][^〉)]{0,24}[〉)]", ""), "ヶヵッ之の", "ケカツノノ")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, "駅$", ""), r"[\s　・\-‐‑‒–—―ー]+", ""))


def city_key(name: Column) -> Column:
    return F.translate(name, "ヶヵ之", "ケカノ")


def rotated_areas(cities: DataFrame, values: DataFrame, wanted: list[str], by_code: bool) -> DataFrame:
    """Cities of the wanted names or wards of wanted cities, without cities that have wards, with their site value.

    by_code: the public code is the value; else cities without a registered value are left out.
    """
    parents = cities.where("parent_city is not null").select("prefecture", F.col("parent_city").alias("name")).distinct()
    rows = cities.join(parents, ["prefecture", "name"], "left_anti")
    if wanted:
        rows = rows.where(F.col("name").isin(wanted) | F.col("parent_city").isin(wanted))
    made = rows.join(values.select("city_id", F.col("value").alias("_v")), "city_id", "left").withColumn("value", F.col("jis_code") if by_code else F.col("_v"))
    return made.where("value is not null and value <> ''").drop("_v")


def claimed(state: DataFrame, patterns: list[str]) -> DataFrame:
    """The pattern of each site whose turn it is: never scanned first, then the longest ago, ties by name."""
    turn = F.struct(F.col("scanned_at").isNotNull().alias("been"), "scanned_at", "pattern", "cursor")
    best = state.where(F.col("pattern").isin(patterns)).groupBy("site").agg(F.min(turn).alias("t"))
    return best.select("site", "t.pattern", "t.cursor")
