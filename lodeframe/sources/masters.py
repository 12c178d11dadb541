"""Master data from CSV and JSON files, validated while read; sinks by full replacement or append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checked(rows: DataFrame, holds: Column, message: str) -> DataFrame:
    """rows, or an error at the first that breaks a rule (null counts as broken)."""
    bad = F.when(~F.coalesce(holds, F.lit(False)), F.raise_error(F.lit(message)))
    return rows.withColumn("_bad", bad).where(F.col("_bad").cast("string").isNull()).drop("_bad")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; a header that differs is an error, not a shift of columns."""
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{path}: columns missing: {missing}")
    return rows.select(*columns)


#: Where address points come from, as the table says it.
ADDRESS_SOURCE = "mlit_isj"
ADDRESS = ["prefecture", "city", "town", "latitude", "longitude", "kind"]


def _in_order(rows: DataFrame) -> DataFrame:
    """rows and `_place`: file by file in the order of their names, in a file by line."""
    return rows.withColumn("_place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")))


def address_points(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """(key, level, city_code, town_key, chome_number, longitude, latitude, source, merged, and what was seen on the way).

    Of several rows of a key the first counts, file by file; the names of the others are listed in `merged`.
    kind 3 rows are numbered blocks: their name must end in a number; other rows are towns, whatever
    their name ends with. The observation (rows, blocks, towns, without_place) has its values after the first action.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if missing := [c for c in ADDRESS if c not in rows.columns]:
        raise ValueError(f"{path}: columns missing: {missing}")
    code = F.trim("city_code") if "city_code" in rows.columns else F.lit(None).cast("string")
    rows = _in_order(rows).withColumn("city_code", code)
    rows = rows.withColumn("chome_number", F.when(F.col("kind") == "3", F.nullif(F.regexp_extract("town", "([0-9]+)丁目$", 1), F.lit("")).cast("int")))
    rows = checked(rows, (F.col("kind") != "3") | F.col("chome_number").isNotNull(), "a block without a number")
    key = F.concat("prefecture", "city", F.replace("town", F.lit("大字"), F.lit("")))
    block = F.col("kind") == "3"
    keyed = rows.withColumn("key", key).withColumn("town_key", F.when(block, F.regexp_replace(key, "[0-9]+丁目$", "")).otherwise(key)).withColumn("level", F.when(block, "chome").otherwise("town"))
    seen = Observation()
    number = lambda c: F.col(c).try_cast("double")
    keyed = keyed.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(block).alias("blocks"), F.count_if(~block).alias("towns"), F.count_if(number("latitude").isNull() | number("longitude").isNull()).alias("without_place")
    )
    first = F.struct("_place", "town", "town_key", "chome_number", "city_code", "latitude", "longitude")
    names = keyed.groupBy("key", "level").agg(F.min(first).alias("r"), F.array_sort(F.collect_list(F.struct("_place", "town")))["town"].alias("names"))
    found = names.select(
        "key", "level", "r.city_code", "r.town_key", "r.chome_number", F.col("r.longitude").try_cast("double").alias("longitude"), F.col("r.latitude").try_cast("double").alias("latitude"),
        F.lit(ADDRESS_SOURCE).alias("source"), F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))).alias("merged"),
    )
    return found, seen


HAZARDS = ("flood", "landslide", "landslide_special", "liquefaction")
AGGREGATIONS = ["area_ratio", "rank_avg", "rank_max"]


def hazard_levels(spark: SparkSession, path: str) -> DataFrame:
    """Wide file to long rows: key, level, hazard_type, aggregation, value."""
    rows = csv(spark, path, ["normalized_key", "level", "hazard_type", *AGGREGATIONS])
    rows = checked(rows, F.col("level").isin("chome", "town") & F.col("hazard_type").isin(*HAZARDS), "unknown level or hazard")
    long = rows.unpivot(["normalized_key", "level", "hazard_type"], AGGREGATIONS, "aggregation", "value").withColumn("value", F.col("value").try_cast("double"))
    return checked(long, (F.col("value") >= 0) & ((F.col("aggregation") != "area_ratio") | (F.col("value") <= 1)), "hazard value out of range")


def rent_rates(spark: SparkSession, path: str) -> DataFrame:
    rows = csv(spark, path, ["city", "layout", "rate_value", "stat_basis", "period"]).withColumn("rate_value", F.col("rate_value").try_cast("double"))
    return checked(rows, F.col("rate_value").between(10_000, 2_000_000) & F.col("stat_basis").isin("rent_listed_mansion", "rent_listed_apart"), "rent rate out of range")


def purchase_rates(spark: SparkSession, path: str) -> DataFrame:
    rows = csv(spark, path, ["family", "city", "segment", "rate_value", "stat_basis", "sample_count", "period"])
    rows = rows.withColumn("rate_value", F.col("rate_value").try_cast("double")).withColumn("sample_count", F.col("sample_count").try_cast("int"))
    return checked(rows, F.col("rate_value").between(5_000, 20_000_000) & (F.col("sample_count") >= 10) & F.col("family").isin("MANSION_BUY", "KODATE_BUY"), "purchase rate out of range")


def stations(spark: SparkSession, stations_path: str, lines_path: str, companies_path: str) -> tuple[DataFrame, Observation]:
    """(operating stations with line and company; how many rows were left out by reason, counted in the same scan).

    The observation (rows, closed_stations, closed_lines) has its values after the first action on the rows.
    """
    s = csv(spark, stations_path, ["station_cd", "station_g_cd", "station_name", "line_cd", "pref_cd", "lon", "lat", "e_status"])
    lines = csv(spark, lines_path, ["line_cd", "line_name", "company_cd", "e_status"]).withColumnRenamed("e_status", "line_status")
    companies = csv(spark, companies_path, ["company_cd", "company_name"])
    whole = s.join(lines, "line_cd", "left").join(companies, "company_cd", "left")
    open_line = F.coalesce(F.col("line_status") == "0", F.lit(False))
    seen = Observation()
    whole = whole.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("e_status") != "0").alias("closed_stations"), F.count_if((F.col("e_status") == "0") & ~open_line).alias("closed_lines"))
    return whole.where((F.col("e_status") == "0") & open_line), seen


def links(spark: SparkSession, path: str) -> DataFrame:
    rows = csv(spark, path, ["station_cd1", "station_cd2"])
    return rows.select(F.col("station_cd1").cast("long").alias("a"), F.col("station_cd2").cast("long").alias("b"))


def trades(spark: SparkSession, path: str, schema: str, quarters: int) -> DataFrame:
    """JSON records of the newest quarters by their period column."""
    rows = spark.read.schema(schema).json(path)
    newest = rows.select("period").distinct().orderBy(F.desc("period")).limit(quarters)
    return rows.join(F.broadcast(newest), "period", "left_semi")


def replaced(rows: DataFrame, path: str) -> None:
    """Full replacement of a table."""
    rows.write.mode("overwrite").parquet(path)


def appended(rows: DataFrame, path: str) -> None:
    """Append-only logs: notifications, digests, runs."""
    rows.write.mode("append").parquet(path)


def seeded(spark: SparkSession, folder: str, path: str, tables: dict[str, tuple[list[str], int]]) -> dict[str, int]:
    """Writes the seed files folder/<table>*.csv as whole tables under path; table -> (columns, least rows) gives the rows of each.

    All files are read and counted before the first table is written: a missing column, or fewer rows than
    expected, is an error that leaves every table as it was. Running it again gives the same tables.
    """
    found = {name: csv(spark, f"{folder}/{name}*.csv", columns) for name, (columns, _) in tables.items()}
    counts = {name: rows.count() for name, rows in found.items()}
    if few := {name: n for name, n in counts.items() if n < tables[name][1]}:
        raise ValueError(f"fewer rows than expected: {few}")
    for name, rows in found.items():
        replaced(rows, f"{path}/{name}")
    return counts


def synced(stored: DataFrame, fresh: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table after upsert and removal of what is gone, counts of inserted, updated, removed)."""
    a = stored.select(*keys, F.struct(*values).alias("_old"))
    b = fresh.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, keys, "full")
    counts = both.agg(
        F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_new").isNull()).alias("removed"),
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("updated"),
    )
    return both.where("_new is not null").select(*keys, *(F.col("_new")[v].alias(v) for v in values)), counts


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
