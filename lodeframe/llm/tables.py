"""Shared plumbing: written intermediate tables, bounded sizes, distributed numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.sources.stored import shared_dir, written

__all__ = ["bucketed", "free_name", "numbered", "one_per_id", "parts_for", "read", "shared_dir", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column has it (names don't depend on case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Like written(), in `parts` buckets by key: joins and groups by that key need no further shuffle."""
    spark = df.sparkSession
    name = f"lodeframe_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table, so that others can't clash and aren't scanned."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def one_per_id(df: DataFrame, key: str) -> DataFrame:
    """Rows of one id count once (the smallest row); rows without an id are left out."""
    rest = [c for c in df.columns if c != key]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(key, *(F.col("_row")[c].alias(c) for c in rest))


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions so that each gets about per_part rows, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 within each group, without a group meeting in one task.

    Rows of a group are spread over `buckets` hash buckets; each bucket is numbered by itself
    and shifted by the sizes of the buckets before it. The order columns decide within a bucket
    and, through their hash, between buckets: a total order, but not a sorted one.
    """
    marked = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = marked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    local = marked.withColumn("_local", F.row_number().over(inner) - 1)
    return (
        local.join(shifts, [*group, "_bucket"])
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_bucket", "_local", "_shift")
    )
