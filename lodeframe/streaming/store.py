"""Several tables that change together: buckets of rows under batch numbers, and one manifest for all of them.

A batch writes the buckets it touches under its own number and, last, a manifest that names the
version of every bucket of every table. Readers see what a manifest names, so a batch that dies
between two writes changes nothing, and run again it writes the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, bucket int, version long"


@dataclass(frozen=True)
class Table:
    """Columns as a schema string, and the columns whose hash gives the bucket."""

    columns: str
    key: tuple[str, ...]


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name].key), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, *rows: DataFrame) -> set[int]:
        """Buckets of a table that rows with its key fall into: bucket numbers only."""
        found: set[int] = set()
        for part in rows:
            found |= {r[0] for r in part.select(self.bucket(name)).distinct().collect()}
        return found

    def versions(self, number: int) -> dict[tuple[str, int], int]:
        """Versions after a batch: at most tables x buckets."""
        if number < 0:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{number}").collect()
        return {(r["name"], r["bucket"]): r["version"] for r in rows}

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[name].columns)

    def read(self, name: str, number: int, only: set[int] | None = None) -> DataFrame:
        """Rows of a table after a batch, of some buckets only if asked."""
        by_version: dict[int, list[int]] = {}
        for (table, bucket), version in self.versions(number).items():
            if table == name and (only is None or bucket in only):
                by_version.setdefault(version, []).append(bucket)
        if not by_version:
            return self.empty(name)
        base = f"{self.path}/data/{name}"
        rows = self.spark.read.schema(f"{self.tables[name].columns}, version long, bucket int").option("basePath", base)
        rows = rows.parquet(*(f"{base}/version={v}" for v in sorted(by_version)))
        named = F.lit(False)
        for version, wanted in by_version.items():
            named |= (F.col("version") == version) & F.col("bucket").isin(wanted)
        return rows.where(named).drop("version", "bucket")

    def put(self, name: str, number: int, rows: DataFrame) -> DataFrame:
        """Writes all rows of the touched buckets under the batch's number, and reads them back."""
        target = f"{self.path}/data/{name}/version={number}"
        columns = self.empty(name).columns
        placed = rows.select(*columns).withColumn("bucket", self.bucket(name))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(target)
        return self.spark.read.schema(f"{self.tables[name].columns}, bucket int").parquet(target).drop("bucket")

    def commit(self, number: int, touched: dict[str, set[int]]) -> None:
        """The one write that counts: one small file."""
        newest = self.versions(number - 1) | {(name, bucket): number for name, buckets in touched.items() for bucket in buckets}
        rows = [(name, bucket, version) for (name, bucket), version in sorted(newest.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
