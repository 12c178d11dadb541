"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a session without it (tests, local mode) gets one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """rows written once and read back: cuts the lineage, computes dear columns once, survives lost executors."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
