"""Change detection as a stream: every micro-batch is upserted into the stored snapshot, group by group scored, and noticed.

A snapshot is a set of buckets by key. A batch writes only the buckets that its keys fall into, under
its own number, and a manifest that names the newest version of every bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe.operators import must
from lodeframe.operators.snapshot import upserted
from lodeframe.plans import pattern as patterns

BUCKETS = 64
Step = Callable[[DataFrame, DataFrame, int], None]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, snapshot: str, number: int) -> dict[int, int]:
    """The newest version of every bucket after a batch: at most as many as there are buckets."""
    if number < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{snapshot}/manifest/{number}").collect()}


def stored_rows(spark: SparkSession, snapshot: str, number: int, empty: DataFrame, only: set[int] | None = None) -> DataFrame:
    """Rows of the snapshot after batch `number`, of some buckets only if asked."""
    paths = [f"{snapshot}/data/{version}/bucket={k}" for k, version in sorted(versions(spark, snapshot, number).items()) if only is None or k in only]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def incremental(
    offers: DataFrame, snapshot: str, events: str, checkpoint: str, keys: list[str], overwrite: list[str], sticky: list[str], empty: Callable[[SparkSession], DataFrame],
    wanted: dict | None = None, then: Step | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Run all available offers through the snapshot; events are written per batch.

    wanted: requirements that a list page can decide; offers that fail them are left out before anything
    is stored. then: called with the batch's events, the snapshot and the batch's number. A batch is read
    against the versions before it and written under its own number, so a batch that is run again after a
    failure gives the same tables.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = empty(spark)
        if wanted:
            batch = must.evaluated(batch, wanted, list_stage=True).where(F.col("must") != must.FAIL).select(*batch.columns)
        touched = {r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect()}  # bucket numbers
        stored = stored_rows(spark, snapshot, number - 1, start, touched)
        made = upserted(stored, batch, keys, overwrite, sticky, str(number)).withColumn("bucket", _bucket(keys, buckets))
        made.write.mode("overwrite").parquet(f"{snapshot}/made/{number}")
        made = spark.read.parquet(f"{snapshot}/made/{number}")
        made.select(*start.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/data/{number}")
        newest = versions(spark, snapshot, number - 1) | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(newest.items()), "bucket int, version long").write.mode("overwrite").parquet(f"{snapshot}/manifest/{number}")
        changed = made.where("event is not null").select(*keys, "event", "price", "price_prev", F.lit(number).alias("batch"))
        changed.write.mode("overwrite").parquet(f"{events}/batch={number}")
        if then:
            then(changed, stored_rows(spark, snapshot, number, start), number)

    return offers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores_of_changes(pattern: patterns.Pattern, path: str, views: Callable[[DataFrame], DataFrame], keys: list[str]) -> Step:
    """A step that scores the groups whose members changed and writes `path`/batch=<number>: the representative, its score and the event.

    views: turns snapshot rows into what judging reads (dedup_key among it).
    """

    def step(changed: DataFrame, snapshot: DataFrame, number: int) -> None:
        offers = views(snapshot)
        hit = offers.join(changed.select(*keys, "event"), keys).select("dedup_key", "event")
        groups = hit.where("dedup_key is not null").groupBy("dedup_key").agg(F.min("event").alias("event"))
        members = offers.join(groups.select("dedup_key"), "dedup_key", "left_semi")
        best = patterns.judged_representatives(members, pattern, ["dedup_key"]).where(F.col("must") != must.FAIL)
        best.join(groups, "dedup_key").select("dedup_key", "listing_id", "score", "must", "event").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def first_notices(events: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """Each key once within the watermark: duplicate suppression of a stream."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, time: str, delay: str, length: str, *keys: str) -> DataFrame:
    """Counts per event-time window; late rows beyond the watermark are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
