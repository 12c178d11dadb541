"""A whole scan as one transaction per micro-batch: offers, details, groups, scores, notices and what was sent.

Every table is read as the batch before left it and written under this batch's number; the manifest
comes last. Groups keep their ids; what was sent is looked up by the offers that are *now* in a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe.operators import grouping, must, want
from lodeframe.operators.snapshot import filled, upserted
from lodeframe.plans import pattern as patterns
from lodeframe.sources.stored import written
from lodeframe.streaming.store import Store, Table

MEMBERS = "gk string, listing_id long, site_id long, site_priority int, rent_total long, price long, feature_count int, status string"
GROUPS = "gk string, group_id long, representative_id long, representative_cost long, member_count long"
SCORES = "gk string, listing_id long, score double, must string, config_hash string"
NOTICES = "batch long, gk string, group_id long, listing_id long, kind string, price long, price_prev long, score double, rank long"
#: Events that are told, and what a cheaper offer of a known home is called.
TOLD, CHEAPER = ("new", "price_down"), "cheaper"


@dataclass
class Plan:
    """What a scan does.

    offers: schema of the stored offers (listing_id, type, family, price, status, first_seen, last_seen and the
    columns of `overwrite` and `sticky`); views: turns them into what judging and grouping read (all columns of
    MEMBERS but gk, and dedup_key, property_family and those of the pattern); wanted: requirements that a list
    page can decide; details: gives (listing_id, columns of `detail`) for offers that have none yet (their first
    detail column is null), for the `most_details` oldest of a batch.
    """

    pattern: patterns.Pattern
    offers: str
    views: Callable[[DataFrame], DataFrame]
    overwrite: list[str]
    sticky: list[str]
    wanted: dict | None = None
    detail: list[str] = field(default_factory=list)
    details: Callable[[DataFrame], DataFrame] | None = None
    most_details: int = 1000
    most_rank: int | None = None


def opened(spark: SparkSession, path: str, plan: Plan, buckets: int = 64) -> Store:
    tables = {
        "offers": Table(plan.offers, ("listing_id",)), "members": Table(MEMBERS, ("gk",)), "groups": Table(GROUPS, ("gk",)), "scores": Table(SCORES, ("gk",)),
        "sent": Table("listing_id long, kind string, price long", ("listing_id",)), "cheaper": Table("gk string, group_id long, price long", ("gk",)), "notices": Table(NOTICES, ("gk",)),
    }
    return Store(spark, path, tables, buckets)


def _offers(store: Store, plan: Plan, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame, set[int]]:
    """(offers of the touched buckets, as before and with price_prev and event after the batch, buckets)."""
    if plan.wanted:
        batch = must.evaluated(batch, plan.wanted, list_stage=True).where(F.col("must") != must.FAIL).select(*batch.columns)
    touched = store.touched("offers", batch)
    before = store.read("offers", number - 1, touched)
    sticky = [c for c in plan.sticky if c in batch.columns]
    # columns that only a detail page has are none of the list page's business
    base = batch.select("*", *(F.lit(None).cast(before.schema[c].dataType).alias(c) for c in (*plan.detail, *plan.sticky) if c not in batch.columns))
    after = written(upserted(before, base, ["listing_id"], plan.overwrite, [*sticky, *plan.detail], str(number)))
    if plan.details:
        lacking = after.where(F.col(plan.detail[0]).isNull() & F.col("event").isNotNull()).orderBy("first_seen", "listing_id").limit(plan.most_details)
        after = written(filled(after, plan.details(lacking), "listing_id", plan.detail))
    return before, after, touched


def _sent(store: Store, number: int, candidates: DataFrame, members: DataFrame) -> DataFrame:
    """(gk, kind) that some offer which is now in the group was told by."""
    now = members.join(candidates.select("gk").distinct(), "gk", "left_semi").select("gk", "listing_id")
    log = store.read("sent", number - 1, store.touched("sent", now))
    return log.join(now, "listing_id").select("gk", "kind").distinct()


def step(store: Store, plan: Plan, batch: DataFrame, number: int) -> None:
    """One batch, from list rows to notices."""
    before, after, offer_buckets = _offers(store, plan, batch, number)
    store.put("offers", number, after)
    view = lambda rows: plan.views(rows).withColumn("gk", grouping.group_or_self())
    moved = after.where("relation in ('new', 'same_type', 'retype')").select("listing_id", "event", "price_prev")
    fresh = view(after).join(moved, "listing_id")
    stale = view(before).join(moved.select("listing_id"), "listing_id", "left_semi")
    keys = written(fresh.select("gk").unionByName(stale.select("gk")).distinct())
    group_buckets = store.touched("members", keys)
    columns = store.empty("members").columns
    rest = store.read("members", number - 1, group_buckets).join(moved.select("listing_id"), "listing_id", "left_anti")
    members = store.put("members", number, rest.select(*columns).unionByName(fresh.select(*columns)))

    groups, changed = grouping.synced_groups(store.read("groups", number - 1, group_buckets), members, keys, number)
    groups, changed = store.put("groups", number, groups), written(changed)

    # representatives of touched groups are judged; their rows lie in their own buckets
    stands = groups.join(keys, "gk", "left_semi").where("representative_id is not null").select("gk", "group_id", F.col("representative_id").alias("listing_id"))
    home = store.touched("offers", stands)
    rows = after.select(*before.columns).unionByName(store.read("offers", number - 1, home - offer_buckets))
    judged = patterns.judged(plan.views(rows.join(stands.select("listing_id"), "listing_id", "left_semi")), plan.pattern).where(F.col("must") != must.FAIL)
    judged = judged.join(stands, "listing_id").select("gk", "listing_id", "score", "must", "config_hash")
    scores = store.put("scores", number, store.read("scores", number - 1, group_buckets).join(keys, "gk", "left_anti").unionByName(judged))

    touched = {"offers": offer_buckets, "members": group_buckets, "groups": group_buckets, "scores": group_buckets}
    told = written(_notices(store, plan, number, fresh, members, groups, changed, scores, group_buckets).withColumn("batch", F.lit(number).cast("long")))
    for name, more in (("notices", told), ("sent", told.where(F.col("kind") != CHEAPER)), ("cheaper", told.where(F.col("kind") == CHEAPER))):
        touched[name] = store.touched(name, more)
        store.put(name, number, store.read(name, number - 1, touched[name]).unionByName(more.select(*store.empty(name).columns)))
    store.commit(number, touched)


def _notices(store: Store, plan: Plan, number: int, fresh: DataFrame, members: DataFrame, groups: DataFrame, changed: DataFrame, scores: DataFrame, buckets: set[int]) -> DataFrame:
    """Events of offers in groups whose representative passes, once per group and kind, and representatives that undercut the one before."""
    known = groups.select("gk", "group_id")
    events = fresh.where(F.col("event").isin(*TOLD)).select("gk", "listing_id", F.col("event").alias("kind"), "price", "price_prev")
    cheaper = changed.where("is_cheaper and old_id is not null").select("gk", F.col("new_id").alias("listing_id"), F.lit(CHEAPER).alias("kind"), F.col("new_cost").alias("price"), F.col("old_cost").alias("price_prev"))
    # one offer speaks for its group: the cheapest, then the smallest id
    speaks = F.struct(F.col("price").isNull().alias("u"), "price", "listing_id", "price_prev")
    events = written(events.groupBy("gk", "kind").agg(F.min(speaks).alias("b")).select("gk", "kind", "b.listing_id", "b.price", "b.price_prev"))
    events = events.join(_sent(store, number, events, members), ["gk", "kind"], "left_anti")
    told = store.read("cheaper", number - 1, buckets).select(F.col("group_id").alias("_g"), F.col("price").alias("_p"))
    cheaper = cheaper.join(known, "gk").join(told, (F.col("group_id") == F.col("_g")) & F.col("price").eqNullSafe(F.col("_p")), "left_anti")
    rows = events.join(known, "gk").unionByName(cheaper.select("gk", "listing_id", "kind", "price", "price_prev", "group_id")).join(scores.select("gk", "score"), "gk")
    if plan.most_rank is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    others = store.read("scores", number - 1).join(groups.select("gk").unionByName(rows.select("gk")).distinct(), "gk", "left_anti")
    best = want.top(scores.select("gk", "listing_id", "score").unionByName(others.select("gk", "listing_id", "score")), plan.most_rank)
    return rows.join(best.select("gk", F.col("rank").cast("long").alias("rank")), "gk")


def scan(offers: DataFrame, store: Store, plan: Plan, checkpoint: str) -> StreamingQuery:
    """Run all available list rows through the scan."""
    run = lambda batch, number: step(store, plan, batch, number)
    return offers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
