"""Snapshots as dataflow: upserts by column policy, change events, suppression, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDED = ("sold", "removed")


def relation(old_type: Column, old_family: Column, old_status: Column, new_type: Column, new_family: Column) -> Column:
    """How an incoming row relates to the stored one of its key."""
    return (
        F.when(old_type.isNull(), "new")
        .when(old_family != new_family, "family_mismatch")
        .when(old_type == new_type, "same_type")
        .when(old_status.isin(*ENDED), "retype")
        .otherwise("type_mismatch")
    )


def price_event(is_new: Column, reinstated: Column, new: Column, old: Column) -> Column:
    return (
        F.when(is_new | reinstated, "new").when(new > old, "price_up").when(new < old, "price_down")
    )


def last_of_each(batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by `order`, ties and batches without an order by all columns (the largest)."""
    rest = [c for c in batch.columns if c not in keys]
    first = [F.col(order).alias("_o")] if order else []
    picked = batch.groupBy(*keys).agg(F.max(F.struct(*first, F.struct(*rest).alias("_row"))).alias("_m"))
    return picked.select(*keys, "_m._row.*").select(*batch.columns)


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], overwrite: list[str], sticky: list[str], seen: str, order: str | None = None) -> DataFrame:
    """Stored rows after a batch, with price_prev, relation and event of the rows it touched.

    overwrite: the batch's value even if null; sticky: the old value where the batch has none.
    Rows of another family, or of another type while active, stay as they are. A retyped row starts
    anew. Both sides have type, family, status, price and first_seen. `seen` is the batch's time.
    A key that comes several times in a batch counts once, by its last row (see last_of_each).
    """
    batch = last_of_each(batch, keys, order)
    a, b = stored.alias("a"), batch.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    there, comes = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    how = F.when(comes, relation(F.col("a.type"), F.col("a.family"), F.col("a.status"), F.col("b.type"), F.col("b.family")))
    taken = comes & how.isin("new", "same_type", "retype")
    fresh = how.isin("new", "retype")
    pick = lambda c, policy: F.when(taken, F.when(fresh, F.col(f"b.{c}")).otherwise(policy)).otherwise(F.col(f"a.{c}"))
    reinstated = taken & there & F.col("a.status").isin(*ENDED)
    return both.select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys),
        F.when(taken, F.col("b.type")).otherwise(F.col("a.type")).alias("type"),
        F.when(taken, F.col("b.family")).otherwise(F.col("a.family")).alias("family"),
        F.when(taken, "active").otherwise(F.col("a.status")).alias("status"),
        *(pick(c, F.col(f"b.{c}")).alias(c) for c in overwrite),
        *(pick(c, F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in sticky),
        F.when(taken & ~fresh, F.col("a.price")).alias("price_prev"),
        F.when(there, F.col("a.first_seen")).otherwise(F.lit(seen)).alias("first_seen"),
        F.when(taken, F.lit(seen)).otherwise(F.col("a.last_seen")).alias("last_seen"),
        how.alias("relation"),
        F.when(taken, price_event(how == "new", F.coalesce(reinstated, F.lit(False)), F.col("b.price"), F.col("a.price"))).alias("event"),
    )


def without_retyped(rows: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Stored features or scores without those of offers that start anew under another type: what was known of the old one is gone."""
    return rows.join(after.where("relation = 'retype'").select(*keys), keys, "left_anti")


def merged_maps(old: Column, new: Column) -> Column:
    """Shallow merge, the right side wins."""
    old, new = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def filled(stored: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Detail merge: new values where there are any."""
    b = details.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    return stored.join(b, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns))


def unsent(candidates: DataFrame, sent: DataFrame, by_price: bool = False) -> DataFrame:
    """Candidates (unit, kind, price) without a record; with by_price, at the very same price (null-safe)."""
    a, b = candidates.alias("a"), sent.alias("b")
    on = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.kind") == F.col("b.kind"))
    if by_price:
        on &= F.col("a.price").eqNullSafe(F.col("b.price"))
    return a.join(b, on, "left_anti")


def banded(scores: DataFrame, band: DataFrame, keys: list[str]) -> DataFrame:
    """Only scores inside the band."""
    return scores.join(band.select(*keys).distinct(), keys, "left_semi")


def with_status(rows: DataFrame, ids: DataFrame, status: str, key: str = "listing_id") -> DataFrame:
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def newest_periods(rows: DataFrame, period: str, keep: int) -> DataFrame:
    """Rows of the newest `keep` periods: a top-k over the distinct periods, then a semi-join."""
    kept = rows.select(period).distinct().orderBy(F.desc(period)).limit(keep)
    return rows.join(F.broadcast(kept), period, "left_semi")


def merged_features(groups: list[DataFrame]) -> DataFrame:
    """(listing_id, code, source): the first group that has a code wins."""
    whole = None
    for n, rows in enumerate(groups):
        rows = rows.select("listing_id", "code", F.struct(F.lit(n).alias("n"), F.col("source")).alias("s"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy("listing_id", "code").agg(F.min("s").alias("s")).select("listing_id", "code", F.col("s.source").alias("source"))
