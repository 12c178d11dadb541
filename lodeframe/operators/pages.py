"""Filters, sort orders, pages, queues and rotation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import want

PAGE = 50


@dataclass(frozen=True)
class ListingFilter:
    """User filter; prices in ten thousands. None imposes nothing."""

    price_min: float | None = None
    price_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    walk_max: int | None = None
    must: str | None = None
    sites: list[int] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    favourites_only: bool = False
    show_excluded: bool = False
    sort: str = "rank"
    page: int = 1

    def __post_init__(self) -> None:
        if self.sort not in ORDERS or self.page < 1 or self.must not in (None, "pass", "unknown", "fail"):
            raise ValueError("filter out of bounds")
        for low, high in ((self.price_min, self.price_max), (self.area_min, self.area_max)):
            if any(x is not None and x < 0 for x in (low, high)) or (low is not None and high is not None and low > high):
                raise ValueError("filter out of bounds")

    @classmethod
    def from_query(cls, args: dict[str, str]) -> ListingFilter:
        """From query-string values; empty ones impose nothing, wrong ones raise ValueError."""
        number = lambda k: float(args[k]) if args.get(k) else None
        return cls(
            number("price_min"), number("price_max"), number("area_min"), number("area_max"), int(args["walk_max"]) if args.get("walk_max") else None, args.get("must") or None,
            [int(x) for x in args.get("sites", "").split(",") if x], [x for x in args.get("cities", "").split(",") if x],
            args.get("favourites_only") == "1", args.get("show_excluded") == "1", args.get("sort") or "rank", int(args.get("page") or 1),
        )


def _order(*columns: Column) -> list[Column]:
    return [*columns, F.col("rank").asc_nulls_last(), F.col("listing_id").asc()]


ORDERS = {
    "rank": lambda: _order(),
    "score": lambda: _order(F.col("score").desc_nulls_last()),
    "price": lambda: _order(F.col("cost").asc_nulls_last()),
    "area": lambda: _order(F.col("area_sqm").desc_nulls_last()),
    "walk": lambda: _order(F.col("walk_minutes").asc_nulls_last()),
    "age": lambda: _order(F.col("age_years").asc_nulls_last()),
    "newest": lambda: _order(F.col("first_seen").desc_nulls_last()),
}


def filtered(rows: DataFrame, flt: ListingFilter) -> DataFrame:
    """Conditions that reach the scan where the rows are one."""
    on = []
    if flt.price_min is not None:
        on.append(F.col("cost") >= flt.price_min * 10_000)
    if flt.price_max is not None:
        on.append(F.col("cost") <= flt.price_max * 10_000)
    if flt.area_min is not None:
        on.append(F.col("area_sqm") >= flt.area_min)
    if flt.area_max is not None:
        on.append(F.col("area_sqm") <= flt.area_max)
    if flt.walk_max is not None:
        on.append(F.col("walk_minutes") <= flt.walk_max)
    if flt.must:
        on.append(F.col("must") == flt.must)
    if flt.sites:
        on.append(F.col("site_id").isin(flt.sites))
    if flt.cities:
        on.append(F.col("city").isin(flt.cities))
    if flt.favourites_only:
        on.append(F.col("is_favourite"))
    if not flt.show_excluded and "is_excluded" in rows.columns:
        on.append(~F.coalesce("is_excluded", F.lit(False)))
    for c in on:
        rows = rows.where(c)
    return rows


def page(rows: DataFrame, flt: ListingFilter, size: int = PAGE) -> DataFrame:
    """One page with the total before paging as `total`."""
    kept = filtered(rows, flt)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    shown = kept.orderBy(*ORDERS[flt.sort]()).offset((flt.page - 1) * size).limit(size)
    return shown.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def digest(rows: DataFrame, most: int, excluded: DataFrame, key: str) -> DataFrame:
    """The first `most` by stored rank, exclusions removed before the limit; ranks keep their gaps, null ranks come last."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti").orderBy(F.col("rank").asc_nulls_last(), "listing_id").limit(most)


def detail_queue(rows: DataFrame, most: int, seen: str, key: str) -> DataFrame:
    """Half of the limit (rounded down) by age, oldest first, the rest newest first; no row twice."""
    oldest = rows.orderBy(F.col(seen).asc(), F.col(key).asc()).limit(most // 2).select(key, seen, F.lit("oldest").alias("part"))
    rest = rows.join(F.broadcast(oldest.select(key)), key, "left_anti")
    newest = rest.orderBy(F.col(seen).desc(), F.col(key).desc()).limit(most - most // 2).select(key, seen, F.lit("newest").alias("part"))
    return oldest.unionByName(newest)


def check_targets(rows: DataFrame, ranked: int, stale: int, key: str, seen: str) -> DataFrame:
    """Best ranked and longest unseen rows, each once; ranked ones keep their rank."""
    best = rows.where("rank is not null").orderBy("rank", key).limit(ranked).select(key, "rank")
    old = rows.orderBy(F.col(seen).asc(), F.col(key).asc()).limit(stale).select(key, "rank")
    return best.union(old).distinct()


def check_targets_by_score(rows: DataFrame, ranked: int, stale: int, key: str, seen: str) -> DataFrame:
    """The same from scores: only the first `ranked` rows are ranked, and the `stale` ones by counting who stands before them in one scan."""
    best = want.top(rows.select("score", F.col(key).alias("listing_id")), ranked).select(F.col("listing_id").alias(key), "rank")
    old = rows.orderBy(F.col(seen).asc(), F.col(key).asc()).limit(stale).select(key, "score").collect()  # `stale` rows
    if not old:
        return best
    before = [F.count_if((F.col("score") > r["score"]) | ((F.col("score") == r["score"]) & (F.col(key) < r[key]))) for r in old]
    pairs = F.array(*(F.struct(F.lit(r[key]).alias(key), (n + 1).cast("long").alias("rank")) for r, n in zip(old, before, strict=True)))
    return best.unionByName(rows.agg(pairs.alias("p")).select(F.inline("p"))).distinct()


def rotated(areas: DataFrame, code: str, cursor: str | None, size: int) -> DataFrame:
    """The next `size` areas after the cursor, around the end, with their position."""
    passed = F.lit(False) if cursor is None else F.col(code) <= cursor
    taken = areas.withColumn("_passed", passed).orderBy("_passed", code).limit(size)
    return taken.drop("_passed")


def facet(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def summary(rows: DataFrame, pattern: list[str]) -> DataFrame:
    """Rows, passing, unknown and ranked rows, and the best score."""
    return rows.groupBy(*pattern).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("must") == "pass").alias("passing"), F.count_if(F.col("must") == "unknown").alias("unknown"),
        F.count("rank").alias("ranked"), F.max("score").alias("best_score"),
    )
