"""Three-valued requirements: every condition passes, fails or is unknown; the worst one decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import text

PASS, UNKNOWN, FAIL = "pass", "unknown", "fail"


@dataclass(frozen=True)
class Requirement:
    """A condition: its metric and direction, whether a list page can decide it, and the families it fits."""

    name: str
    metric: str | None
    direction: str
    on_list: bool
    families: tuple[str, ...]


RENT, FLATS, HOUSES, LAND = ("CHINTAI",), ("CHINTAI", "MANSION_BUY"), ("KODATE_BUY",), ("TOCHI_BUY",)
BUY, ALL = ("MANSION_BUY", "KODATE_BUY"), ("CHINTAI", "MANSION_BUY", "KODATE_BUY", "TOCHI_BUY")
#: In the order in which results are listed.
REQUIREMENTS = {
    r.name: r
    for r in (
        Requirement("rent_total_max", "rent_total", "max", True, RENT),
        Requirement("price_max", "price", "max", True, BUY + LAND),
        Requirement("monthly_cost_max", "monthly_cost", "max", False, ("MANSION_BUY",)),
        Requirement("layouts", None, "set", True, RENT + BUY),
        Requirement("area_min", "area_sqm", "min", True, FLATS),
        Requirement("area_max", "area_sqm", "max", True, FLATS),
        Requirement("land_area_min", "land_area_sqm", "min", True, HOUSES + LAND),
        Requirement("building_area_min", "building_area_sqm", "min", True, HOUSES),
        Requirement("age_max", "age_years", "max", True, RENT + BUY),
        Requirement("walk_minutes_max", "walk_minutes", "max", True, ALL),
        Requirement("commute_minutes_max", "commute_minutes", "max", False, ALL),
        Requirement("flood_rank_max", "flood_rank_max", "max", False, ALL),
        Requirement("landslide_special_ratio_max", "landslide_special_ratio", "max", False, ALL),
        Requirement("market_rate_ratio_min", "market_rate_ratio", "min", False, RENT),
        Requirement("floor_min", "floor_num", "min", False, FLATS),
        Requirement("freehold_only", "leasehold", "flag", False, BUY),
        Requirement("exclude_build_condition", "build_condition", "flag", False, LAND),
        Requirement("features", None, "features", False, ALL),
    )
}


def imposed(wanted: Any) -> bool:
    """None, False, an empty list and an empty text impose nothing; the number 0 does."""
    return not (wanted is None or wanted is False or wanted == [] or wanted == "")


def limited(value: Column, limit: float, direction: str) -> Column:
    holds = value <= limit if direction == "max" else value >= limit
    return F.when(value.isNull(), UNKNOWN).when(holds, PASS).otherwise(FAIL)


def _result(spec: Requirement, wanted: Any) -> Column:
    if spec.direction in ("max", "min"):
        return limited(F.col(spec.metric), float(wanted), spec.direction)
    if spec.direction == "flag":
        unwanted = F.col(spec.metric)
        return F.when(unwanted.isNull(), UNKNOWN).when(unwanted, FAIL).otherwise(PASS)
    if spec.direction == "set":
        plain = F.col("_layout")
        allowed = [text.layout(F.lit(x)) for x in wanted]
        return F.when(plain.isNull() | plain.rlike("[~～〜]"), UNKNOWN).when(F.array_contains(F.array(*allowed), plain), PASS).otherwise(FAIL)
    missing = F.array_except(F.array(*map(F.lit, sorted(set(wanted)))), F.coalesce("feature_codes", F.array().cast("array<string>")))
    return F.when(~F.col("detail_fetched"), UNKNOWN).when(F.size(missing) == 0, PASS).otherwise(FAIL)


def results(wanted: dict[str, Any], list_stage: bool = False) -> dict[str, Column]:
    """Result by name, in registry order; list_stage: what a list page can't decide is unknown."""
    if unknown := set(wanted) - set(REQUIREMENTS) - {"unknown_policy"}:
        raise ValueError(f"unknown requirements: {sorted(unknown)}")
    return {
        name: F.lit(UNKNOWN) if list_stage and not spec.on_list else _result(spec, wanted[name])
        for name, spec in REQUIREMENTS.items()
        if imposed(wanted.get(name))
    }


def passes(overall: Column, unknown_policy: str) -> Column:
    return (overall == PASS) | ((overall == UNKNOWN) & F.lit(unknown_policy == "keep"))


def names(found: Column, result: str) -> Column:
    return F.transform(F.filter(found, lambda x: x["result"] == result), lambda x: x["name"])


def evaluated(views: DataFrame, wanted: dict[str, Any], list_stage: bool = False) -> DataFrame:
    """views and must_checks (array of name and result), must (the worst result), must_passes (by unknown_policy, keep by default).

    Layouts and results are columns of their own, so that each is computed once however often it is used.
    """
    made = results(wanted, list_stage)
    rows = views.withColumn("_layout", text.layout(F.col("layout"))) if "layouts" in made else views
    rows = rows.select(*views.columns, *(r.alias(f"_must_{name}") for name, r in made.items()))
    at = {name: F.col(f"_must_{name}") for name in made}
    found = [F.struct(F.lit(name).alias("name"), c.alias("result")) for name, c in at.items()]
    has = lambda r: reduce(Column.__or__, (c == r for c in at.values()), F.lit(False))
    overall = F.when(has(FAIL), FAIL).when(has(UNKNOWN), UNKNOWN).otherwise(PASS)
    judged = rows.select(*views.columns, (F.array(*found) if found else F.array().cast("array<struct<name:string,result:string>>")).alias("must_checks"), overall.alias("must"))
    return judged.withColumn("must_passes", passes(F.col("must"), wanted.get("unknown_policy", "keep")))
