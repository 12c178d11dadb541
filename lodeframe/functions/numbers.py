"""Numeric expressions of offers: costs, scores, loans, tariffs, distances."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def rent_total(price: Column, fee: Column) -> Column:
    """Price and fee; null without a price."""
    return F.when(price.isNotNull(), price + F.coalesce(fee, F.lit(0)))


def monthly_cost(fee: Column, reserve: Column) -> Column:
    """Sum of two fees; null only if both are."""
    return F.when(fee.isNotNull() | reserve.isNotNull(), F.coalesce(fee, F.lit(0)) + F.coalesce(reserve, F.lit(0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where either is missing or the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0))


def share_of_range(value: Column, best: float, worst: float) -> Column:
    """0 at worst, 1 at best, clamped; the order of the two gives the direction."""
    if best == worst:
        raise ValueError("best and worst must differ")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(worst)) - value) / F.lit(float(worst) - float(best))))


def loan_payment(price: Column, annual_rate: float = 0.005, years: int = 35) -> Column:
    """Monthly annuity of a loan over the whole price, whole yen; null for a missing or non-positive price."""
    months, rate = years * 12, annual_rate / 12
    growth = (1 + rate) ** months
    paid = price / months if rate == 0 else price * (rate * growth / (growth - 1))
    return F.when(price > 0, F.bround(paid).cast("long"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance."""
    turn = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(turn)) * (2 * radius)


def ride_minutes(km: Column, detour: float = 1.15, speed: float = 35.0) -> Column:
    return km * detour / speed * 60


def commute_estimate(km: Column, transfers: Column, at_origin: Column, base: float = 8.7, per_km: float = 1.14, per_transfer: float = 5.6) -> Column:
    """Whole minutes by regression on distance and transfers; 0 at the origin itself."""
    return F.when(at_origin, F.lit(0)).otherwise(F.ceil(F.lit(base) + km * per_km + transfers * per_transfer).cast("int"))


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    """Web-map tile numbers (x, y) of a place."""
    n = 2.0**zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    return F.struct(x.alias("x"), y.alias("y"))


# --- energy ---------------------------------------------------------------------------------
# fixed values: published tariffs, demand and efficiencies
CITY_GAS = ((20.0, 759.0, 185.13), (80.0, 1056.0, 170.28), (200.0, 1232.0, 168.08))  # up to m3, basic, per m3
LPG = ((5.0, 5960.0), (10.0, 9736.0), (20.0, 16744.0), (50.0, 35790.0))  # m3, yen
POWER_BASIC, POWER = 935.25, ((120.0, 29.80), (300.0, 36.40), (math.inf, 40.49))  # up to kWh, per kWh
POWER_EXTRA = -5.80 + 4.18
ALL_ELECTRIC = (1247.00, 35.76, 27.86, 0.20)  # basic, day, night, night share of the base load
HEAT_RISE = 4.186 * 23.0 * 30 / 1000.0  # MJ a month for a litre a day
EFFICIENCY = {"gas_heater": 0.80, "gas_stove": 0.50, "ih": 0.90, "electric_heater": 0.90}
CITY_MJ, LPG_MJ, KWH_MJ = 45.0, 99.0, 3.6


@dataclass(frozen=True)
class Household:
    litres: float
    cooking: float
    base: float


HOUSEHOLDS = {1: Household(130.0, 50.0, 200.0), 2: Household(240.0, 85.0, 300.0)}


def city_gas_bill(volume: Column) -> Column:
    """The tier of the volume decides basic and unit price; the last tier has no end."""
    bill = F.lit(CITY_GAS[-1][1]) + volume * CITY_GAS[-1][2]
    for most, basic, unit in reversed(CITY_GAS[:-1]):
        bill = F.when(volume <= most, F.lit(basic) + volume * unit).otherwise(bill)
    return F.when(volume <= 0, F.lit(0.0)).otherwise(bill)


def lpg_bill(volume: Column, factor: float = 1.0) -> Column:
    """Linear between the published points, with the slopes of the ends beyond them."""
    line = lambda k: F.lit(LPG[k][1]) + (volume - LPG[k][0]) * ((LPG[k + 1][1] - LPG[k][1]) / (LPG[k + 1][0] - LPG[k][0]))
    bill = line(len(LPG) - 2)
    for k in reversed(range(len(LPG) - 2)):
        bill = F.when(volume <= LPG[k + 1][0], line(k)).otherwise(bill)
    return F.when(volume <= 0, F.lit(0.0)).otherwise(bill * factor)


def power_bill(kwh: Column) -> Column:
    """Every step's part at its own price, plus surcharges."""
    bill, low = F.lit(POWER_BASIC), 0.0
    for high, price in POWER:
        part = kwh - low if high == math.inf else F.least(kwh, F.lit(high)) - low
        bill = bill + F.greatest(part, F.lit(0.0)) * price
        low = high
    return bill + kwh * POWER_EXTRA


def all_electric_bill(day: Column, night: Column) -> Column:
    return F.lit(ALL_ELECTRIC[0]) + day * ALL_ELECTRIC[1] + night * ALL_ELECTRIC[2] + (day + night) * POWER_EXTRA


def utility_bill(gas: str, ih: bool, people: int, factor: float = 1.0) -> Column:
    """Monthly bill for a known energy source ("city", "lpg", "electric") and stove."""
    home = HOUSEHOLDS[people]
    hot, cook = home.litres * HEAT_RISE, home.cooking / EFFICIENCY["ih"] / KWH_MJ
    if gas == "electric":
        night = hot / EFFICIENCY["electric_heater"] / KWH_MJ + home.base * ALL_ELECTRIC[3]
        return all_electric_bill(F.lit(cook + home.base * (1 - ALL_ELECTRIC[3])), F.lit(night))
    if gas not in ("city", "lpg"):
        raise ValueError(f"unknown energy source {gas}")
    heat = hot / EFFICIENCY["gas_heater"] + (0.0 if ih else home.cooking / EFFICIENCY["gas_stove"])
    burnt = city_gas_bill(F.lit(heat / CITY_MJ)) if gas == "city" else lpg_bill(F.lit(heat / LPG_MJ), factor)
    return burnt + power_bill(F.lit(home.base + (cook if ih else 0.0)))


def estimated_utility(codes: Column, people: int, lpg_chance: float, factor: float = 1.0, names: dict[str, str] | None = None) -> Column:
    """Estimate from feature codes: struct(yen, gas, gas_basis, stove, stove_basis, city_yen, lpg_yen).

    Both kinds of gas are a conflict; a conflict or no mark takes the expected value.
    """
    name = {"city": "GAS_CITY", "lpg": "GAS_LPG", "electric": "ALL_ELECTRIC", "ih": "STOVE_IH", "stove": "STOVE_GAS"} | (names or {})
    has = {k: F.array_contains(codes, v) for k, v in name.items()}
    gas = F.when(has["city"] & has["lpg"], "unknown").when(has["city"], "city").when(has["lpg"], "lpg").when(has["electric"], "electric").otherwise("unknown")
    basis = F.when(has["city"] & has["lpg"], "conflict").when(has["city"] | has["lpg"] | has["electric"], "listing").otherwise("prior")
    ih = has["ih"] | (gas == "electric")
    by_stove = lambda kind: F.when(ih, utility_bill(kind, True, people, factor)).otherwise(utility_bill(kind, False, people, factor))
    city, lpg = by_stove("city"), by_stove("lpg")
    total = F.when(gas == "electric", utility_bill("electric", True, people)).when(gas == "city", city).when(gas == "lpg", lpg).otherwise(lpg * lpg_chance + city * (1.0 - lpg_chance))
    whole = lambda c: F.bround(c).cast("long")
    return F.struct(
        whole(total).alias("yen"), gas.alias("gas"), basis.alias("gas_basis"), F.when(ih, "ih").otherwise("gas").alias("stove"),
        F.when(has["ih"] | ((gas != "electric") & has["stove"]), "listing").otherwise("assumed").alias("stove_basis"),
        F.when(gas != "electric", whole(city)).alias("city_yen"), F.when(gas != "electric", whole(lpg)).alias("lpg_yen"),
    )
