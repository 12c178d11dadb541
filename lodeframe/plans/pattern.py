"""Declarative search patterns: validated, hashed, and turned into one DataFrame plan."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import grouping, must, want

FAMILY = {
    "CHINTAI": "CHINTAI", "SHINCHIKU_MANSION": "MANSION_BUY", "CHUKO_MANSION": "MANSION_BUY",
    "SHINCHIKU_KODATE": "KODATE_BUY", "CHUKO_KODATE": "KODATE_BUY", "TOCHI": "TOCHI_BUY",
}
KEYS = {"name", "property_type", "search", "must", "want", "commute", "utility", "ranking"}


class PatternError(ValueError):
    """A pattern that breaks a rule; the message names it."""


@dataclass(frozen=True)
class Pattern:
    name: str
    property_type: str
    must: dict[str, Any] = field(default_factory=dict)
    features: tuple[want.Feature, ...] = ()
    numerics: tuple[want.Numeric, ...] = ()
    ranking: dict[str, int] = field(default_factory=dict)
    commute: dict[str, Any] | None = None
    utility: dict[str, Any] | None = None

    @property
    def family(self) -> str:
        return FAMILY[self.property_type]

    @property
    def config_hash(self) -> str:
        """SHA-256 of what scores depend on, in canonical JSON."""
        body: dict[str, Any] = {
            "property_type": self.property_type,
            "features": [[list(f.codes), f.weight] for f in sorted(self.features, key=lambda f: f.key)],
            "numeric": [[n.metric, n.weight, n.best, n.worst, *([n.on_missing] if n.on_missing != "renormalize" else [])] for n in sorted(self.numerics, key=lambda n: n.metric)],
        }
        body |= {k: v for k, v in (("commute", self.commute), ("utility", self.utility)) if v}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    @property
    def columns(self) -> list[str]:
        """What judging a row reads, besides its identity."""
        metrics = {r.metric for name, r in must.REQUIREMENTS.items() if must.imposed(self.must.get(name)) and r.metric} | {n.metric for n in self.numerics}
        return [*sorted(metrics | {"layout", "feature_codes", "detail_fetched"})]

    def condition_codes(self) -> set[str]:
        return {c for f in self.features for c in f.codes} | set(self.must.get("features") or ())


def _require(holds: bool, message: str) -> None:
    if not holds:
        raise PatternError(message)


def parse(raw: dict[str, Any]) -> Pattern:
    """A pattern from a mapping (a YAML document), or PatternError."""
    _require(not (extra := set(raw) - KEYS), f"unknown keys {sorted(extra)}")
    kind = raw.get("property_type")
    _require(kind in FAMILY, f"unknown property type {kind}")
    family, wants = FAMILY[kind], raw.get("want") or {}
    _require(not (extra := set(wants) - {"features", "numeric"}), f"unknown keys in want {sorted(extra)}")
    features, numerics = [], []
    for f in wants.get("features") or []:
        _require(("code" in f) != ("any_of" in f), "exactly one of code and any_of")
        codes = (f["code"],) if "code" in f else tuple(f["any_of"])
        _require("code" in f or len(set(codes)) >= 2, "any_of needs two codes")
        features.append(want.Feature(codes, float(f["weight"])))
    for n in wants.get("numeric") or []:
        _require(n["metric"] in want.METRICS, f"unknown metric {n['metric']}")
        _require(n["best"] != n["worst"], f"{n['metric']}: best and worst must differ")
        numerics.append(want.Numeric(n["metric"], float(n["weight"]), float(n["best"]), float(n["worst"]), n.get("on_missing", "renormalize")))
    codes = [c for f in features for c in f.codes]
    _require(len(codes) == len(set(codes)), "a feature code repeats")
    metrics = [n.metric for n in numerics]
    _require(len(metrics) == len(set(metrics)), "a metric repeats")
    wanted = raw.get("must") or {}
    for name, value in wanted.items():
        _require(name == "unknown_policy" or name in must.REQUIREMENTS, f"unknown requirement {name}")
        if name != "unknown_policy" and must.imposed(value):
            _require(family in must.REQUIREMENTS[name].families, f"{name} does not apply to {kind}")
    _require(not ({"commute_minutes"} & set(metrics) or must.imposed(wanted.get("commute_minutes_max"))) or bool(raw.get("commute")), "commute section missing")
    if "living_cost" in metrics:
        _require(family == "CHINTAI" and bool(raw.get("utility")), "living_cost needs a utility section")
        _require("rent_total" not in metrics, "living_cost and rent_total exclude each other")
    return Pattern(raw["name"], kind, wanted, tuple(features), tuple(numerics), raw.get("ranking") or {}, raw.get("commute"), raw.get("utility"))


def unknown_codes(pattern: Pattern, known: set[str]) -> list[str]:
    return sorted(pattern.condition_codes() - known)


def drifted(stored_hashes: DataFrame, pattern: Pattern) -> bool:
    """Whether a stored score was made under another configuration."""
    return bool(stored_hashes.where((F.col("pattern") == pattern.name) & (F.col("config_hash") != pattern.config_hash)).limit(1).count())


def select(patterns: list[Pattern], names: list[str] | None = None, families: set[str] | None = None) -> list[Pattern]:
    """Patterns by name and family; a name that is missing is an error."""
    if missing := set(names or ()) - {p.name for p in patterns}:
        raise PatternError(f"no such patterns: {sorted(missing)}")
    return [p for p in patterns if (not names or p.name in names) and (not families or p.family in families)]


def judged(views: DataFrame, pattern: Pattern) -> DataFrame:
    """Requirements and score of a pattern's family."""
    rows = must.evaluated(views.where(F.col("property_family") == pattern.family), pattern.must)
    return want.scored(rows, list(pattern.features), list(pattern.numerics)).select("*", F.lit(pattern.name).alias("pattern"), F.lit(pattern.config_hash).alias("config_hash"))


def scored(views: DataFrame, pattern: Pattern, representative: str = "is_representative") -> DataFrame:
    """Requirements, score and rank of a pattern's family: fails and non-representatives get no rank."""
    return want.ranked(judged(views, pattern), ["pattern"], (F.col("must") != must.FAIL) & F.col(representative))


def judged_representatives(offers: DataFrame, pattern: Pattern, more: list[str] | None = None) -> DataFrame:
    """Requirements and score of the representatives of a pattern's family.

    The family (a part of every key) is filtered before groups are made, and only representatives are judged.
    """
    columns = ["listing_id", "site_id", "property_family", *(more or []), *pattern.columns]
    return judged(grouping.representative_rows(offers.where(F.col("property_family") == pattern.family), columns), pattern)


def best(offers: DataFrame, pattern: Pattern, most: int) -> DataFrame:
    """The first `most` of a pattern's ranking."""
    return want.top(judged_representatives(offers, pattern).where(F.col("must") != must.FAIL), most)
