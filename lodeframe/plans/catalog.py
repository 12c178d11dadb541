"""Pattern files and what is done with all of them: check, rescore, find stale scores."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import must, views, want
from lodeframe.plans import pattern as patterns
from lodeframe.sources.stored import written

SCORES = ("pattern", "listing_id", "score", "must", "config_hash", "breakdown", "rank")


def load(folder: str) -> list[patterns.Pattern]:
    """The patterns of folder/*.yaml by name of file, a few kilobytes each.

    A file that is no mapping, breaks a rule, or repeats a name is an error that says which file; none at all is one too.
    """
    import yaml

    found: dict[str, patterns.Pattern] = {}
    for path in sorted(Path(folder).glob("*.yaml")):
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
        if not isinstance(raw, dict):
            raise patterns.PatternError(f"{path.name}: no mapping")
        try:
            one = patterns.parse(raw)
        except (patterns.PatternError, KeyError, TypeError) as e:
            raise patterns.PatternError(f"{path.name}: {e}") from e
        if one.name in found:
            raise patterns.PatternError(f"{path.name}: {one.name} is there already")
        found[one.name] = one
    if not found:
        raise patterns.PatternError(f"no patterns in {folder}")
    return list(found.values())


def faults(loaded: list[patterns.Pattern], codes: dict[str, set[str]]) -> dict[str, list[str]]:
    """Pattern -> condition codes that its family's dictionary doesn't have; codes: family -> known codes, derived ones too."""
    found = {p.name: patterns.unknown_codes(p, codes.get(p.family, set())) for p in loaded}
    return {name: unknown for name, unknown in found.items() if unknown}


def rescored(offers: DataFrame, loaded: list[patterns.Pattern]) -> DataFrame:
    """The score table of all patterns anew: rows of SCORES for every representative, ranked among those that don't fail.

    One pass over the offers for each family's groups and pattern; ranks of all patterns come from one sort by ranges.
    """
    rows = None
    for one in loaded:
        made = patterns.judged_representatives(offers, one)
        made = views.saved_scores(made)
        rows = made if rows is None else rows.unionByName(made)
    return want.ranked(written(rows), ["pattern"], F.col("must") != must.FAIL).select(*SCORES)


def stale(scores: DataFrame, loaded: list[patterns.Pattern]) -> DataFrame:
    """pattern, rows, why: scores made under another configuration (changed), or by a pattern that is gone (gone)."""
    marked = views.ranking_items(scores, {p.name: p.config_hash for p in loaded}).where("stale")
    why = F.when(F.col("pattern").isin(*(p.name for p in loaded)), "changed").otherwise("gone")
    return marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("rows"), F.min(why).alias("why"))
