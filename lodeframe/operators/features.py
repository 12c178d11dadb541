"""Features from free text by a dictionary with negation, derived features, unknown tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import text


@dataclass(frozen=True)
class Entry:
    """A code with its patterns in order; any negative pattern in the text rules the code out."""

    code: str
    patterns: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    families: tuple[str, ...] = ()


def matched(entry: Entry, content: Column) -> Column:
    """The first pattern in the text, null without one or with a negative one."""
    hit = F.lit(None).cast("string")
    for pattern in reversed(entry.patterns):
        hit = F.when(content.contains(pattern), F.lit(pattern)).otherwise(hit)
    for negative in entry.negatives:
        hit = F.when(content.contains(negative), None).otherwise(hit)
    return hit


def extracted(rows: DataFrame, dictionary: list[Entry], content: str, family: str | None = None) -> DataFrame:
    """rows and `features`: array of struct(code, matched) sorted by code. The dictionary is a set of literals in one projection."""
    made = []
    for entry in sorted(dictionary, key=lambda e: e.code):
        hit = matched(entry, F.col(content))
        if family and entry.families:
            hit = F.when(F.col(family).isin(*entry.families), hit)
        made.append(F.struct(F.lit(entry.code).alias("code"), hit.alias("matched")))
    return rows.withColumn("features", F.filter(F.array(*made), lambda x: x["matched"].isNotNull()))


def unknown_tokens(rows: DataFrame, dictionary: list[Entry], content: str, keys: list[str]) -> DataFrame:
    """Recordable tokens that share no substring relation with a known pattern: keys, token, n."""
    known = F.array(*(F.lit(p) for p in sorted({p for e in dictionary for p in (*e.patterns, *e.negatives)})))
    listed = rows.select(*keys, F.explode(text.tokens(F.col(content))).alias("token")).where(text.recordable(F.col("token")))
    # counted first: the dictionary is compared with distinct tokens only
    counts = listed.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(~F.exists(known, lambda p: F.col("token").contains(p) | F.contains(p, F.col("token"))))


def derived(floor: Column, total: Column, age: Column, new_age: int = 3) -> Column:
    """Sorted codes from typed columns."""
    return F.array_compact(
        F.array(
            F.when(age <= new_age, "FEAT_NEW"),
            F.when(floor == 1, "LOC_FLOOR_1"),
            F.when(floor >= 2, "LOC_FLOOR_2UP"),
            F.when((total > 1) & (floor == total), "LOC_TOP_FLOOR"),
        )
    )
