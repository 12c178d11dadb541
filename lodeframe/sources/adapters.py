"""Stored pages as typed rows, by adapters that are declared for each site and type.

An adapter says where the entries of a list page begin and end, and by which pattern or JSON path each
field is found. All adapters become one expression over one scan of the pages, batch or stream: no page
is read once per adapter, and no Python runs. A page that lacks what its adapter needs is a counted row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.sources import variants
from lodeframe.sources.html import stripped


@dataclass(frozen=True)
class Found:
    """A field: the first group of a pattern in an entry, or a path of its JSON; tags are taken out and spaces squeezed."""

    name: str
    pattern: str | None = None
    path: str | None = None
    type: str = "string"
    needed: bool = False

    def column(self, entry: Column) -> Column:
        if self.path:
            return F.try_variant_get(variants.document(entry), self.path, self.type).cast("string")
        text = F.nullif(stripped(F.regexp_extract(entry, f"(?s){self.pattern}", 1)), F.lit(""))
        return text.try_cast(self.type).cast("string")


@dataclass(frozen=True)
class Adapter:
    """entries: a pattern whose first group is one entry of a list page, or (script, path) of an array in embedded JSON; detail pages are one entry."""

    site: str
    kind: str
    entries: str | tuple[str, str]
    listed: tuple[Found, ...]
    detailed: tuple[Found, ...] = ()

    def split(self, html: Column) -> Column:
        """The entries of a list page as texts, null for a page without the array."""
        if isinstance(self.entries, tuple):
            script, path = self.entries
            array = F.try_variant_get(variants.document(variants.embedded(html, script)), path, "array<variant>")
            return F.transform(array, lambda v: F.to_json(v))
        found = F.regexp_extract_all(html, F.lit(f"(?s){self.entries}"), 1)
        return F.when(F.size(found) > 0, found)


class Registry:
    """Adapters by (site, kind); a second one of a pair is an error."""

    def __init__(self, *adapters: Adapter):
        self.adapters = {(a.site, a.kind): a for a in adapters}
        if len(self.adapters) != len(adapters):
            raise ValueError("two adapters of one site and kind")

    def _chosen(self, value, otherwise: Column) -> Column:
        """One expression for all adapters: the branch of the row's site and kind."""
        found = otherwise
        for (site, kind), adapter in self.adapters.items():
            found = F.when((F.col("site") == site) & (F.col("kind") == kind), value(adapter)).otherwise(found)
        return found

    def _read(self, rows: DataFrame, which: str, names: list[str]) -> DataFrame:
        """rows (.., entry) with one column a name, and `error`: what is missing."""

        def values(adapter: Adapter) -> Column:
            fields = {f.name: f for f in getattr(adapter, which)}
            lost = F.array_compact(F.array(*(F.when(f.column(F.col("entry")).isNull(), F.lit(f.name)) for f in fields.values() if f.needed)))
            got = [(fields[n].column(F.col("entry")) if n in fields else F.lit(None).cast("string")).alias(n) for n in names]
            return F.struct(*got, F.when(F.size(lost) > 0, F.concat(F.lit("missing "), F.array_join(lost, ", "))).alias("error"))

        nothing = F.struct(*(F.lit(None).cast("string").alias(n) for n in names), F.lit("no adapter").alias("error"))
        made = rows.withColumn("_v", self._chosen(values, nothing))
        broken = F.when(F.col("entry").isNull() & (F.col("_v.error") != "no adapter"), "no entries").otherwise(F.col("_v.error"))
        return made.select(*(c for c in rows.columns if c != "entry"), *(F.col("_v")[n].alias(n) for n in names), broken.alias("error"))

    def listed(self, pages: DataFrame, names: list[str]) -> DataFrame:
        """pages (site, kind, url, html) -> site, kind, url, place, the named fields as text, error. A page that can't be split is one row with an error."""
        split = self._chosen(lambda a: a.split(F.col("html")), F.lit(None).cast("array<string>"))
        return self._read(pages.select("site", "kind", "url", F.posexplode_outer(split).alias("place", "entry")), "listed", names)

    def detailed(self, pages: DataFrame, names: list[str]) -> DataFrame:
        """pages (site, kind, url, html) -> site, kind, url, the named fields as text, error."""
        return self._read(pages.select("site", "kind", "url", F.col("html").alias("entry")), "detailed", names)


def counted(rows: DataFrame) -> DataFrame:
    """site, kind, rows, bad: how many rows an adapter gave and how many of them lack something."""
    return rows.groupBy("site", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count("error").alias("bad"))
