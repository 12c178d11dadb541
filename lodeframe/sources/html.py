"""Tables and links of stored pages, by native expressions or one parser per batch."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(html: Column) -> Column:
    """Text of a fragment: tags out, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


#: Characters before a link in which its check box may stand.
BESIDE = 400


def city_links(pages: DataFrame, key: str, html: str, slug: str, code: str = "[0-9]{5}") -> DataFrame:
    """key, slug, code, label: the cities that the links of an index page lead to, each once.

    slug: a pattern for link targets whose first group is the city's slug; others are no cities. The code stands
    in the link's tag, else in the last check box before it; the last code and the last label that aren't
    empty count, since pages name a city several times.
    """
    # what stands before an end of a link, whose beginning is the last one in it: linear in the page
    pieces = F.split(F.regexp_replace(html, r"<a\s+", "<a "), "</a>")
    pieces = F.filter(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p.contains("<a "))
    rows = pages.select(key, F.posexplode(pieces).alias("_n", "_p"))
    link = F.substring_index("_p", "<a ", -1)
    tag, inside = F.substring_index(link, ">", 1), F.substring(link, F.instr(link, ">") + 1, F.length(link))
    before = F.right(F.left("_p", F.length("_p") - F.length(link) - 3), F.lit(BESIDE))
    named = F.nullif(F.regexp_extract(tag, f'(?:data-|value=|code=|id=)[^>]*?({code})', 1), F.lit(""))
    box = F.nullif(F.regexp_extract(before, f'(?s)^.*<input[^>]*value="({code})"', 1), F.lit(""))
    target = F.regexp_extract(F.regexp_extract(tag, 'href="([^"]*)"', 1), slug, 1)
    made = rows.select(key, "_n", F.nullif(target, F.lit("")).alias("slug"), F.coalesce(named, box).alias("_code"), F.nullif(stripped(inside), F.lit("")).alias("_label"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_n", c)))[c]
    return made.where("slug is not null").groupBy(key, "slug").agg(last("_code").alias("code"), F.coalesce(last("_label"), F.lit("")).alias("label"))


class _Tables(HTMLParser):
    """Rows of cell texts for every table."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def table_rows(pages: DataFrame, key: str, html: str, header: tuple[str, ...]) -> DataFrame:
    """key, row, cells: rows of the first table of each page that has all header words; pages without one give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html], strict=True):
                parser = _Tables()
                parser.feed(page or "")
                for table in parser.tables:
                    if all(any(word in c for r in table for c in r) for word in header):
                        out += [(k, n, cells) for n, cells in enumerate(table)]
                        break
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, row int, cells array<string>")


def rates(rows: DataFrame, key: str) -> DataFrame:
    """Layout and yen of rate-table rows; two different amounts of one layout are an error."""
    from lodeframe.functions.text import layout, yen

    cells = F.transform("cells", lambda c: F.regexp_replace(c, r"\s+", ""))
    amount = F.get(F.filter(cells, lambda c: c.rlike(r"^[0-9]+(\.[0-9]+)?万円$")), F.lit(0))
    made = rows.select(key, layout(F.get(cells, F.lit(0))).alias("layout"), yen(amount).alias("rent_yen")).where("layout is not null and rent_yen is not null")
    folded = made.groupBy(key, "layout").agg(F.min("rent_yen").alias("rent_yen"), F.max("rent_yen").alias("_most"))
    return folded.select(key, "layout", F.when(F.col("rent_yen") != F.col("_most"), F.raise_error(F.lit("two rates of one layout"))).otherwise(F.col("rent_yen")).alias("rent_yen"))
