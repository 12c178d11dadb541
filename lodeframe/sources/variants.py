"""JSON without a schema: documents embedded in pages or stored as text, read as VARIANT values.

Missing fields and fields of another type are null, whatever else a document holds; a text that is no JSON
gives a null document, which can be counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def embedded(html: Column, element: str) -> Column:
    """The JSON text of the script element of an id, null without one."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{element}"[^>]*>(.*?)</script>', 1), F.lit(""))


def document(text: Column) -> Column:
    """A VARIANT, null for what is no JSON."""
    return F.try_parse_json(text)


@dataclass(frozen=True)
class Field:
    """A column of a level: its path in the level's value and its type."""

    name: str
    path: str
    type: str = "string"


def fields(value: Column, wanted: list[Field]) -> list[Column]:
    return [F.try_variant_get(value, f.path, f.type).alias(f.name) for f in wanted]


def exploded(rows: DataFrame, value: Column, path: str, place: str, name: str) -> DataFrame:
    """rows with each element of the array at a path: its place from 0 and its value; rows without the array or with an empty one go."""
    return rows.select("*", F.posexplode(F.try_variant_get(value, path, "array<variant>")).alias(place, name))


def two_levels(rows: DataFrame, text: Column, outer: str, inner: str, outer_fields: list[Field], inner_fields: list[Field]) -> tuple[DataFrame, Observation]:
    """(rows of the inner level with the columns of their outer one, what was seen): buildings and their homes, for example.

    outer, inner: paths of the arrays. Outer elements without inner ones give no row. The observation
    (documents, malformed, without_outer) has its values after the first action; null texts aren't documents. The
    action must read the rows once, as a write or collect does: a global sort samples them first, and counts twice.
    """
    seen = Observation()
    read = rows.withColumn("_doc", document(text)).withColumn("_text", text.isNotNull())
    array = F.try_variant_get("_doc", outer, "array<variant>")
    read = read.observe(seen, F.count_if("_text").alias("documents"), F.count_if(F.col("_text") & F.col("_doc").isNull()).alias("malformed"), F.count_if(F.col("_doc").isNotNull() & array.isNull()).alias("without_outer"))
    one = exploded(read, F.col("_doc"), outer, "outer_place", "_outer")
    two = exploded(one, F.col("_outer"), inner, "inner_place", "_inner")
    return two.select(*rows.columns, "outer_place", "inner_place", *fields(F.col("_outer"), outer_fields), *fields(F.col("_inner"), inner_fields)), seen
