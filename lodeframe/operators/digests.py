"""Bodies of digests: lines in their order, as many as fit a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a message, of its heading, of a title; words.
MESSAGE, HEADING, TITLE = 4096, 250, 34
CUT_NOTE = "…（以降は文字数上限のため省略）"
NOTHING = "条件に合う物件がありませんでした。"
UNTITLED, NOWHERE = "（物件名なし）", "住所不明"


def heading(pattern: Column, count: Column, group: Column) -> Column:
    """The digest's first words, with the group's name where there is one."""
    label = F.coalesce(F.concat(F.lit("["), F.nullif(group, F.lit("")), F.lit("] ")), F.lit(""))
    return F.concat(F.lit("📊 "), label, F.lit("**"), pattern, F.lit("** の上位 "), count.cast("string"), F.lit(" 件"))


def line(price: Column, market: Column, summary: Column) -> Column:
    """An entry's three lines from rank, title, url, score, address, site, other_sites (how many), unknown_items."""
    title = F.left(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(UNTITLED)), F.lit(TITLE))
    sites = F.when(F.col("other_sites") > 0, F.concat("site", F.lit(" ほか"), F.col("other_sites").cast("string"), F.lit("サイト"))).otherwise(F.col("site"))
    unknown = F.when(F.col("unknown_items") > 0, F.concat(F.lit(" ⚠︎未確認"), F.col("unknown_items").cast("string"))).otherwise("")
    return F.concat(
        F.lit("**"), F.col("rank").cast("string"), F.lit(". ["), title, F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")**\n　`"), F.format_string("%5.1f", "score"), F.lit("点` "), price, F.lit(" "), market, F.lit(" / "), summary,
        F.lit("\n　"), F.coalesce(F.nullif(F.col("address"), F.lit("")), F.lit(NOWHERE)), F.lit(" ("), sites, F.lit(")"), unknown,
    )


def fitted(lines: Column, used: Column, most: int = MESSAGE, note: str = CUT_NOTE) -> Column:
    """(body, shown, left_out) of lines in order: a line that would pass the limit ends the body with a note.

    Characters are code points; a line counts two more, for the blank line after it; `used` is spent before
    the first. Later lines are left out even where they would fit.
    """
    room = F.lit(most - len(note))

    def add(state: Column, text: Column) -> Column:
        fits = ~state["full"] & (state["used"] + F.length(text) + 2 <= room)
        return F.struct(
            F.when(fits, state["used"] + F.length(text) + 2).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["body"], text)).otherwise(state["body"]).alias("body"), (~fits).alias("full")
        )

    start = F.struct(used.cast("int").alias("used"), F.array().cast("array<string>").alias("body"), F.lit(False).alias("full"))
    state = F.aggregate(F.coalesce(lines, F.array().cast("array<string>")), start, add)
    shown = F.when(state["full"], F.array_append(state["body"], F.lit(note))).otherwise(state["body"])
    body = F.when(F.size(shown) == 0, F.lit(NOTHING)).otherwise(F.array_join(shown, "\n\n"))
    return F.struct(body.alias("body"), F.size(state["body"]).alias("shown"), (F.size(F.coalesce(lines, F.array().cast("array<string>"))) - F.size(state["body"])).alias("left_out"))


def digests(entries: DataFrame, patterns: DataFrame, top: int, most: int = MESSAGE) -> DataFrame:
    """entries (pattern, rank, line), patterns (pattern, digest_group) -> pattern, title, body, shown, left_out: one message a pattern, without entries too.

    Only the first `top` ranks of a pattern are gathered.
    """
    kept = entries.where(F.col("rank") <= top).groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("rank", "line")))["line"].alias("_lines"))
    rows = patterns.select("pattern", "digest_group").join(kept, "pattern", "left")
    head = heading(F.col("pattern"), F.coalesce(F.array_size("_lines"), F.lit(0)), F.col("digest_group"))
    made = rows.withColumn("_head", head).withColumn("_m", fitted(F.col("_lines"), F.length("_head") + 2, most))
    return made.select("pattern", F.left("_head", F.lit(HEADING)).alias("title"), "_m.body", "_m.shown", "_m.left_out")
