"""Balanced label propagation: documents of equal text gather in shards, counts stay even.

Links join documents of equal text; a document's label is its shard. Every round each clump (the
members of a group in one shard) asks for the shard that holds the group's largest clump. How many may
move from one shard to another is a table of shards x shards: what is asked, lowered until no shard
takes in more than its unlinked documents make room for and its leaving clumps set free. Clumps are let
in in the order of their hashes up to that quota, the last one in part. Every move makes the
sum of squared clumps larger, and with it the number of linked pairs that meet; rounds go on until no
move is left, first to any shard, then to shards that have room. Unlinked documents take the places
that remain and leave shards in exchange. Groups that are in parts when no move is left are lifted out together
and let in again whole. Groups of more than a LARGE-th of a shard go first, and the others are dealt
anew to what they leave. Only native DataFrame operations run; groups are never
gathered, only counted per shard, and the driver sees the table of shards x shards.

The law is `rows`: counts differ by one at most. `cut_links` counts the documents of the same text in
other shards. Defined cases: a null text counts 16 bytes, has the checksum of the empty text and no
links; empty texts are equal texts; very long texts are read once, for size and checksums; rows with a
repeated or null doc_id are placed like any other row; groups larger than a shard end in as many shards
as they need; ties between clumps are broken by hash; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.tables import numbered, written

SHARDS = 40
#: Groups of more than a LARGE-th of a shard are joined by broadcast: at most LARGE * SHARDS of them.
LARGE = 8
#: Rows that one task numbers.
NUMBERED = 4000
IDENTITY = ("doc_id", "text_crc32", "size")


def exchange(net: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(giver, first, end, taker): which numbered unlinked documents of a giver go to which taker."""
    takers = [[s, -n] for s, n in sorted(net.items()) if n < 0]
    flows = []
    for giver, n in sorted(net.items()):
        at = 0
        while at < n:
            taker = takers[-1]
            take = min(n - at, taker[1])
            flows.append((giver, at, at + take, taker[0]))
            at += take
            taker[1] -= take
            if not taker[1]:
                takers.pop()
    return flows


def quotas(asked: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many may move from one shard to another, so that none takes in more than it has free and gives away.

    What is asked is followed from shard to shard until it meets a free place or itself: the moves on such a
    path or circle are granted together. Shards that neither have room nor give take nothing.
    """
    left: dict[int, dict[int, int]] = {}
    for (giver, taker), n in sorted(asked.items()):
        if n > 0:
            left.setdefault(giver, {})[taker] = n
    room, granted = dict(free), dict.fromkeys(asked, 0)

    def push(path: list[int], most: int) -> None:
        steps = list(zip(path, path[1:], strict=False))
        n = min(most, *(left[u][v] for u, v in steps))
        for u, v in steps:
            granted[u, v] += n
            left[u][v] -= n
            if not left[u][v]:
                del left[u][v]

        room[path[0]] += n
        room[path[-1]] -= n

    while any(left.values()):
        path = [next(s for s, takers in left.items() if takers)]
        while path:
            at = path[-1]
            if len(path) > 1 and room[at] > 0:
                push(path, room[at])
                break
            if not left.get(at):
                if room[at] <= 0:
                    for takers in left.values():
                        takers.pop(at, None)
                path.pop()
                continue
            to = max(left[at], key=lambda v: (left[at][v], -v))
            if to in path:
                push([*path[path.index(to) :], to], 1 << 60)
                break
            path.append(to)
    return granted


def _buckets(rows: int) -> int:
    return max(4, -(-rows // NUMBERED))


def _literal(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _order(shard: str) -> Column:
    """Clumps of a group by size, equal ones by hash."""
    return F.struct("n", F.xxhash64("link", shard).alias("h"), F.col(shard).alias("shard"))


def _asks(clumps: DataFrame, open_: set[int], size: int) -> DataFrame:
    """link, shard, goal, n of clumps that would rather be in a larger clump's shard, if that is open.

    A group that needs several shards of `size` has as many goals, its largest clumps; a hash tells which.
    """
    group = Window.partitionBy("link")  # at most one row a shard
    open_clumps = F.sort_array(F.collect_list(F.when(F.col("shard").isin(*open_), _order("shard"))).over(group), asc=False)
    needs = F.least(F.ceil(F.sum("n").over(group) / F.lit(size)).cast("int"), F.size("_open"))
    rows = clumps.withColumn("_open", open_clumps).withColumn("_needs", needs).where("_needs > 0")
    goal = F.get("_open", F.pmod(F.xxhash64("link", "shard", F.lit(3)), F.col("_needs")).cast("int"))
    rows = rows.withColumn("_goal", goal).where(_order("shard") < F.col("_goal"))
    return rows.select("link", "shard", F.col("_goal.shard").alias("goal"), "n")


def _let_in(asks: DataFrame, granted: dict[tuple[int, int], int], buckets: int) -> DataFrame:
    """link, shard, goal, n: running sums over the clumps of each pair of shards, bucket after bucket, up to its quota."""
    pair = F.col("shard") * (1 << 16) + F.col("goal")
    quota = _literal({giver * (1 << 16) + taker: n for (giver, taker), n in granted.items()})
    marked = asks.withColumn("_pair", pair).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(7), "link"), F.lit(buckets)))
    sizes = marked.groupBy("_pair", "_bucket").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("_pair").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_pair", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy("_pair", "_bucket").orderBy("link").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("_shift")
    left = F.element_at(quota, F.col("_pair")) - start
    taken = marked.join(shifts, ["_pair", "_bucket"]).withColumn("n", F.least("n", left)).where("n > 0")
    return taken.select("link", "shard", "goal", "n")


def gathered(clumps: DataFrame, places: dict[int, int]) -> tuple[DataFrame, int]:
    """clumps (link, shard, n) of linked documents -> the same after all rounds, and how many rounds moved something."""
    linked = {r["shard"]: r["n"] for r in clumps.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    free = {s: n - linked.get(s, 0) for s, n in places.items()}
    turns, everywhere = 0, True
    while True:
        open_ = set(places) if everywhere else {s for s, n in free.items() if n > 0}
        if not open_:
            return clumps, turns
        asks = written(_asks(clumps, open_, max(1, max(places.values()))))
        asked = {(r["shard"], r["goal"]): r["n"] for r in asks.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}  # shards x shards
        granted = quotas(asked, free)
        if not any(granted.values()):
            if not everywhere:
                return clumps, turns
            everywhere = False
            continue
        moves = written(_let_in(asks, granted, _buckets(sum(asked.values()) // len(asked))))
        changes = moves.select("link", "shard", (-F.col("n")).alias("n")).unionByName(moves.select("link", F.col("goal").alias("shard"), "n"))
        clumps = written(clumps.unionByName(changes).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        for r in moves.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect():
            free[r["shard"]] += r["n"]
            free[r["goal"]] -= r["n"]
        turns, everywhere = turns + 1, True


def _running(rows: DataFrame, by: str, size: str, buckets: int) -> DataFrame:
    """rows with `_end`: running sums of `size` in the order of hashes within each value of `by`, bucket after bucket."""
    marked = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(11), "link"), F.lit(buckets)))
    sizes = marked.groupBy(by, "_bucket").agg(F.sum(size).alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(by, "_bucket").orderBy("link").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.join(shifts, [by, "_bucket"]).withColumn("_end", F.sum(size).over(inner) + F.col("_shift")).drop("_bucket", "_shift")


def regathered(clumps: DataFrame, places: dict[int, int]) -> DataFrame:
    """Groups that are still in parts are lifted out and ask as a whole for a shard that has room for all of them.

    Where no path of moves is left, places are held by each other's parts; lifting them frees all of these. A group
    asks for the shard that held most of it, later for one drawn by hash; what no shard can take whole is split over
    the places that are left.
    """
    known = clumps.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy("link")))
    known = written(known)
    split = known.where("_parts > 1").drop("_parts")
    if split.isEmpty():
        return clumps
    settled = [known.where("_parts = 1").drop("_parts")]
    taken = {r["shard"]: r["n"] for r in settled[0].groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    room = {s: n - taken.get(s, 0) for s, n in places.items()}
    held = F.map_from_entries(F.collect_list(F.struct("shard", "n")))
    left, turn = written(split.groupBy("link").agg(F.sum("n").alias("members"), held.alias("held"))), 0
    count = left.count()
    while True:
        had = lambda s: F.coalesce(F.try_element_at("held", F.lit(s)), F.lit(0)) if not turn else F.lit(0).cast("long")  # noqa: E731, B023
        options = [F.when(F.col("members") <= n, F.struct(had(s).alias("n"), F.xxhash64("link", F.lit(s), F.lit(turn)).alias("h"), F.lit(s).alias("shard"))) for s, n in room.items() if n > 0]
        if not options:
            break
        asks = left.withColumn("goal", F.array_max(F.array_compact(F.array(*options)))["shard"])
        round_ = written(_running(asks.where("goal is not null"), "goal", "members", _buckets(count // len(places))).withColumn("goes", F.col("_end") <= F.element_at(_literal(room), F.col("goal"))))
        goes = round_.where("goes").select("link", F.col("goal").alias("shard"), F.col("members").alias("n"))
        moved = goes.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
        if not moved:
            break
        for r in moved:
            room[r["shard"]] -= r["n"]
            count -= r["k"]
        settled.append(goes)
        left = written(left.join(goes.select("link"), "link", "left_anti"))
        turn += 1
    ends = 0
    spans = []
    for s, n in room.items():
        if n > 0:
            spans.append(F.struct(F.lit(ends).cast("long").alias("low"), F.lit(ends + n).cast("long").alias("high"), F.lit(s).alias("shard")))
            ends += n
    if count and spans:
        rows = _running(left.withColumn("all", F.lit(0)), "all", "members", _buckets(count)).withColumn("_low", F.col("_end") - F.col("members"))
        overlap = F.least(F.col("_end"), F.col("x.high")) - F.greatest(F.col("_low"), F.col("x.low"))
        settled.append(rows.withColumn("x", F.explode(F.array(*spans))).select("link", "x.shard", overlap.alias("n")).where("n > 0"))
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    return written(whole)


def cut_links(clumps: DataFrame) -> DataFrame:
    """One row: pairs of documents of equal text, and how many of them are in two shards."""
    groups = clumps.groupBy("link").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("met"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).cast("long")
    return groups.agg(total(pairs).alias("pairs"), total(pairs - F.col("met")).alias("cut"))


def clumps_of(state: DataFrame) -> DataFrame:
    """link, shard, n of the groups with more than one member."""
    per = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("_m", F.sum("n").over(Window.partitionBy("link"))).where("_m > 1").drop("_m")


def _dealt(places: dict[int, int], number: Column) -> Column:
    """The shard of a document's number, shard after shard up to its places: numbers follow hashes, so texts are spread."""
    ends, shards, end = [], [], 0
    for shard, n in places.items():
        end += n
        ends.append(end)
        shards.append(shard)
    passed = F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x <= number))
    return F.get(F.array(*map(F.lit, shards)), passed)


def propagate(state: DataFrame, shards: int, total: int) -> DataFrame:
    """state: identity columns, place, link (of unlinked documents their own) and shard, with even counts -> identity columns, shard, cut_links."""
    spread = _buckets(total // shards)
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    large = F.col("members") * LARGE > total // shards
    clumps = written(clumps_of(state))
    groups = clumps.groupBy("link").agg(F.sum("n").alias("members")).where(large).select("link")  # at most LARGE * SHARDS
    big, _ = gathered(written(clumps.join(F.broadcast(groups), "link", "left_semi")), room)
    taken = {r["shard"]: r["n"] for r in big.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    if taken:
        # the largest groups come first; all others are dealt anew to what they leave
        left = {s: n - taken.get(s, 0) for s, n in room.items()}
        others = numbered(state.join(F.broadcast(groups), "link", "left_anti").withColumn("all", F.lit(0)), ["all"], [F.col("place")], "_at", spread * shards)
        others = others.withColumn("shard", _dealt(left, F.col("_at"))).select(*state.columns)
        state = written(others.unionByName(state.join(F.broadcast(groups), "link", "left_semi").select(*state.columns)))
        clumps, _ = gathered(written(clumps_of(others)), left)
        clumps = regathered(clumps, left).unionByName(big)
    else:
        clumps, _ = gathered(clumps, room)
        clumps = regathered(clumps, room)
    # where the members of a group go, by their number within it
    before = F.sum("n").over(Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = clumps.withColumn("high", before).groupBy("link").agg(F.sum("n").alias("members"), F.array_sort(F.collect_list(F.struct("high", "n", "shard"))).alias("spans"))
    spans = written(spans)
    columns = [*IDENTITY, "place", "link", "shard"]
    hot = state.join(F.broadcast(spans.where(large)), "link", "left")
    cool = hot.where("members is null").select(*columns).join(spans.where(~large), "link", "left")
    rows = written(hot.where("members is not null").select(*columns, "members", "spans").unionByName(cool.select(*columns, "members", "spans")))
    whole = rows.where("size(spans) = 1").select(*IDENTITY, F.col("spans")[0]["shard"].alias("shard"), F.lit(0).cast("long").alias("cut_links"))
    parted = numbered(rows.where("size(spans) > 1"), ["link"], [F.col("place")], "at", spread)
    span = F.get(F.filter("spans", lambda x: x["high"] > F.col("at")), F.lit(0))
    moved = whole.unionByName(parted.select(*IDENTITY, span["shard"].alias("shard"), (F.col("members") - span["n"]).cast("long").alias("cut_links")))
    rest = rows.where("spans is null").select(*columns)
    held = {r["shard"]: r["n"] for r in clumps.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    singles = {r["shard"]: r["n"] for r in rest.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    flows = exchange({s: singles.get(s, 0) + held.get(s, 0) - room[s] for s in range(shards)})
    lone = numbered(rest, ["shard"], [F.col("place")], "at", spread)
    to = F.lit(None).cast("int")
    for giver in {f[0] for f in flows}:
        steps = F.lit(None).cast("int")
        for _, low, high, taker in (f for f in flows if f[0] == giver):
            steps = F.when((F.col("at") >= low) & (F.col("at") < high), F.lit(taker)).otherwise(steps)
        to = F.when(F.col("shard") == giver, steps).otherwise(to)
    lone = lone.select(*IDENTITY, F.coalesce(to, F.col("shard")).alias("shard"), F.lit(0).cast("long").alias("cut_links"))
    return written(moved.unionByName(lone))


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """documents (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, cut_links."""
    text = F.col("text").cast("string")
    rows = written(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("link"),
        )
    )
    total = rows.count()
    dealt = numbered(rows.withColumn("all", F.lit(0)), ["all"], [F.col(x) for x in IDENTITY], "place", _buckets(total))
    own = F.coalesce("link", F.concat(F.lit("-"), F.col("place").cast("string")))
    state = written(dealt.select(*IDENTITY, "place", own.alias("link"), (F.col("place") % shards).cast("int").alias("shard")))
    state = propagate(state, shards, total)
    return numbered(state, ["shard"], [F.col(x) for x in IDENTITY], "slot", _buckets(total // shards)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cut_links"
    )
