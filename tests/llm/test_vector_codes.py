"""Codes against Lloyd's algorithm in plain integers; members move only when their entry changes."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, rounds=6, parts=8, entries=16):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    firsts = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2]):
        firsts.setdefault(i, v)
    firsts = list(firsts.values())[:entries]
    width = len(kept[0][1]) // parts
    code, error, spelt = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        cut = lambda v, p=p: v[p * width : (p + 1) * width]
        book = [cut(v) for v in firsts]
        for turn in range(rounds + 1):
            gaps = [[sum((a - b) ** 2 for a, b in zip(cut(v), e, strict=True)) for e in book] for _, v, _ in kept]
            best = [g.index(min(g)) for g in gaps]
            if turn < rounds:
                for k in range(len(book)):
                    mine = [cut(v) for (_, v, _), b in zip(kept, best, strict=True) if b == k]
                    if mine:
                        book[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        code = [c + f"{b:02x}" for c, b in zip(code, best, strict=True)]
        error = [e + min(g) for e, g in zip(error, gaps, strict=True)]
        spelt += [str(x) for e in book for x in e]
    sha = hashlib.sha256(",".join(spelt).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + e
    return [(i, c, e, total[label], sha) for (i, _, label), c, e in zip(kept, code, error, strict=True)]


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("entry", F.lit("clash")).withColumn("row", F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in codes.vector_codes(frame, **more).collect()), key=str)


def vectors(n, dim=16, seed=1):
    draw = random.Random(seed)
    return [(i, [float(np.float32(draw.gauss(0, 0.3))) for _ in range(dim)], draw.choice([None, 1, 2])) for i in draw.sample(range(1000), n)]


@pytest.mark.parametrize("owner", [3, 4096])
def test_equals_lloyd_in_integers(spark, owner):
    rows = vectors(60)
    rows += [(2000 + k, rows[0][1], 1) for k in range(25)]  # copies of one vector
    assert run(spark, rows, owner=owner) == sorted(expected(rows), key=str)


def test_odd_rows(spark):
    rows = vectors(20)
    good = rows + [rows[3], (None, rows[4][1], None), (rows[5][0], rows[6][1], 1)]
    odd = [(3001, None, 1), (3002, [], 1), (3003, [math.nan] * 16, 1), (3004, [math.inf] + [0.0] * 15, 2), (3005, [None] + [0.0] * 15, 2), (3006, [0.5] * 8, 1), (3007, [0.5] * 15, 1), (3008, [1e9] * 16, 1)]
    assert run(spark, good + odd) == sorted(expected(good), key=str)


def test_fewer_than_the_entries_and_none(spark):
    rows = vectors(3)
    assert run(spark, rows) == sorted(expected(rows), key=str)
    assert run(spark, [(1, None, 1)]) == []
    assert run(spark, []) == []


def test_only_parts_that_change_are_written(spark, monkeypatch):
    logs = []
    monkeypatch.setattr(codes.Log, "close", lambda self: logs.append(self))
    rows = vectors(80, seed=4)
    run(spark, rows)
    log = spark.table(logs[0].name)
    by_round = {r["round"]: (r["n"], r["came"]) for r in log.groupBy("round").agg(F.count("*").alias("n"), F.count("part").alias("came")).collect()}
    assert by_round[0] == (80 * 8, 80 * 8)
    later = [by_round.get(k, (0, 0)) for k in range(1, 7)]
    assert all(n == 2 * came for n, came in later)  # one departure for each arrival
    assert 0 < later[0][1] < 80 * 8 and later[-1][1] < later[0][1]
    plan = logs[0].owners().applyInArrow(codes._summed, "position int, entry int, members long, total array<long>")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_codes_decode_to_entries(spark):
    rows = vectors(40, seed=9)
    coded, books = codes.fitted_codes(spark.createDataFrame(rows, SCHEMA))
    whole = {i: v for i, v, _ in rows}
    for r in codes.decoded(coded, books).collect():
        gap = sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(whole[r["vec_id"]], r["vector"], strict=True))
        assert gap == r["error"]
