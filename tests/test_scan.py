"""Whole scans: group ids that last, batches that die between any two writes, keyed state against the snapshot."""

import json

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import grouping, want
from lodeframe.plans import pattern
from lodeframe.streaming import changes, scan, state
from lodeframe.streaming.store import Store

LIST = "listing_id long, type string, family string, price long, site_id long, layout string, home string"
STORED = "listing_id long, type string, family string, price long, site_id long, layout string, home string, area double, status string, first_seen string, last_seen string"
ROW = {"type": "t", "family": "CHINTAI", "layout": "1K", "site_id": 1}


def views(rows):
    price = F.col("price")
    return rows.select(
        "listing_id", "site_id", "status", price, price.alias("rent_total"), F.lit("CHINTAI").alias("property_family"), F.lit(1).alias("site_priority"), F.lit(0).alias("feature_count"),
        F.array().cast("array<string>").alias("feature_codes"), F.lit(True).alias("detail_fetched"), F.col("home").alias("dedup_key"), "layout", F.col("area").alias("area_sqm"),
    )


def details(lacking):
    return lacking.select("listing_id", (F.col("listing_id") * 2.0).alias("area"))


PATTERN = pattern.Pattern("p", "CHINTAI", {"rent_total_max": 100}, (), (want.Numeric("rent_total", 1, 0, 100),))
BATCHES = [
    [ROW | {"listing_id": 1, "price": 50, "home": "a"}, ROW | {"listing_id": 2, "price": 40, "home": "b"}, ROW | {"listing_id": 3, "price": 70, "home": None}, ROW | {"listing_id": 9, "price": 1, "home": "a", "layout": "3LDK"}],
    # 4 undercuts 1 in its home, 2 rises, 5 is over the limit, 6 is 1's home on another site but dearer
    [ROW | {"listing_id": 4, "price": 45, "home": "a", "site_id": 2}, ROW | {"listing_id": 2, "price": 60, "home": "b"}, ROW | {"listing_id": 5, "price": 500, "home": "c"}, ROW | {"listing_id": 6, "price": 80, "home": "a", "site_id": 3}],
    # 2 leaves home b, which empties, for a and undercuts it; 3 falls; 7 is new in a home that was told
    [ROW | {"listing_id": 2, "price": 30, "home": "a"}, ROW | {"listing_id": 3, "price": 65, "home": None}, ROW | {"listing_id": 7, "price": 90, "home": "a"}],
]


class Died(Exception):
    pass


class Dying(Store):
    """Dies before its n-th write."""

    left = 10**9

    def _write(self):
        type(self).left -= 1
        if type(self).left < 0:
            raise Died

    def put(self, name, number, rows):
        self._write()
        return super().put(name, number, rows)

    def commit(self, number, touched):
        self._write()
        super().commit(number, touched)


def run(spark, folder, batches, kind=Store, **more):
    plan = scan.Plan(PATTERN, STORED, views, ["price", "site_id", "layout", "home"], [], {"layouts": ["1K"]}, ["area"], details, **more)
    store = scan.opened(spark, str(folder / "store"), plan, buckets=8)
    store = kind(spark, store.path, store.tables, 8)
    (folder / "in").mkdir(exist_ok=True)
    for number, rows in batches:
        (folder / "in" / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(LIST).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        scan.scan(stream, store, plan, str(folder / "check")).awaitTermination()
    return store


def table(store, name, number):
    return sorted((tuple(r) for r in store.read(name, number).collect()), key=str)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    return run(spark, tmp_path_factory.mktemp("whole"), enumerate(BATCHES))


def test_notices_of_three_batches(whole):
    told = {(r["batch"], r["kind"], r["gk"], r["listing_id"], r["price"], r["price_prev"]) for r in whole.read("notices", 2).collect()}
    assert told == {
        (0, "new", "g:a", 1, 50, None), (0, "new", "g:b", 2, 40, None), (0, "new", "l:3", 3, 70, None),
        (1, "cheaper", "g:a", 4, 45, 50),  # the new offers of home a are no news: 1 was told, and is in the group now
        (2, "price_down", "g:a", 2, 30, 60), (2, "cheaper", "g:a", 2, 30, 45), (2, "price_down", "l:3", 3, 65, 70),
    }


def test_groups_keep_their_ids_and_only_touched_buckets_are_written(whole):
    ids = [{r["gk"]: r["group_id"] for r in whole.read("groups", k).collect()} for k in range(3)]
    assert set(ids[0]) == {"g:a", "g:b", "l:3"} and set(ids[2]) == {"g:a", "l:3", "g:c"}  # b is empty and gone
    assert ids[0]["g:a"] == ids[1]["g:a"] == ids[2]["g:a"] and ids[1]["g:c"] == ids[2]["g:c"]
    assert len({*ids[0].values(), *ids[1].values(), *ids[2].values()}) == 4
    for k in range(3):
        again = grouping.group_rows(whole.read("members", k)).collect()
        stored = whole.read("groups", k).drop("group_id").collect()
        assert {tuple(r) for r in again} == {tuple(r) for r in stored}
    before, after = whole.versions(0), whole.versions(1)
    kept = [k for k in before if k[0] == "groups" and after[k] == 0]
    assert kept and any(v == 1 for k, v in after.items() if k[0] == "groups")


def test_details_are_fetched_once_and_the_list_page_decides_first(whole):
    rows = {r["listing_id"]: r for r in whole.read("offers", 2).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7} and all(r["area"] == 2.0 * k for k, r in rows.items())


@pytest.mark.parametrize("dies", [0, 2, 4, 6, 7])
def test_a_batch_that_dies_between_writes_leaves_one_set_of_notices(spark, tmp_path, whole, dies):
    run(spark, tmp_path, [(0, BATCHES[0])])
    Dying.left = dies
    with pytest.raises(Exception, match="Died"):
        run(spark, tmp_path, [(1, BATCHES[1])], Dying)
    store = Dying(spark, str(tmp_path / "store"), whole.tables, 8)
    assert table(store, "notices", 0) == table(whole, "notices", 0)
    Dying.left = 10**9
    store = run(spark, tmp_path, [(1, BATCHES[1])], Dying)
    for name in whole.tables:
        assert table(store, name, 1) == table(whole, name, 1)


def test_only_the_best_ranks_are_told(spark, tmp_path):
    store = run(spark, tmp_path, [(0, BATCHES[0])], most_rank=2)
    assert {(r["gk"], r["rank"]) for r in store.read("notices", 0).collect()} == {("g:b", 1), ("g:a", 2)}


KEYED = "id int, type string, family string, price long, status string, seen timestamp"


def test_keyed_state_tells_what_the_snapshot_tells(spark, tmp_path):
    offer = {"type": "t", "family": "f", "status": "active"}
    files = [
        [offer | {"id": 1, "price": 10, "seen": "2025-01-01T00:00:00"}, offer | {"id": 2, "price": 5, "seen": "2025-01-01T00:00:00"}, offer | {"id": 2, "price": 7, "seen": "2025-01-01T00:00:00"}, offer | {"id": 3, "seen": "2025-01-01T00:00:00"}],
        [offer | {"id": 1, "price": 8, "seen": "2025-01-02T00:00:00"}, offer | {"id": 2, "price": 9, "type": "u", "seen": "2025-01-02T00:00:00"}, offer | {"id": 3, "price": 4, "family": "g", "seen": "2025-01-02T00:00:00"}],
        [offer | {"id": 1, "price": 12, "seen": "2025-01-03T00:00:00"}, offer | {"id": 3, "price": 6, "seen": "2025-01-03T00:00:00"}, offer | {"id": 4, "price": 1, "seen": "2025-01-03T00:00:00"}],
    ]
    (tmp_path / "in").mkdir()
    state.prepare(spark)
    stored = "id int, type string, family string, price long, status string, first_seen string, last_seen string"
    for number, rows in enumerate(files):
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        found = state.change_events(stream, ["id"], "seen")  # a new query each time: restarts from its checkpoint
        found.writeStream.format("parquet").option("path", str(tmp_path / "keyed")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
        plain = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).drop("status", "seen")
        changes.incremental(plain, str(tmp_path / "snap"), str(tmp_path / "events"), str(tmp_path / "c2"), ["id"], ["price"], [], lambda s: s.createDataFrame([], stored)).awaitTermination()
    keyed = sorted((r["id"], r["event"], r["price"]) for r in spark.read.parquet(str(tmp_path / "keyed")).collect())
    snap = sorted((r["id"], r["event"], r["price"]) for r in spark.read.parquet(str(tmp_path / "events")).collect())
    assert keyed == snap and {x[1] for x in keyed} == {"new", "price_up", "price_down"}


def test_ended_offers_return_and_stale_state_is_forgotten(spark, tmp_path):
    offer = {"type": "t", "family": "f", "status": "active"}
    files = [
        [offer | {"id": 1, "price": 10, "seen": "2025-01-01T00:00:00"}, offer | {"id": 2, "price": 5, "seen": "2025-01-01T00:00:00"}],
        [offer | {"id": 1, "price": 10, "status": "sold", "seen": "2025-01-02T00:00:00"}],
        [offer | {"id": 1, "price": 11, "type": "u", "seen": "2025-01-03T00:00:00"}],
        [offer | {"id": 9, "price": 1, "seen": "2025-03-01T00:00:00"}],
        [offer | {"id": 9, "price": 1, "seen": "2025-03-02T00:00:00"}],
        [offer | {"id": 2, "price": 6, "seen": "2025-03-03T00:00:00"}],
    ]
    (tmp_path / "in").mkdir()
    state.prepare(spark)
    for number, rows in enumerate(files):
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        found = state.change_events(stream, ["id"], "seen", keep_days=20)
        found.writeStream.format("parquet").option("path", str(tmp_path / "keyed")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    told = sorted((r["id"], r["event"], r["price"], r["price_prev"]) for r in spark.read.parquet(str(tmp_path / "keyed")).collect())
    # 1 is new again after its end, of another type; 2 is new again because its state was forgotten
    assert told == sorted([(1, "new", 10, None), (2, "new", 5, None), (1, "new", 11, None), (9, "new", 1, None), (2, "new", 6, None)])
