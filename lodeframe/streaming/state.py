"""Change events with the stored offer as keyed state: no snapshot table, one state per offer, forgotten when stale."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodeframe.operators.snapshot import ENDED

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "type string, family string, price long, status string"
EVENTS = "event string, price long, price_prev long"


def prepare(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _order(row: Any, rest: list[str]) -> tuple:
    """Rows of a key within a batch in the order of all their columns, null first."""
    return tuple((row[c] is not None, row[c] if row[c] is not None else 0) for c in rest)


class Offers(StatefulProcessor):
    """One offer: what was last stored of it, and a timer that forgets it `keep` after it was last seen."""

    def __init__(self, key: list[str], columns: list[str], time: str, keep_ms: int):
        self.key, self.rest, self.time, self.keep_ms = key, [c for c in columns if c not in key], time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offer = handle.getValueState("offer", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        row = max(rows, key=lambda r: _order(r, self.rest))
        old = self.offer.get() if self.offer.exists() else None
        kind, family, price, status = old if old else (None, None, None, None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(row[self.time].timestamp() * 1000) + self.keep_ms)
        if row["status"] in ENDED:  # told from elsewhere that the offer is gone
            if old:
                self.offer.update((kind, family, price, row["status"]))
            return
        ended = status in ENDED
        if old and (family != row["family"] or (kind != row["type"] and not ended)):
            return  # another family or, of an active offer, another type: the stored one stands
        self.offer.update((row["type"], row["family"], row["price"], "active"))
        before = price if old and kind == row["type"] else None
        event = None
        if not old or ended:
            event = "new"
        elif price is not None and row["price"] is not None and price != row["price"]:
            event = "price_up" if row["price"] > price else "price_down"
        if event:
            yield Row(**dict(zip(self.key, key, strict=True)), event=event, price=row["price"], price_prev=before)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.offer.clear()
        return iter(())

    def close(self) -> None:
        pass


def change_events(offers: DataFrame, key: list[str], time: str, delay: str = "1 hour", keep_days: float = 90) -> DataFrame:
    """offers (key, type, family, price, status, time) as a stream -> key, event, price, price_prev.

    Events are those of snapshot.upserted: new (also of an ended offer that returns), price_up, price_down. A
    row with an ended status marks its offer and tells nothing. A key that comes several times in a batch
    counts once, by its last row in the order of all columns. An offer not seen for `keep_days` after its
    last row is forgotten once the watermark passes, and is new again when it returns. Needs prepare().
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in offers.select(*key).schema)
    processor = Offers(key, offers.columns, time, int(keep_days * 86_400_000))
    grouped = offers.withWatermark(time, delay).groupBy(*key)
    return grouped.transformWithState(processor, f"{schema}, {EVENTS}", "Append", "EventTime")
