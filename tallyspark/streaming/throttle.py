"""The cooldown over a stream. Requests wait in state until the watermark has passed them, and are then folded in order of
(ts, event_id), so the answer doesn't hang on the order in which they arrive; what comes later than the watermark goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from tallyspark.operators.cooldown import Cooldowns, namespace_columns
from tallyspark.operators.gates import visitor_of

class Throttle(StatefulProcessor):
    """One namespace's or item's requests: those waiting, and when the cooldowns end (milliseconds and microseconds)."""

    def __init__(self, columns: list[str], waiting: T.StructType, mode: str = "per_item"):
        self.columns, self.kind, self.mode = columns, waiting, mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kind)
        self.ends = handle.getListState("ends", "item long, end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for row in frame[self.columns].itertuples(index=False, name=None):
                at = int(row[self.columns.index("at")]) // 1000
                if at < passed:
                    continue  # later than the watermark allows
                self.waiting.appendValue(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row))
                self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        at, number, lasts, item = (self.columns.index(c) for c in ("at", "event_id", "lasts", "viewable_id"))
        held = sorted(self.waiting.get(), key=lambda r: (r[at], r[number]))
        due = [r for r in held if r[at] // 1000 < passed]
        left, out = held[len(due) :], []
        state = Cooldowns(self.mode)
        state.ends = {i: end for i, end in self.ends.get()}
        state.least = min(state.ends.values(), default=None)
        for row in due:
            if row[lasts] is None or state.push(row[item], row[at], row[lasts]):
                out.append(tuple(row))
        if left:
            self.waiting.put([tuple(r) for r in left])
        elif held:
            self.waiting.clear()
        # what has ended can't hold any request back; in the other mode it is what ends all others
        if self.mode == "per_item":
            state.ends = {i: end for i, end in state.ends.items() if end // 1000 > passed or left}
        elif not left and state.least is not None and state.least // 1000 <= passed:
            state.ends = {}
        if state.ends:
            self.ends.put(list(state.ends.items()))
            self.handle.registerTimer(max(passed, min(state.ends.values()) // 1000) + 1)
        elif self.ends.exists():
            self.ends.clear()
        return iter([pd.DataFrame(out, columns=self.columns, dtype=object)] if out else ())

    def close(self) -> None:
        pass


def throttle_stream(requests: DataFrame, delay: str = "10 minutes", mode: str = "per_item") -> DataFrame:
    """Accepted requests of a stream of requests, as they are settled. delay: how much later than others one may come.

    Needs spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    session, kind, collection = namespace_columns()
    keyed = requests.select(
        "event_id", at.alias("at"), F.col("ts").cast("timestamp").alias("event_time"), "session_id", visitor_of(requests).alias("visitor"), "viewable_type", "viewable_id", "collection",
        session.alias("session_key"), kind.alias("type_key"), collection.alias("collection_key"), F.col("viewable_id").alias("item_key"),
        (F.col("cooldown_minutes").cast("long") * 60_000_000).alias("lasts"),
    ).withWatermark("event_time", delay)
    kept = T.StructType([keyed.schema[c] for c in ("event_id", "at", "session_id", "visitor", "viewable_type", "viewable_id", "collection", "lasts")])
    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept.fields])
    keys = ["session_key", "type_key", "collection_key"] + (["item_key"] if mode == "per_item" else [])
    return keyed.groupBy(*keys).transformWithStateInPandas(Throttle(kept.names, kept, mode), outputStructType=kept, outputMode="Append", timeMode="EventTime")


def record_stream(requests: DataFrame, append: Callable[[DataFrame, int], object], checkpoint: str, delay: str = "10 minutes", mode: str = "per_item", **trigger):
    """Starts a query that hands every batch of accepted views and its number to append; ids are those of the requests.

    A batch may come again after a failure, with the same number: append must take it once, as ViewStore.append() does.
    """

    def batch(rows: DataFrame, number: int) -> None:
        second = F.date_trunc("second", F.timestamp_micros("at")).cast("timestamp_ntz")
        append(rows.select(F.col("event_id").alias("id"), "viewable_type", "viewable_id", "visitor", "collection", second.alias("viewed_at")), number)

    writer = throttle_stream(requests, delay, mode).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
