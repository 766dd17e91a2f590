"""The greedy per-session throttle. A request with a cooldown is accepted if no accepted one of its item still lasts.

The rule looks back at the last accepted request, not at the last one, so it is a fold in order of (ts, event_id). Rows
are dealt by key, sorted, and folded as they stream by: the memory of a task is a batch and one key's state. A request
that comes after every cooldown that an earlier one could have started is accepted whatever came before, so the history of
a key with very many requests is cut there, and its runs are folded by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("per_item", "namespace_flush")
#: Keys with more requests than this are cut into runs, where quiet times between parts of SLOT microseconds allow it.
LONG_KEY, SLOT = 1_000_000, 3_600_000_000


def namespace_key(prefix: str, viewable_type: str, collection: str | None) -> str:
    """Where the cooldowns of a type, and of a collection if one is named (even an empty one), are kept."""
    return f"{prefix}.{viewable_type.lower().replace(chr(92), '-')}" + (f":{collection}" if collection is not None else "")


def namespace_columns() -> list[Column]:
    """The same of requests, as columns: the session, the type whatever its case, and the collection, null apart from empty."""
    collection = F.concat(F.when(F.col("collection").isNull(), "-").otherwise("+"), F.coalesce("collection", F.lit("")))
    return [F.col("session_id"), F.translate(F.lower("viewable_type"), "\\", "-"), collection]


class Cooldowns:
    """The state of one namespace: when the cooldown of each item ends.

    per_item: an item's cooldown ends alone. namespace_flush: as soon as any has ended, all of them are forgotten.
    """

    def __init__(self, mode: str = "per_item"):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.mode, self.ends, self.least = mode, {}, None

    def push(self, item: object, at: int, lasts: int) -> bool:
        """Whether a request at that time is accepted; only then does it start a cooldown."""
        if self.mode == "namespace_flush":
            if self.least is not None and self.least <= at:
                self.ends, self.least = {}, None
        elif self.ends.get(item, at + 1) <= at:
            del self.ends[item]
        if item in self.ends:
            return False
        self.ends[item] = end = at + lasts
        self.least = end if self.least is None else min(self.least, end)
        return True


def following(group: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row, in order of group and time, the first later one of its group at or after its end; len(group) if there is none."""
    times = np.unique(at)
    width, n = len(times) + 1, len(group)
    order = group * width + np.searchsorted(times, at)
    found = np.maximum(np.searchsorted(order, group * width + np.searchsorted(times, end)), np.arange(1, n + 1))
    return np.where(np.append(group, -1)[np.minimum(found, n)] == group, found, n)


def _fold_items(mode: str = "per_item"):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, None  # the key at the end of the last batch, and when its cooldown ends
        for batch in batches:
            if not len(batch):
                continue
            key, at = np.asarray(batch.column(0)), batch.column(2).to_numpy()
            end = at + batch.column(3).to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new).tolist()
            step = following(np.cumsum(new) - 1, at, end).tolist()
            if key[0] == last and until is not None:
                stop = first[1] if len(first) > 1 else len(key)
                begin = int(np.searchsorted(at[:stop], until))
                first[0] = begin if begin < stop else len(key)
            else:
                until = None
            kept: list[int] = []
            for k in first:
                while k < len(key):
                    kept.append(k)
                    k = step[k]
            if kept and key[kept[-1]] == key[-1]:
                until = int(end[kept[-1]])
            elif key[-1] != last:
                until = None
            last = key[-1]
            yield batch.select(range(4, batch.num_columns)).take(pa.array(kept, pa.int64()))

    return fold


def _fold_namespaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, Cooldowns("namespace_flush")
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for k, (own, item, at, lasts) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            if own != key:
                key, state = own, Cooldowns("namespace_flush")
            keep[k] = state.push(item, at, lasts)
        yield batch.select(range(4, batch.num_columns)).filter(pa.array(keep))


def _in_runs(keyed: DataFrame) -> DataFrame:
    """keyed, the keys of long histories extended by a number of their run.

    A run ends before a slot that begins after all cooldowns that any earlier request could have started. Only one row per
    key and slot is looked at in order.
    """
    slot = F.floor(F.col("__at") / SLOT)
    long_keys = keyed.groupBy("__key").agg(F.count("*").alias("__n")).where(F.col("__n") > LONG_KEY).select("__key")
    slots = keyed.join(F.broadcast(long_keys), "__key").groupBy("__key", slot.alias("__slot"))  # total / LONG_KEY keys at most
    slots = slots.agg(F.min("__at").alias("__from"), F.max(F.col("__at") + F.col("__lasts")).alias("__to"))
    before = Window.partitionBy("__key").orderBy("__slot")
    reach = F.max("__to").over(before.rowsBetween(Window.unboundedPreceding, -1))
    cuts = slots.withColumn("__cut", F.coalesce(reach <= F.col("__from"), F.lit(False)).cast("int"))
    runs = cuts.select("__key", "__slot", F.sum("__cut").over(before).alias("__run"))
    met = keyed.withColumn("__slot", slot).join(runs, ["__key", "__slot"], "left")
    return met.withColumn("__key", F.concat("__key", F.coalesce(F.concat(F.lit("#"), "__run"), F.lit("")))).drop("__slot", "__run")


def throttle(requests: DataFrame, *, mode: str = "per_item") -> DataFrame:
    """The requests that the cooldown lets by, with their columns. A null cooldown_minutes is no cooldown: such requests
    pass and start none. A null collection is a namespace of its own, as is an empty one. A null ts counts as long ago."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    free = requests.where(F.col("cooldown_minutes").isNull())
    bound = requests.where(F.col("cooldown_minutes").isNotNull())
    keys = namespace_columns() + ([F.col("viewable_id")] if mode == "per_item" else [])
    keyed = bound.select(
        F.to_json(F.array(*[k.cast("string") for k in keys])).alias("__key"), F.col("viewable_id").alias("__item"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 61))).alias("__at"),
        (F.col("cooldown_minutes").cast("long") * 60_000_000).alias("__lasts"), "*",
    )
    longest = keyed.groupBy("__key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if longest and longest > LONG_KEY:
        keyed = _in_runs(keyed)
    ordered = keyed.repartition("__key").sortWithinPartitions("__key", "__at", "event_id")
    if mode == "per_item":
        found = ordered.select("__key", "__item", "__at", "__lasts", *requests.columns).mapInArrow(_fold_items(), requests.schema)
    else:
        found = ordered.select("__key", "__item", "__at", "__lasts", *requests.columns).mapInArrow(_fold_namespaces, requests.schema)
    return free.unionByName(found)
