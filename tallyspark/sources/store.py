"""The views table: one folder of Parquet files per version of a type, and snapshots that say which folders count.

Layout under the table's path: data/<a folder per write>/, each holding rows of one type, and snapshots/<number>.json, a
list of (type, folder) in order. The highest snapshot is the table. An append adds folders, a removal replaces those of the
types that it touches; folders that a snapshot no longer names stay until vacuum(), so lazy readers keep their files.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema

#: Rows that a file holds, about.
FILE_ROWS = 1_000_000
#: Snapshots whose folders vacuum() leaves alone, the current one included.
KEPT_SNAPSHOTS = 10
#: Writers that find their snapshot's number taken try again so often.
ATTEMPTS = 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyspark-"))
    return spark.conf.get("spark.checkpoint.dir")


class ViewStore:
    """A table under a path. A snapshot is created under a new number or not at all, so a write that fails changes nothing
    and of two writers at once the second one starts again from what the first one left."""

    def __init__(self, spark: SparkSession, path: str, table: str = "views"):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{table}"
        self._jvm = spark._jvm
        self._root = self._path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    # ------------------------------------------------------------ snapshots

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/snapshots")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _snapshot(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/snapshots/{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no views table at {self.path}")
        return numbers[-1], self._snapshot(numbers[-1])

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Makes the next snapshot from the current one; change may be called again if another writer was faster. None leaves it."""
        for _ in range(ATTEMPTS):
            number, now = self._current()
            new = change(now)
            if new is None:
                return now
            if self._create(number + 1, new):
                return new
        raise RuntimeError(f"{self.path} is written by too many at once")

    def _create(self, number: int, snapshot: dict) -> bool:
        """Whether the snapshot could be made: it is written apart and renamed, which fails where there is one."""
        part, whole = self._path(f"{self.path}/snapshots/{uuid.uuid4().hex}.part"), self._path(f"{self.path}/snapshots/{number:010d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        if not self._fs.exists(whole) and self._fs.rename(part, whole):
            return True
        self._fs.delete(part, False)
        return False

    def create(self) -> None:
        """An empty table, if there is none yet."""
        if not self._numbers():
            self._fs.mkdirs(self._path(f"{self.path}/snapshots"))
            self._create(0, {"folders": [], "next_id": 0, "batches": {}})

    def drop(self) -> None:
        self._fs.delete(self._root, True)

    def vacuum(self, keep: int = KEPT_SNAPSHOTS) -> int:
        """Deletes snapshots but the last so many, and folders that none of these names; returns how many folders went.

        Folders of a write that is under way are named by no snapshot yet: don't run it beside writers.
        """
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for _, f in self._snapshot(n)["folders"]}
        gone = 0
        data = self._path(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in named:
                gone += bool(self._fs.delete(f.getPath(), True))
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/snapshots/{n:010d}.json"), False)
        return gone

    # ------------------------------------------------------------ reading

    def read(self, viewable_type: str | None = None) -> DataFrame:
        """All views, or those of one type; other types' folders aren't opened."""
        _, now = self._current()
        folders = [f for kind, f in now["folders"] if viewable_type in (None, kind)]
        if not folders:
            return self.spark.createDataFrame([], schema.VIEWS)
        return self.spark.read.schema(schema.VIEWS).parquet(*[f"{self.path}/data/{f}" for f in folders])

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame) -> tuple[list[tuple[str, str]], int]:
        """Writes rows, one folder per type, in files ordered by entity, so that a scan for one skips row groups; the
        folders and the highest id."""
        rows = rows.select(*schema.VIEWS.names)
        found, sizes = [], rows.groupBy("viewable_type").agg(F.count("*").alias("n"), F.max("id").alias("last")).collect()  # a row per type
        for kind, n in sorted((r["viewable_type"], r["n"]) for r in sizes):
            folder = f"{len(found):04d}-{uuid.uuid4().hex}"
            own, files = rows.where(F.col("viewable_type") == kind), max(1, -(-n // FILE_ROWS))
            own = own.coalesce(1) if files == 1 else own.repartitionByRange(files, "viewable_id", "viewed_at", "id")
            own.sortWithinPartitions("viewable_id", "viewed_at").write.parquet(f"{self.path}/data/{folder}")
            found.append((kind, folder))
        return found, max((r["last"] for r in sizes), default=-1)

    def reserve(self, n: int) -> int:
        """The first of n ids that no other writer gets."""
        return self._commit(lambda now: now | {"next_id": now["next_id"] + n})["next_id"] - n

    def append(self, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> DataFrame | None:
        """Adds rows; those without a column id are numbered on from the highest one. Returns the rows as they were written.

        batch: a stream's name and the number of its batch. Batches come in order, so one that isn't above the last number
        of its stream has been appended before: nothing is added then, and None returned.
        """
        self.create()
        if batch and batch[1] <= self._current()[1]["batches"].get(batch[0], -1):
            return None
        if "id" not in rows.columns:
            # written once, as rows that are made anew might come out in another order
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            numbered = rows.withColumn("id", F.monotonically_increasing_id())
            numbered.write.parquet(staged)
            parts = self.spark.read.schema(numbered.schema).parquet(staged)
            part = F.shiftright("id", 33)
            sizes = {r["part"]: r["n"] for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row per part
            base, begins = self.reserve(sum(sizes.values())), {}
            for k in sorted(sizes):
                begins[k], base = base, base + sizes[k]
            before = self.spark.createDataFrame(list(begins.items()), "part long, begin long")
            placed = parts.withColumn("part", part).join(F.broadcast(before), "part")
            folders, last = self._write(placed.withColumn("id", F.col("begin") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "begin"))
            self._fs.delete(self._path(staged), True)
        else:
            folders, last = self._write(rows)

        def change(now: dict) -> dict | None:
            if batch and batch[1] <= now["batches"].get(batch[0], -1):
                return None
            return now | {"folders": now["folders"] + folders, "next_id": max(now["next_id"], last + 1), "batches": now["batches"] | (dict([batch]) if batch else {})}

        new = self._commit(change)
        if folders and list(folders[0]) not in [list(f) for f in new["folders"]]:
            return None
        if not folders:
            return self.spark.createDataFrame([], schema.VIEWS)
        return self.spark.read.schema(schema.VIEWS).parquet(*[f"{self.path}/data/{f}" for _, f in folders])

    def remove_type(self, viewable_type: str) -> None:
        """Removes all views of a type, by leaving its folders out of the next snapshot; no file is read or written."""
        self.create()
        self._commit(lambda now: now | {"folders": [x for x in now["folders"] if x[0] != viewable_type]})

    def rewrite(self, viewable_type: str, keep: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces one type's views by what keep leaves of them; other types' files stay as they are.

        What another writer appends to the type meanwhile stays too.
        """
        self.create()
        _, now = self._current()
        old = [list(x) for x in now["folders"] if x[0] == viewable_type]
        if not old:
            return
        rows = self.spark.read.schema(schema.VIEWS).parquet(*[f"{self.path}/data/{f}" for _, f in old])
        new, _ = self._write(keep(rows))

        def change(now: dict) -> dict:
            if not all(x in now["folders"] for x in old):
                raise RuntimeError(f"views of {viewable_type} were removed by two writers at once; try again")
            return now | {"folders": [x for x in now["folders"] if x not in old] + [list(x) for x in new]}

        self._commit(change)
