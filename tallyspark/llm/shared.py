"""Helpers that all operators of this subpackage use: shared storage and vectorised text scanning."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one, but only if
    the driver is the only machine; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        option = context._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
        if not found:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="tallyspark-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while any(n.lower() in taken for n in names):
        names = tuple(n + "_" for n in names)
    return list(names)


#: While stored() writes: Spark deletes a query's shuffle files as soon as it ends, not when the driver collects its garbage, and
#: the driver keeps the beginning of its plan's description only, which goes into megabytes where expressions are long.
WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "16384"}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of lineage that a lost executor doesn't undo. The shuffle files
    that it took are deleted then."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in WHILE_STORED}
    try:
        for k, v in WHILE_STORED.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: The share of its largest heap from which the driver gives back what it no longer needs.
HEAP_SHARE = 0.5
#: While it does: how much of the heap may be free afterwards, in percent. Java's own values leave up to 70.
WHILE_TIDIED = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "20"}


def tidy(spark: SparkSession) -> bool:
    """Has the driver drop the plans, broadcast tables and generated classes of queries that have ended, and return the memory,
    if its heap has grown beyond HEAP_SHARE: left alone, a JVM grows to its limit before it looks for what it can drop.
    What compilers and buffers took outside of the heap and freed is returned each time."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    grown = runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory()
    if grown:
        gc.collect()  # Python's handles of plans, which hold them in the JVM
        before = {k: v for k in WHILE_TIDIED if (v := _option(spark, k))}
        try:
            for k in before:
                _option(spark, k, WHILE_TIDIED[k])
            spark._jvm.java.lang.System.gc()
        finally:
            for k, v in reversed(before.items()):  # the least may not pass the most
                _option(spark, k, v)
    trim(spark)
    return grown


def trim(spark: SparkSession) -> bool:
    """Has the driver's C library return memory that was freed, which it keeps for each thread that took some. False: it can't."""
    management = spark._jvm.java.lang.management.ManagementFactory
    name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        _call(spark, "javax.management.MBeanServer", "invoke", types, management.getPlatformMBeanServer(), name, "systemTrimNativeHeap", None, None)
    except Py4JJavaError:  # not HotSpot, or not on glibc
        return False
    return True


def _option(spark: SparkSession, name: str, value: str | None = None) -> str | None:
    """The value of an option of the driver's JVM, after it was set to the value, if there is one; None without such an option."""
    kind, text = "com.sun.management.HotSpotDiagnosticMXBean", "java.lang.String"
    try:
        bean = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(spark._jvm.java.lang.Class.forName(kind))
        if value is not None:
            _call(spark, kind, "setVMOption", (text, text), bean, name, value)
        return _call(spark, kind, "getVMOption", (text,), bean, name).getValue()
    except Py4JJavaError:
        return None


def _call(spark: SparkSession, kind: str, name: str, types: tuple[str, ...], on: JavaObject, *values: object) -> JavaObject:
    """Calls a method as the public interface has it: py4j looks for it in the object's class, which Java's modules hide."""
    java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
    kinds, held = gateway.new_array(java.Class, len(types)), gateway.new_array(java.Object, len(values))
    for k, (type_, value) in enumerate(zip(types, values)):
        kinds[k], held[k] = java.Class.forName(type_), value
    return java.Class.forName(kind).getMethod(name, kinds).invoke(on, held)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what stored() wrote for frames that no later result reads."""
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- scanning of text in numpy

SLICE_BYTES = 2 << 20
_SPACE = pa.scalar(" ", pa.large_string())
_EMPTY = pa.scalar("", pa.large_string())
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The multipliers of the splitmix64 finaliser and of its chain.
_MIX1, _MIX2, _ROLL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Longer runs of bytes are hashed one by one.
LONG_RUN = 128


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A string column with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), _EMPTY)


def slices(column: pa.LargeStringArray, budget: int = SLICE_BYTES, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Ranges of up to so many rows with about budget bytes of text each; a longer text is a range of its own."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + budget, "right"))))
        yield start, stop
        start = stop


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, each followed by a space, and where each begins (one more for the end)."""
    column = pc.binary_join_element_wise(column, _EMPTY, _SPACE)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1])
    return data[offsets[0] :], offsets - offsets[0]


def chunks(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit numbers, with room for chunk() to read beyond the end."""
    held = np.zeros((len(data) >> 3) + 3, np.uint64)
    held.view(np.uint8)[: len(data)] = data
    return held


def chunk(held: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as a number; of fewer than 8 left (but 1 or more) only those."""
    k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    value = (held[k] >> shift) | ((held[k + 1] << np.uint64(1)) << (np.uint64(63) - shift))
    spare = ((8 - np.minimum(left, 8)) << 3).astype(np.uint64)
    return value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> spare)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, each of one byte or more: chained over 8 bytes at a time, mixed after each."""
    held, size = chunks(data), end - start
    h = mix(chunk(held, start, size) ^ mix(size.astype(np.uint64)))
    rest = np.flatnonzero((size > 8) & (size <= LONG_RUN))
    for done in range(8, LONG_RUN, 8):
        if not len(rest):
            break
        h[rest] = mix(h[rest] * _ROLL ^ chunk(held, start[rest] + done, size[rest] - done))
        rest = rest[size[rest] > done + 8]
    for k in np.flatnonzero(size > LONG_RUN).tolist():
        h[k] = np.frombuffer(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


class Words:
    """The words (runs of letters, digits and non-ASCII bytes) of a slice of texts.

    data: the bytes; start, end: of each word; doc: the row of each word;
    first: for each row (one more for the end) the number of its first word.
    """

    def __init__(self, column: pa.LargeStringArray, lower: bool = True):
        self.data, self.offsets = raw(pc.utf8_lower(column) if lower else column)
        is_word = _WORD_BYTE[self.data].view(np.int8)
        edge = np.diff(is_word, prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.offsets)
        self.n_docs = len(self.offsets) - 1
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return run_hashes(self.data, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have words, and 128 bits (as two columns) of a cryptographic hash of each one's word sequence."""
        inside = _WORD_BYTE[self.data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # each word with one byte behind it
        joined = np.where(inside, self.data, np.uint8(32))[keep].tobytes()
        cuts = np.concatenate([[0], np.cumsum(keep)])[self.offsets].tolist()
        has = np.flatnonzero(self.count)
        found = b"".join([hashlib.blake2b(joined[cuts[k] : cuts[k + 1]], digest_size=16).digest() for k in has.tolist()])
        return has, np.frombuffer(found, np.uint64).reshape(-1, 2)


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words and their rows; a shorter text is one shingle, a text without words none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rng = np.random.default_rng(size)
    factors = rng.integers(0, 1 << 62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total[: n - k] += mix(hashes[k:] * factors[k]) if n > k else 0
    begins = np.arange(n)
    last = words.first[words.doc + 1]
    whole = begins + size <= last
    short = (words.count[words.doc] < size) & (begins == words.first[words.doc])
    out = mix(total)
    if short.any():
        at = np.flatnonzero(short)
        for b in at:
            run = hashes[b : last[b]]
            out[b] = mix(np.bitwise_xor.reduce(mix(run * factors[: len(run)]), keepdims=True) + np.uint64(len(run)))[0]
    keep = whole | short
    return out[keep], words.doc[keep]


# ---------------------------------------------------------------- sorted groups in mapInArrow


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by their first n_keys columns, tables of whole groups and where each group begins.

    Holds no more than one batch and the group that its end cuts.
    """
    waiting: list[pa.RecordBatch] = []

    def starts(columns: list[np.ndarray], n: int) -> np.ndarray:
        edge = np.zeros(n, bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        edge[:1] = True
        return np.flatnonzero(edge)

    def keys(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        return [np.asarray(batch.column(k)) for k in range(n_keys)]

    def ready(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        found = pa.Table.from_batches(parts).combine_chunks()
        return found, starts(keys(found), len(found))

    for batch in batches:
        if not len(batch):
            continue
        own = keys(batch)
        edges = starts(own, len(batch))
        if waiting and all(c[0] == np.asarray(waiting[-1].column(k))[-1] for k, c in enumerate(own)):
            cut = int(edges[1]) if len(edges) > 1 else len(batch)
            waiting.append(batch.slice(0, cut))
            if cut == len(batch):
                continue
            edges = edges[1:]
        if waiting:
            yield ready(waiting)
        if edges[-1] > edges[0]:
            yield ready([batch.slice(edges[0], edges[-1] - edges[0])])
        waiting = [batch.slice(edges[-1])]
    if waiting:
        yield ready(waiting)
