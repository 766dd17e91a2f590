"""Document quality: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import labelled, shared

#: Labelled rows per class that a model is fitted on, at most.
PER_LABEL = 10_000
THRESHOLD = 0.3

_GROUPS = [
    [*range(65, 91)], [*range(97, 123)], [*range(48, 58)], [32], [10], [33], [124], [*b"%$#&*@^~"], [*b".,;:?"],
    [*b"\"'`"], [*b"<>{}[]()/\\=+_-"], [*range(128, 256)], [x for x in range(32) if x != 10],
]


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, minlength=n)


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of distinct keys, and how often its most frequent one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    both = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    new = np.flatnonzero(np.diff(both, prepend=~both[:1]))
    at = (both[new] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, at, np.diff(new, append=len(both)))
    return np.bincount(at, minlength=n), most


def statistics(column: pa.LargeStringArray) -> np.ndarray:
    """One row of float32 statistics for each text; an empty text has zeros."""
    words = shared.Words(column, lower=False)
    n, size = words.n_docs, np.diff(words.offsets)
    byte_rows = np.repeat(np.arange(n), size)
    histogram = np.bincount(byte_rows * 256 + words.data, minlength=n * 256).reshape(n, 256)
    histogram[:, 32] -= 1  # the space that raw() adds
    chars = np.maximum(size - 1, 1)
    share = histogram / chars[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log(share), 0).sum(1)
    length, at, count = words.end - words.start, words.doc, np.maximum(words.count, 1)
    upper = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data >= 65) & (words.data < 91), out=upper[1:])
    capitals = upper[words.end] - upper[words.start]
    mean = _per_row(length, at, n) / count
    longest = np.zeros(n)
    np.maximum.at(longest, at, length)
    h = words.hashes()
    kinds, most = _distinct(h, at, n)
    threes, three_rows = shared.shingles(words, h, 3)
    kinds3, most3 = _distinct(threes, three_rows, n)
    repeat = np.zeros(len(h))
    repeat[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    lines = histogram[:, 10] + 1
    columns = [
        np.log1p(size - 1), np.log1p(words.count), entropy, mean,
        np.sqrt(np.maximum(_per_row(length.astype(float) ** 2, at, n) / count - mean**2, 0)), longest,
        _per_row(length <= 3, at, n) / count, _per_row(length >= 12, at, n) / count,
        _per_row(capitals == length, at, n) / count, _per_row(capitals > 0, at, n) / count,
        kinds / count, most / count, kinds3 / count, most3 / count, _per_row(repeat, at, n) / count,
        np.log1p(lines), words.count / lines, words.count / chars,
        *(share[:, g].sum(1) for g in _GROUPS),
    ]
    return np.stack(columns, 1).astype(np.float32)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x nodes
    limit: np.ndarray  # trees x nodes: greater values go right
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, depth = len(x), self.leaf.shape[1].bit_length() - 1
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(n)[:, None]
        node = np.zeros((n, len(self.leaf)), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return self.base + self.leaf[tree, node - self.feature.shape[1]].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64,
    rate: float = 0.15, ridge: float = 1.0, least: float = 10.0,
) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins, level by level."""
    n, n_features = x.shape
    total = weight.sum()
    share = np.clip((weight * y).sum() / total, 1e-4, 1 - 1e-4) if n else 0.5
    out = Trees(
        np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf, np.float32),
        np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))),
    )
    if n < 2 * least or len(np.unique(y)) < 2:
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(n_features)]
    held = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(n, out.base)
    offset = np.arange(n_features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            flat = ((node - first)[:, None] * (n_features * bins) + offset + held).ravel()
            shape = (width, n_features, bins)
            sums = [np.bincount(flat, np.repeat(v, n_features), minlength=width * n_features * bins).reshape(shape).cumsum(2) for v in (g, h)]
            gl, hl = sums
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least / 10) | (ha - hl < least / 10)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    out.feature[t, first + k], out.limit[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.limit[t, node])
        leaf = node - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, minlength=2**depth), np.bincount(leaf, h, minlength=2**depth)
        out.leaf[t] = -rate * gs / (hs + ridge)
        margin += out.leaf[t][leaf]
    return out


# ---------------------------------------------------------------- DataFrames


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Trees:
    """Fits on up to per_label labelled documents of each class; classes weigh as in all labels."""
    spark = docs.sparkSession
    chosen = labelled.sample(labels, id_col, label_col, per_label)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = shared.texts(batch.column(2))
            for a, b in shared.slices(column):
                found = statistics(column.slice(a, b - a))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "label", "x"])

    rows = labelled.with_text(chosen, docs, id_col, text_col).select(F.col("id").cast("long"), F.col("label").cast("int"), "text")
    got = rows.mapInArrow(measure, "id long, label int, x binary").toPandas().sort_values(["id", "label", "x"])
    share = {r["label"]: r["n"] for r in labels.select(F.col(label_col).cast("int").alias("label")).dropna().groupBy("label").agg(F.count("*").alias("n")).collect()} if len(got) else {}
    width = statistics(pa.array([""], pa.large_string())).shape[1]
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width)
    y = (got["label"].to_numpy() > 0).astype(float)
    had = got["label"].value_counts()
    weight = np.array([share.get(k, 1) / had[k] for k in got["label"]]) if len(got) else np.zeros(0)
    return fit_trees(x, y, weight * (len(weight) / max(weight.sum(), 1e-9)))


def score(model: Trees, text: Column) -> Column:
    """The probability of label 1 for each text; null counts as empty."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            column, out = shared.texts(batch), []
            for a, b in shared.slices(column):
                out.append(model.score(statistics(column.slice(a, b - a))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scored(text)


def filter_quality(docs: DataFrame, model: Trees, *, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, whose score is at least `least`."""
    own = "__quality_score"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, score(model, F.col(text_col))).where(F.col(own) >= least).drop(own)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; labels of the fold crc32(doc_id) mod 5 = 0 are not learned from.

    Null and empty texts are scored as texts without words; repeated rows each get their row; no labels: the score is
    the share of label 1 (0.5 if there are none at all).
    """
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(labelled.fold("doc_id", 5) != 0))
    held_out = F.coalesce(labelled.fold("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
