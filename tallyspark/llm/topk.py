"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists, block by block.

Each list is read from the end that helps the query; after depth rows of each, no row that has not been met can score more
than the sum of what the lists have come to, weighed by the query. The reading stops when that bound cannot beat the k-th
score found so far, which is carried from block to block of one query. Where the vectors leave the bound no room, as
random ones of equal length in many dimensions do, all rows are met, and then scored as one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import shared

K = 5
FACTOR = 256
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024
#: Blocks of candidates that one task reads in turn, carrying each query's k best.
IN_TURN = 4
#: Rows that are scored of each list's end before the first bound is looked at, and parts of a block at which it may be.
FIRST_DEPTH, STEPS = 4, 24


class Best:
    """The k best of each of some queries so far: scores and ids, in order, with empty places at the end."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), self.NONE), np.zeros((n, k), np.int64)

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > 4 * self.k:  # all that reach the k-th score, ties included
            keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            scores, ids = scores[keep], ids[keep]
        best = np.lexsort((ids, -scores.astype(np.float64)))[: self.k]
        self.scores[q], self.ids[q] = scores[best], ids[best]


class Lists:
    """The vectors of a block (integers, as doubles) and, for each dimension, the rows in ascending order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        n = len(ids)
        self.depths = np.unique(np.minimum(n, np.geomspace(FIRST_DEPTH, max(n, FIRST_DEPTH), STEPS).astype(int)))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and depth the most that a row can score that is in none of the lists' ends of that depth."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.sorted[len(self.ids) - self.depths].T + down @ self.sorted[self.depths - 1].T

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best) -> int:
        """Takes into best what this block has for the queries; returns how many rows were scored, over all queries."""
        n, bounds = len(self.ids), self.bounds(queries)
        scored, whole = 0, []
        for q, query in enumerate(queries):
            met = np.zeros(n, bool)
            at = 0
            while best.scores[q, -1] == best.NONE and self.depths[at] < n:  # nothing to beat yet: the lists' first rows give a k-th score
                self._read(query, own[q], self.depths[at], met, best, q)
                at += 1
            while True:
                # the least depth whose bound can't reach the k-th score so far; an equal score might have a lesser id
                enough = np.flatnonzero(bounds[q] < best.scores[q, -1])
                at = int(enough[0]) if len(enough) else len(self.depths) - 1
                if self.depths[at] == n:
                    break
                before = best.scores[q, -1]
                self._read(query, own[q], self.depths[at], met, best, q)
                if met.all() or best.scores[q, -1] >= before:
                    break
            if self.depths[at] == n and not met.all():
                whole.append(q)
            scored += int(met.sum())
        for lot in range(0, len(whole), 128):
            some = whole[lot : lot + 128]
            scores = (queries[some] @ self.x.T).astype(np.int64)
            scores[self.ids[None, :] == own[some][:, None]] = best.NONE
            for q, row in zip(some, scores):
                reach = np.flatnonzero((row >= best.scores[q, -1]) & (row != best.NONE) & ~np.isin(self.ids, best.ids[q][best.scores[q] != best.NONE]))
                best.take(q, row[reach], self.ids[reach])
        return scored + n * len(whole)

    def _read(self, query: np.ndarray, own: int, depth: int, met: np.ndarray, best: Best, q: int) -> None:
        """Scores in full the rows among the first of each list, that helps the query, which were not met before."""
        seen = np.zeros(len(self.ids), bool)
        seen[self.order[len(self.ids) - depth :, query > 0]] = True
        seen[self.order[:depth, query < 0]] = True
        new = np.flatnonzero(seen & ~met & (self.ids != own))
        met |= seen
        best.take(q, (self.x[new] @ query).astype(np.int64), self.ids[new])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, np.ndarray, Best] | None = None
        for found, starts in shared.whole_groups(batches, 4):
            kind, ids = found.column("kind").to_numpy(), found.column("id").to_numpy()
            place = np.stack([found.column(c).to_numpy() for c in ("width", "quer", "turn")], 1)
            vectors = found.column("q").combine_chunks()
            if isinstance(vectors, pa.ChunkedArray):
                vectors = vectors.chunk(0)
            flat, width = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), found.column("width").to_numpy()
            at = np.concatenate([[0], np.cumsum(width)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                own, is_query = flat[at[s] : at[e]].reshape(e - s, -1), kind[s:e] == 1
                if is_query.all() or not is_query.any():
                    continue
                key, asked = tuple(place[s]), ids[s:e][is_query]
                if held is None or held[0] != key:
                    if held is not None:
                        yield _rows(*held[1:])
                    held = key, asked, Best(len(asked), k)
                Lists(ids[s:e][~is_query], own[~is_query]).search(own[is_query], asked, held[2])
        if held is not None:
            yield _rows(*held[1:])

    return search


def _rows(asked: np.ndarray, best: Best) -> pa.RecordBatch:
    q, c = np.nonzero(best.scores != best.NONE)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (asked[q], best.ids[q, c], best.scores[q, c])], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its k highest integer inner products, ties to the lesser vec_id.

    Both tables: id long, q array<long>. A query meets every vector of its length but those of its own id. Rows that repeat
    an id and its vector are one row that came twice, and count once: otherwise one vector could fill a query's places.
    Different vectors of one id are different candidates; of several under one query id the least counts. Queries meet
    vectors in blocks, each vector being sent once per block of queries, each query once per IN_TURN blocks of vectors.
    Products must stay below 2**53, beyond which this fails instead of rounding.
    """
    sides = []
    n, m = vectors.count(), queries.count()
    turns = max(1, -(-n // (CANDIDATE_BLOCK * IN_TURN)))
    blocks = {0: turns * IN_TURN, 1: max(1, -(-m // QUERY_BLOCK))}
    most = F.aggregate("q", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x).cast("double")))
    largest = vectors.agg(F.max(most), F.max(F.size("q"))).first()
    asked = queries.agg(F.max(most)).first()[0]
    if largest[0] is not None and asked is not None and largest[0] * asked * largest[1] >= 2**53:
        raise ValueError("the products of these vectors may exceed 2**53")
    for kind, rows in ((0, vectors.distinct()), (1, queries.groupBy("id").agg(F.min("q").alias("q")))):
        own = F.pmod(F.xxhash64("id"), F.lit(blocks[kind]).cast("long")).alias("mine")
        met = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[1 - kind] - 1).cast("long"))).alias("other")
        cut = rows.select("id", "q", own, met)
        cand, quer = ("mine", "other") if kind == 0 else ("other", "mine")
        sides.append(cut.select(F.size("q").cast("long").alias("width"), F.floor(F.col(cand) / IN_TURN).alias("turn"), F.col(quer).alias("quer"), F.col(cand).alias("cand"), F.lit(kind).alias("kind"), "id", "q"))
    order = ("width", "quer", "turn", "cand")
    dealt = sides[0].union(sides[1]).select(*order, "kind", "id", "q").repartition(*order[:3]).sortWithinPartitions(*order, "kind", "id")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, q: floor(256 x) of each component x; rows without id, and vectors that are null, empty or not all finite, are left out."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    return held.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * FACTOR).cast("long")).alias("q"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings to each whose vec_id is divisible by 50; odd rows as top_k() says. An empty table gives no rows."""
    rows = whole_numbers(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where("id % 50 = 0"))


OP9_SQL = """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
