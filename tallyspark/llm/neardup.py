"""Documents whose five-word shingles have a Jaccard similarity of 0.8 or more: a MinHash LSH forest, then exact checks.

1. Equal word sequences form one class; only its representative, the least id, goes on.
2. Each tree is a sorted prefix trie of the representatives' MinHash values: those that share a prefix meet, in the order of
   what follows it. Matching begins with whole prefixes, of DEPTH values. They are shortened as long as nothing has matched
   or the least similar matches so far are such that pairs like them are found with less than the target recall.
3. Under each trie node a spanning forest of edges joins those whose whole signatures agree enough; its components are the
   candidates. A node emits fewer edges than it has members.
4. Within each component all pairs are checked exactly, in blocks, which emit one row per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import shared
from tallyspark.llm.bloom import Bloom
from tallyspark.llm.graph import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
TARGET_RECALL = 0.999
BUCKET_BLOCK, CHECK_BLOCK = 4096, 512
#: Matches are looked at in classes of similarity of this width.
STRATUM = 0.05
#: The filter ahead of the texts' join takes so many bits at most; beyond, it only lets more texts through.
FILTER_BITS = 1 << 26


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix, from depth downwards, at which a pair at the threshold meets with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shortened(matches: dict[int, int], depth: int, threshold: float, target: float = TARGET_RECALL) -> int:
    """The depth to go on to from `depth`, or the same if no more is needed.

    matches: how many matches have been found at each number of agreeing values. Their least similar class, but no less
    than the threshold, must be found with the target recall; without matches the prefix loses one value.
    """
    floor = prefix_depth(threshold, target=target)
    if depth <= floor:
        return depth
    if not matches:
        return depth - 1
    low = min(matches) / (TREES * DEPTH)
    return min(depth, max(floor, prefix_depth(max(threshold, low // STRATUM * STRATUM), target=target)))


def agreement(threshold: float) -> float:
    """Agreement of whole signatures from which a pair is a candidate: five deviations below the threshold."""
    return threshold - 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(column: pa.LargeStringArray, size: int = WORDS, n: int = TREES * DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have words, a 128-bit hash of each one's word sequence, and its MinHash values (16 bits each)."""
    words = shared.Words(column)
    h = words.hashes()
    has = np.flatnonzero(words.count)
    if not len(has):
        return has, np.zeros((0, 2), np.uint64), np.zeros((0, n), np.uint16)
    hashed, row = shared.shingles(words, h, size)
    starts = np.searchsorted(row, has)
    out = np.zeros((len(has), n), np.uint16)
    for k, f in enumerate(_factors(n)):
        out[:, k] = np.minimum.reduceat(((hashed * f) >> np.uint64(32)).astype(np.uint32), starts) & 0xFFFF
    return has, words.prints()[1], out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = shared.texts(batch.column(1))
        for a, b in shared.slices(column):
            has, prints, found = signatures(column.slice(a, b - a))
            none = np.ones(b - a, bool)
            none[has] = False
            full = np.zeros((b - a, 2), np.int64)
            full[has] = prints.view(np.int64)
            held: list[bytes | None] = [None] * (b - a)
            for k, v in zip(has.tolist(), found):
                held[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(full[:, 0], mask=none), pa.array(full[:, 1], mask=none), pa.array(held, pa.binary())],
                ["doc_id", "text_print", "print1", "print2", "signature"],
            )


def forest_edges(own: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the rows of signatures that agree in at least that many values; rows come in order."""
    left, edges = np.arange(len(own)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = (own[left] == own[k]).sum(1) >= least
            for j in left[near].tolist():
                edges.append((j, k))
                queue.append(j)
            left = left[~near]
    return edges


def _node_edges(least: float):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, starts in shared.whole_groups(batches, 3):
            rep = found.column("rep").to_numpy()
            own = np.frombuffer(b"".join(found.column("signature").to_pylist()), np.uint16).reshape(len(rep), -1)
            a, b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
                for j, k in forest_edges(own[s:e], least * own.shape[1]):
                    a.append(s + j)
                    b.append(s + k)
            agree = (own[a] == own[b]).sum(1) if a else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64()), "agree": pa.array(agree, pa.int32())})

    return edges


def _matches(classes: DataFrame, depth: int, least: float) -> DataFrame:
    """a, b, agree: the forests' edges at all trie nodes of one depth."""
    values = [F.substring("signature", t * 2 * DEPTH + 1, 2 * DEPTH) for t in range(TREES)]
    paths = F.array(*[F.struct(F.xxhash64(F.lit(t), F.substring(v, 1, 2 * depth)).alias("node"), F.substring(v, 2 * depth + 1, 2 * DEPTH).alias("below")) for t, v in enumerate(values)])
    rows = classes.select("rep", F.explode(paths).alias("path")).select("rep", "path.*")
    crowded = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    members = rows.join(crowded, "node").join(classes.select("rep", "signature"), "rep").select("node", "n", "rep", "below", "signature")
    dealt = _in_blocks(members, "node", BUCKET_BLOCK).select("node", "i", "j", "below", "rep", "signature")
    tries = dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "below", "rep")
    return shared.stored(tries.mapInArrow(_node_edges(least), "a long, b long, agree int").distinct(), "neardup-edges")


def _candidates(classes: DataFrame, threshold: float, target: float) -> DataFrame:
    """Edges between representatives whose signatures agree enough, descending in the tries as far as the target asks for."""
    edges, depth = None, DEPTH
    while True:
        found = _matches(classes, depth, agreement(threshold))
        edges = found if edges is None else edges.union(found)
        counts = {r["agree"]: r["n"] for r in found.where("a != b").groupBy("agree").agg(F.count("*").alias("n")).collect()}  # a row per agreement
        further = shortened(counts, depth, threshold, target)
        if further == depth:
            return edges.select("a", "b").distinct()
        depth = further


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share; values in one set only are left out first."""
    n = len(sets)
    if n == 2:
        shared_by = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), shared_by], [shared_by, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((n, n), np.float64), 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        some = slice(*np.searchsorted(column, [first, first + width]))
        dense = np.zeros((n, width), np.float32)
        dense[owner[some], column[some] - first] = 1
        out += dense @ dense.T
    return out


def _check(threshold: float, size: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, starts in shared.whole_groups(batches, 3):
            rep, wanted, salt = (found.column(c).to_numpy() for c in ("rep", "print1", "salt"))
            part = found.column("j").to_numpy() != found.column("i").to_numpy()
            many = found.column("blocks").to_numpy() > 1
            column, sets, prints = shared.texts(found.column("text")), [], []
            for a, b in shared.slices(column):
                words = shared.Words(column.slice(a, b - a))
                hashed, row = shared.shingles(words, words.hashes(), size)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                sets += [np.unique(hashed[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                has, own = words.prints()
                full = np.zeros(b - a, np.uint64)
                full[has] = own[:, 0]
                prints.append(full.view(np.int64))
            prints = np.concatenate(prints)
            out: list[tuple[int, int, int, int, int, bool]] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
                # a repeated id may bring rows twice or other texts; rows come in order of id and print
                at = [k for k in range(s, e) if prints[k] == wanted[k]]
                at = [k for n, k in enumerate(at) if not n or (rep[k], wanted[k]) != (rep[at[n - 1]], wanted[at[n - 1]])]
                own = [sets[k] for k in at]
                if not own:
                    continue
                counts, sizes = (common(own) if len(own) > 1 else np.array([[len(own[0])]])), np.array([len(x) for x in own])
                near = counts * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
                np.fill_diagonal(near, False)
                label = np.arange(len(own))
                while True:  # the least member that each is connected with; members come in order of id
                    least = np.where(near, label[None, :], len(own)).min(1)
                    new = np.minimum(label, least)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                if part[s]:  # pairs within one block are counted where that block meets itself
                    near &= salt[at][:, None] != salt[at][None, :]
                out += zip(rep[at].tolist(), wanted[at].tolist(), rep[at][label].tolist(), wanted[at][label].tolist(), near.sum(1).tolist(), many[at].tolist())
            names = ("rep", "print1", "least", "least_print", "links", "open")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (*[pa.int64()] * 5, pa.bool_()))], names)

    return check


def _in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Deals groups of more than size rows to pairs of blocks (i, j); column n has the size of each row's group."""
    blocks = F.ceil(F.col("n") / size)
    dealt = rows.withColumn("blocks", blocks).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other")).drop("other", "n")
    first = [key, "i", "j"]
    return met.select(*first, *[c for c in met.columns if c not in first])


def _filter(keys: DataFrame, key: str) -> Bloom:
    return Bloom(keys, key, min(FILTER_BITS, 1 << max(16, (10 * keys.count()).bit_length())), 5)


def _thinned(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose key is not among keys, so that few whole texts are shuffled to be joined."""
    return rows.where(_filter(keys, key).holds(F.col(key)))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, prints: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, copy_of, n_copies.

    class_id: the least id that the document is connected with by pairs of similarity `threshold` or more; copy_of: the
    least id with the same word sequence and n_copies how many have it; n_links: to how many other word sequences it
    has such a pair. A text of one to four words is one shingle. Null and empty texts have no shingles: a class of
    their own and no links. Repeated rows are copies of each other; a null id has null class and no part in others'.
    prints: further columns tell rows of one id apart: text_print and word_print, hashes of the text and its word sequence,
    and first, whether the word sequence is the first of its class.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text_print = F.xxhash64(F.coalesce("text", F.lit(""))) if prints else F.lit(0).cast("long")
    signed = shared.stored(chosen.withColumn("text_print", text_print).mapInArrow(_sign, "doc_id long, text_print long, print1 long, print2 long, signature binary"), "neardup-signed")
    whole = signed.where(F.col("doc_id").isNotNull() & F.col("print1").isNotNull())
    classes = shared.stored(
        whole.groupBy("print1", "print2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("signature").alias("signature")),
        "neardup-classes",
    )
    edges = _candidates(classes, threshold, target_recall)
    parts = connected_components(edges.where("a != b")).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    # near copies of one id alone
    alone = edges.where("a = b").select(F.col("a").alias("rep"), F.col("a").alias("part")).distinct()
    parts = parts.union(alone.join(parts.select("rep"), "rep", "left_anti"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    wanted = parts.join(sizes, "part").join(classes.select("rep", "print1"), "rep")
    wanted = shared.stored(wanted, "neardup-wanted")
    texts = _thinned(chosen.withColumnRenamed("doc_id", "rep"), "rep", wanted).join(wanted, "rep")
    blocks = _in_blocks(texts, "part", CHECK_BLOCK).select("part", "i", "j", "rep", "print1", "salt", "blocks", "text")
    sorted_blocks = blocks.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "rep", "print1")
    checked = shared.stored(sorted_blocks.mapInArrow(_check(threshold, WORDS), "rep long, print1 long, least long, least_print long, links long, open boolean"), "neardup-checked")
    labels = checked.groupBy("rep", "print1").agg(F.sum("links").alias("links"), F.min(F.struct("least", "least_print")).alias("low"))
    labels = labels.select("rep", "print1", "links", "low.least", "low.least_print")
    still = checked.where("open and rep != least")
    if not still.isEmpty():
        joined = connected_components(still.select(F.col("rep").alias("a"), F.col("least").alias("b")))
        labels = labels.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "print1", "links", F.coalesce("component", "least").alias("least"), F.expr("if(component < least, null, least_print)").alias("least_print"))
    named = classes.select("print1", "print2", "rep", "copies").join(labels, ["rep", "print1"], "left")
    found = signed.select("doc_id", "text_print", "print1", "print2").join(named, ["print1", "print2"], "left")
    own = F.col("doc_id")
    first = (own.isNull()) | ((own == F.coalesce("least", "rep", own)) & F.coalesce(F.col("least_print") == F.col("print1"), F.lit(True)))
    return found.select(
        own, F.when(own.isNotNull(), F.coalesce("least", "rep", own)).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(own.isNotNull(), F.coalesce("rep", own)).alias("copy_of"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        *(["text_print", F.col("print1").alias("word_print"), first.alias("first")] if prints else []),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, one for each class: that of the least id; of repeated rows one stays.

    Rows of one id with different texts are told apart: each goes or stays by its own text. Rows with a null id stay. Only
    rows whose id has something to lose are shuffled, and those that a filter takes for such.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, prints=True).where("doc_id is not null")
    own, turn = "__print", "__turn"
    while {own, own + "id", turn} & {c.lower() for c in docs.columns}:
        own, turn = own + "_", turn + "_"
    rows = shared.stored(found.select("doc_id", "text_print", "word_print", "first"), "neardup-found")
    losing = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("first").alias("stays")).where("n > 1 or not stays").select("doc_id")
    losing = shared.stored(losing, "neardup-losing")
    kept = rows.join(losing, "doc_id", "left_semi").where("first").groupBy("doc_id", "text_print").agg(F.any_value("word_print").alias(turn))
    kept = kept.select(F.col("doc_id").alias(own + "id"), F.col("text_print").alias(own), turn)
    doc_id = F.col(id_col).cast("long")
    loses = F.coalesce(_filter(losing, "doc_id").holds(doc_id), F.lit(False))
    safe, judged = docs.where(~loses), docs.where(loses)
    text_print = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    others = judged.join(losing.select(F.col("doc_id").alias(own + "id")), doc_id == F.col(own + "id"), "left_anti")
    met = judged.join(kept, (doc_id == F.col(own + "id")) & (text_print == F.col(own)))
    ranked = met.withColumn(turn, F.row_number().over(Window.partitionBy(own + "id", turn).orderBy(own)))
    return safe.union(others).union(ranked.where(F.col(turn) == 1).select(*docs.columns))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents; odd rows as near_duplicates() says. Texts of any length are
    read whole; an empty table gives an empty one; other columns are ignored."""
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
