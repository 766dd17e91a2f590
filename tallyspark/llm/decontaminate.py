"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequences and answer checks.

1. The vocabulary is that of the benchmark; how many documents hold each of its words is counted over all documents.
2. The latent space comes from a randomised SVD of the benchmark's TF-IDF passages, whose products are summed over
   partitions.
3. Documents are cut into overlapping windows, of a length for each class of passage lengths, so that any passage lies
   whole in one of them. All windows are folded into the latent space and compared with all passages of their class: those
   whose cosine reaches COSINE, and that hold enough of the passage's latent weight, are candidates.
4. A candidate is a leak if its longest common subsequence with the passage covers most of the passage or, for paraphrases, a
   good part of it, and there with the answer, where the benchmark has answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import shared

#: Passages of one latent space, and characters of the passages that are looked for in one pass over the documents.
BLOCK_ITEMS, LOT_CHARS = 256, 1 << 20
RANK, EXTRA, POWERS = 128, 10, 2
#: A candidate's cosine, in which the window's whole TF-IDF norm counts, and its share of the passage's latent weight; a
#: share of FULL is enough alone.
COSINE, SHARE, FULL = 0.25, 0.3, 0.8
#: Parts of a passage that a leak's common subsequence covers: alone, and together with the answer if there is one.
VERBATIM, PARAPHRASE = 0.7, 0.45
#: A paraphrase has so many words in common at least. Passages of fewer than SHORT words must be there in full.
LEAST_COMMON, SHORT = 6, 8
#: The part of an answer's words that show it.
ANSWERED = 2 / 3
#: Blocks of words that are compared at a time, and up to which a slice's sums are held to add up the next class's.
CHUNK, HELD = 1 << 13, 1 << 16
FIELDS = ("item_id", "cosine", "common", "words", "first_word")
KIND = "array<struct<item_id:bigint,cosine:double,common:int,words:int,first_word:int>>"


def places(passage: np.ndarray) -> dict[int, int]:
    """For each word of a passage the bits of its positions."""
    found: dict[int, int] = {}
    for k, w in enumerate(passage.tolist()):
        found[w] = found.get(w, 0) | (1 << k)
    return found


def common_subsequence(places: dict[int, int], n: int, window: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence of a passage of n words and a window, by bit vectors over the passage; 0 if below least."""
    bits = [places[w] for w in window if w in places]
    if len(bits) < least:
        return 0
    full = (1 << n) - 1
    state = full
    for m in bits:
        u = state & m
        state = ((state + u) | (state - u)) & full
    found = n - state.bit_count()
    return found if found >= least else 0


def length_class(n: int) -> int:
    """The power of two, 4 at least, up to which a class of passage lengths goes."""
    return max(4, 1 << (n - 1).bit_length())


@dataclass
class Model:
    """A latent space of some passages."""

    vocabulary: np.ndarray  # sorted hashes of words
    idf: np.ndarray
    items: np.ndarray  # ids
    passages: list[np.ndarray]  # word numbers
    answers: list[np.ndarray]  # the same; empty where the benchmark has none
    fold: np.ndarray | None = None  # vocabulary x (rank + 1): latent weights, with idf, and the idf's square
    latent: np.ndarray | None = None  # unit rows
    weight: np.ndarray | None = None  # what their lengths were
    places: list[dict[int, int]] = field(default_factory=list)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else np.full(len(hashes), -1)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Unit TF-IDF rows of some passages."""
        out = np.zeros((len(which), len(self.vocabulary)))
        for k, i in enumerate(which):
            np.add.at(out[k], self.passages[i], self.idf[self.passages[i]])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def settle(self, right: np.ndarray) -> None:
        """Takes the right singular vectors and places the passages in their space."""
        self.fold = np.hstack([self.idf[:, None] * right, self.idf[:, None] ** 2]).astype(np.float32)
        latent = np.stack([self.fold[p, :-1].sum(0) for p in self.passages])
        self.weight = np.maximum(np.linalg.norm(latent, axis=1), 1e-6)
        self.latent = latent / self.weight[:, None]
        self.places = [places(p) for p in self.passages]

    def leaks(self, words: shared.Words, number: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """Each leak once: row, item, cosine, length of the common subsequence, words of the passage, first word."""
        best: dict[tuple[int, int], tuple] = {}
        for d, i, cosine, a, b in self.near(words, number):
            got = self.compare(i, number[a:b].tolist())
            if got and got > best.get((d, i), (0,) * 4)[3]:
                best[d, i] = (d, int(self.items[i]), cosine, got, len(self.passages[i]), int(a - words.first[d]))
        return list(best.values())

    def near(self, words: shared.Words, number: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """Candidates: row, passage, cosine, and the words from and up to which the window goes.

        Windows are three blocks of half the length of a class of passages; all of them are folded.
        """
        sizes = np.array([length_class(len(p)) for p in self.passages])
        at = np.flatnonzero(number >= 0)
        doc_of, into = words.doc[at], at - words.first[words.doc[at]]
        held: tuple[int, np.ndarray, np.ndarray] | None = None  # the last class's step, places of texts, and sums
        for size in np.unique(sizes).tolist():
            items, step = np.flatnonzero(sizes == size), size // 2
            blocks = -(-words.count // step)
            begin = np.cumsum(blocks + 2) - blocks - 2  # two empty blocks behind each text
            block = begin[doc_of] + into // step
            doc = np.repeat(np.arange(words.n_docs), blocks + 2)
            own = np.arange(len(doc)) - begin[doc]
            sums = None
            if len(doc) + 2 <= HELD:
                if held and held[0] * 2 == step:  # two of the last class's blocks make one
                    first = held[1][doc] + np.minimum(2 * own, -(-words.count // held[0])[doc])
                    sums = np.zeros((len(doc) + 2, self.fold.shape[1]), np.float32)
                    sums[:-2] = held[2][first] + held[2][first + 1]
                else:
                    sums = self._sums(number[at], block, 0, len(doc) + 2)
            held = (step, begin, sums) if sums is not None else None
            starts = (blocks[doc] > 0) & (own < np.maximum(blocks[doc] - 2, 1))
            short = np.array([len(self.passages[i]) < SHORT for i in items])
            least_cosine, least_share = np.where(short, 0, COSINE).astype(np.float32), np.where(short, FULL / 2, SHARE).astype(np.float32)
            latent, weight = self.latent[items].T.astype(np.float32), self.weight[items].astype(np.float32)
            for low in range(0, len(doc), CHUNK):
                high = min(low + CHUNK, len(doc))
                if sums is not None:
                    some = sums[low : high + 2]
                else:
                    s, e = np.searchsorted(block, [low, high + 2])
                    some = self._sums(number[at[s:e]], block[s:e] - low, 0, high - low + 2)
                window = some[:-2] + some[1:-1] + some[2:]
                dot, norm = window[:, :-1] @ latent, np.sqrt(window[:, -1:])
                found = ((dot >= least_cosine * norm) & (dot >= least_share * weight)) | (dot >= FULL * weight)
                row, which = np.nonzero(found & starts[low:high, None])
                cosine = dot[row, which] / np.maximum(norm[row, 0], 1e-6)
                d = doc[low + row]
                a = words.first[d] + own[low + row] * step
                b = np.minimum(a + 3 * step, words.first[d + 1])
                yield from zip(d.tolist(), items[which].tolist(), cosine.tolist(), a.tolist(), b.tolist())

    def _sums(self, word: np.ndarray, block: np.ndarray, low: int, high: int) -> np.ndarray:
        """The latent sums of blocks low to high of words in order of their blocks."""
        out = np.zeros((high - low, self.fold.shape[1]), np.float32)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for k in range(0, len(first), 512):  # few enough words at a time to stay in the cache
            stop = first[k + 512] if k + 512 < len(first) else len(word)
            out[block[first[k : k + 512]] - low] = np.add.reduceat(self.fold[word[first[k] : stop]], first[k : k + 512] - first[k])
        return out

    def compare(self, item: int, window: list[int]) -> int:
        """The length of the common subsequence if it makes a leak, else 0."""
        n, answer = len(self.passages[item]), self.answers[item]
        common = common_subsequence(self.places[item], n, window, n if n < SHORT else min(n * VERBATIM, max(n * PARAPHRASE, LEAST_COMMON)))
        if not common or n < SHORT or common >= VERBATIM * n:
            return common
        return common if np.isin(answer, window).sum() >= ANSWERED * len(answer) else 0


@dataclass
class Lot:
    """Models whose passages are looked for in one pass."""

    models: list[Model] = field(default_factory=list)

    def leaks(self, column: pa.LargeStringArray) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text its leaks, by FIELDS."""
        out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in range(len(column))]
        words = shared.Words(column)
        hashes = words.hashes()
        for model in self.models:
            for d, *leak in model.leaks(words, model.numbers(hashes)):
                out[d].append(tuple(leak))
        return out


def _partial(rows: DataFrame, work, width: int) -> np.ndarray:
    """Sums a vector of float64 that work(batch) gives over all batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += work(batch)
        yield pa.RecordBatch.from_pydict({"at": np.flatnonzero(total), "v": total[np.flatnonzero(total)]})

    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # width rows at most
    out = np.zeros(width)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def _svd(spark: SparkSession, model: Model) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the passages' TF-IDF rows, by a randomised range finder."""
    n, width = len(model.items), len(model.vocabulary)
    rank = min(RANK, n, width)
    sketch = min(rank + EXTRA, n, width)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((width, sketch)))[0]
    parts = max(1, min(8, -(-n // 64)))
    numbered = spark.range(n, numPartitions=parts)
    for _ in range(POWERS + 1):
        now = basis

        def product(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, sketch))
            for batch in batches:
                rows = model.rows(batch.column(0).to_numpy())
                total += rows.T @ (rows @ now)
            yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

        total = np.zeros((width, sketch))
        for r in numbered.mapInArrow(product, "sum binary").toLocalIterator():  # one matrix per partition, 8 at most
            total += np.frombuffer(r["sum"]).reshape(width, sketch)
        basis = np.linalg.qr(total)[0]
    small = basis.T @ total  # of A'A in the basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(values)[::-1][:rank]]


def fit(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", passage_col: str = "text", answer_col: str | None = None) -> list[Lot]:
    """Models of BLOCK_ITEMS passages each, in lots of about LOT_CHARS characters, each of which takes a pass over docs here
    and one when it is looked for. Passages without words, or with a null id, are left out; repeated ones count once."""
    spark = docs.sparkSession
    answer = F.col(answer_col) if answer_col else F.lit(None)
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(passage_col).alias("text"), answer.cast("string").alias("answer")).where("id is not null and text is not null").distinct()
    n_lots = max(1, -(-int(rows.agg(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0) // LOT_CHARS))
    lots = []
    for k in range(n_lots):
        some = rows if n_lots == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_lots)) == k)
        got = some.toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("answer", "ascending")])  # about LOT_CHARS characters
        words, answers = shared.Words(shared.texts(got["text"])), shared.Words(shared.texts(got["answer"]))
        hashes, of_answer, ids = words.hashes(), answers.hashes(), got["id"].to_numpy()
        has = np.flatnonzero(words.count)
        if not len(has):
            continue
        known = np.unique(np.concatenate([hashes, of_answer]))

        def frequencies(batch: pa.RecordBatch, known: np.ndarray = known) -> np.ndarray:
            total = np.zeros(len(known) + 1)
            column = shared.texts(batch.column(0))
            for a, b in shared.slices(column):
                words = shared.Words(column.slice(a, b - a))
                hashes = words.hashes()
                number = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                inside = known[number] == hashes
                both = np.unique(words.doc[inside] * len(known) + number[inside])
                total[:-1] += np.bincount(both % len(known), minlength=len(known))
            total[-1] = len(column)
            return total

        seen = _partial(docs.select(text_col), frequencies, len(known) + 1)
        idf = np.log((2 + seen[-1]) / (1 + seen[:-1])) + 0.01
        lot = Lot()
        for block in np.array_split(has, -(-len(has) // BLOCK_ITEMS)):
            own = [hashes[words.first[i] : words.first[i + 1]] for i in block]
            of_own = [of_answer[answers.first[i] : answers.first[i + 1]] for i in block]
            vocabulary = np.unique(np.concatenate([*own, *of_own]))
            model = Model(vocabulary, idf[np.searchsorted(known, vocabulary)], ids[block], [], [])
            model.passages = [model.numbers(x) for x in own]
            model.answers = [np.unique(model.numbers(x)) for x in of_own]
            model.settle(_svd(spark, model))
            lot.models.append(model)
        lots.append(lot)
    return lots


def leaks(lot: Lot, text: Column) -> Column:
    """The leaks of each text, as KIND; null and empty texts have none."""

    @F.arrow_udf(KIND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.int32()), ("words", pa.int32()), ("first_word", pa.int32())]))
        for batch in batches:
            column, out = shared.texts(batch), []
            for a, b in shared.slices(column):
                out += [[dict(zip(FIELDS, x)) for x in own] for own in lot.leaks(column.slice(a, b - a))]
            yield pa.array(out, kind)

    return found(text)


def decontaminate(docs: DataFrame, lots: list[Lot], *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in which no lot finds a leak; null and empty texts stay, repeated rows go or stay alike."""
    own = "__leaks"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    for lot in lots:
        docs = docs.withColumn(own, F.size(leaks(lot, F.col(text_col)))).where(F.col(own) == 0).drop(own)
    return docs


def find_leaks(docs: DataFrame, lots: list[Lot], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, common, words, first_word: one row per document and passage that it holds."""
    out = None
    for lot in lots:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(leaks(lot, F.col(text_col))).alias("leak")).select("doc_id", "leak.*")
        out = rows if out is None else out.union(rows)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common int, words int, first_word int")
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark in every document.

    Null and empty texts have no leaks; long ones are read whole, window by window. Repeated rows each report; an empty
    benchmark, or an empty table of documents, gives no rows; other columns are ignored. Of a passage that occurs more
    than once in a document, the place with the longest common subsequence is given, the first of equal ones.
    """
    docs = shared.table(spark, sf_dir, "documents")
    return find_leaks(docs, fit(docs, shared.table(spark, sf_dir, "benchmark")))
