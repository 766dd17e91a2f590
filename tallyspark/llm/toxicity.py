"""Toxic passages: maximal scoring segments of token log-odds under Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import labelled, shared

#: Labelled rows per class that log-odds and calibration are learned from, at most.
PER_LABEL = 10_000
#: Parts of them, each of which is scored by log-odds of the others for the calibration and the choice of a setting.
FOLDS = 4
#: The settings to choose from: the prior's strength, and the deviations by which log-odds are cut.
SETTINGS = ((0.03, 3.0), (0.1, 3.0), (0.1, 2.0), (0.3, 2.0), (0.3, 1.0), (1.0, 1.0))
BITS = 18
GRAM = 5
THRESHOLD = 0.3


class Tokens:
    """Words of a slice of texts with their hashed features: the word, and its byte 5-grams with the edges marked."""

    def __init__(self, column: pa.LargeStringArray):
        self.words = words = shared.Words(column)
        self.word = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
        data = np.where(shared._WORD_BYTE[words.data], words.data, 32).astype(np.uint64)
        data = np.concatenate([np.array([32], np.uint64), data, np.full(GRAM, 32, np.uint64)])
        code = np.zeros(len(data) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            code = (code << np.uint64(8)) | data[k : len(data) - GRAM + 1 + k]
        # grams of a word begin at the byte before it; a word of n bytes has n - 2 of them, at least one
        self.grams = np.maximum(words.end - words.start + 2 - GRAM + 1, 1)
        self.gram_word = np.repeat(np.arange(len(words.start)), self.grams)
        begin = np.cumsum(self.grams) - self.grams
        self.gram_first = begin
        at = np.arange(int(self.grams.sum())) - np.repeat(begin - words.start, self.grams)
        self.gram = (shared.mix(code[at]) >> np.uint64(64 - BITS)).astype(np.int64)


def log_odds(toxic: np.ndarray, clean: np.ndarray, strength: float, deviations: float) -> np.ndarray:
    """Log-odds of each feature in toxic against clean texts, with an informative Dirichlet prior, less some deviations.

    The prior has the features' shares in all texts and weighs `strength` of their number.
    """
    both = toxic + clean
    prior = strength * both + 1e-3
    n1, n0, n = toxic.sum(), clean.sum(), prior.sum()
    y1, y0 = toxic + prior, clean + prior
    odds = np.log(y1 / (n1 + n - y1)) - np.log(y0 / (n0 + n - y0))
    spread = np.sqrt(1 / y1 + 1 / y0)
    return np.where(both > 0, np.sign(odds) * np.maximum(np.abs(odds) - deviations * spread, 0), 0).astype(np.float32)


def segments(value: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in one pass over the positive items and linear time.

    value: the positive scores in order; before: the running total of all scores, negative ones included, ahead of
    each. A segment ends at positive items, so only those are looked at. Each candidate keeps a link to the nearest one to
    its left with a lesser total ahead of it: those in between can't begin a larger segment and aren't looked at again.
    """
    first: list[int] = []
    ahead: list[float] = []  # the total ahead of each candidate and behind it
    behind: list[float] = []
    link: list[int] = []
    last: list[int] = []
    for k, (v, low) in enumerate(zip(value.tolist(), before.tolist())):
        begin, high, j = k, low + v, len(first) - 1
        while True:
            while j >= 0 and ahead[j] >= low:
                j = link[j]
            if j < 0 or behind[j] >= high:
                break
            begin, low, left = first[j], ahead[j], link[j]  # the candidates from j on become one
            del first[j:], last[j:], ahead[j:], behind[j:], link[j:]
            j = left
        first.append(begin)
        last.append(k)
        ahead.append(low)
        behind.append(high)
        link.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, ahead, behind)]


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    drift: float = 0.0
    rate: float = 1.0  # lambda: the positive root of E exp(lambda s) = 1 over words of clean texts
    place: float = 0.0  # of the Gumbel law of clean texts' statistics
    scale: float = 1.0
    slope: float = 1.0  # of the logistic law over the standardised statistic
    shift: float = 0.0

    def word_scores(self, tokens: Tokens) -> np.ndarray:
        """A word's strongest evidence: its own log-odds or the largest of its grams'; less the drift."""
        if not len(tokens.word):
            return np.zeros(0)
        gram = self.grams[tokens.gram]
        top = np.maximum.reduceat(gram, tokens.gram_first)
        low = np.minimum.reduceat(gram, tokens.gram_first)
        own = self.words[tokens.word]
        best, worst = np.maximum(top, own), np.minimum(low, own)
        return np.where(best > 0, best, worst).astype(np.float64) - self.drift

    def passages(self, column: pa.LargeStringArray) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """For each text its statistic and its significant passages (first word, last word, normalised score).

        A segment's normalised score is lambda S - ln n for n words; the statistic sums those above 0, or is the
        largest one.
        """
        tokens = Tokens(column)
        score, first = self.word_scores(tokens), tokens.words.first
        total = np.concatenate([[0.0], np.cumsum(score)])
        positive = np.flatnonzero(score > 0)
        cuts = np.searchsorted(positive, first)
        out = []
        for d in range(len(column)):
            some = positive[cuts[d] : cuts[d + 1]]
            toll = np.log(max(first[d + 1] - first[d], 1))
            kept, best = [], -toll
            for a, b, s in segments(score[some], total[some]):
                x = self.rate * s - toll
                best = max(best, x)
                if x > 0:
                    kept.append((int(some[a] - first[d]), int(some[b] - first[d]), float(x)))
            out.append((sum(x for *_, x in kept) if kept else best, kept))
        return out

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        """From how extreme the statistic is for a clean text (as -ln of its Gumbel tail) to a chance of toxicity."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self._extremity(statistic) + self.shift, -30, 30)))

    def _extremity(self, statistic: np.ndarray) -> np.ndarray:
        z = np.clip((np.asarray(statistic, float) - self.place) / self.scale, -5, 400)
        tail = -np.expm1(-np.exp(-z))
        return np.where(z > 30, z, -np.log(np.maximum(tail, 1e-300)))


def _root(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive lambda with E exp(lambda s) = 1 (Karlin and Altschul)."""
    weight = weight / max(weight.sum(), 1)
    low, high = 1e-3, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        if (weight * np.exp(np.minimum(mid * score, 700))).sum() > 1:
            high = mid
        else:
            low = mid
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift by Newton steps, with a little ridge."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(float(a), 0.0), float(b)


def _odds(seen: np.ndarray, setting: tuple[float, float]) -> Model:
    """A model without calibration from numbers of texts by (clean or toxic, feature)."""
    return Model(*[log_odds(seen[1, part], seen[0, part], *setting) for part in (slice(0, 1 << BITS), slice(1 << BITS, None))])


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, model: Model) -> float:
    """Sets the laws that lead from the statistic to a chance; returns the weighted logarithmic loss."""
    # Gumbel by quantiles, which a few mislabelled texts don't move
    q1, q2 = np.quantile(x[y == 0], [0.25, 0.75])
    g1, g2 = -np.log(-np.log(0.25)), -np.log(-np.log(0.75))
    model.scale = max((q2 - q1) / (g2 - g1), 0.25)
    model.place = q1 - model.scale * g1
    model.slope, model.shift = _logistic(np.minimum(model._extremity(x), 60), y, weight)
    p = np.clip(model.probability(x), 1e-6, 1 - 1e-6)
    return float(-(weight * np.where(y > 0, np.log(p), np.log(1 - p))).sum() / weight.sum())


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model | None:
    """Learns from about per_label labelled documents of each class; None unless both classes occur.

    The setting with the least loss in a cross-validation over FOLDS parts of these documents is taken, and the statistics
    that the parts got from the others' log-odds calibrate the model; no other document has a say.
    """
    chosen = labelled.sample(labels, id_col, label_col, per_label)
    texts = labelled.with_text(chosen, docs, id_col, text_col).select(F.col("id").cast("long"), F.col("label").cast("int"), "text")
    texts = texts.withColumn("fold", F.pmod(F.hash("id"), F.lit(FOLDS)))
    texts = shared.stored(texts, "toxicity-sample")
    spark = docs.sparkSession
    share = {r["label"]: r["n"] for r in labels.select((F.col(label_col) > 0).alias("label")).dropna().groupBy("label").agg(F.count("*").alias("n")).collect()}
    kinds = [f"n{k}" for k in range(2 * FOLDS)]  # two of each fold: clean and toxic

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2 * FOLDS, 2 << BITS), np.int32)  # texts with each feature
        for batch in batches:
            column, kind = shared.texts(batch.column(2)), (batch.column(1).to_numpy() > 0) + 2 * batch.column(3).to_numpy()
            for a, b in shared.slices(column):
                tokens = Tokens(column.slice(a, b - a))
                doc = tokens.words.doc
                both = np.concatenate([(doc << (BITS + 1)) | tokens.word, (doc[tokens.gram_word] << (BITS + 1)) | tokens.gram | (1 << BITS)])
                both = np.unique(both)
                own = kind[a:b][both >> (BITS + 1)]
                for k in range(2 * FOLDS):
                    seen[k] += np.bincount(both[own == k] & ((2 << BITS) - 1), minlength=2 << BITS).astype(np.int32)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict({"feature": at, **dict(zip(kinds, seen[:, at]))})

    sums = texts.mapInArrow(count, "feature long, " + ", ".join(f"{k} int" for k in kinds)).groupBy("feature")
    got = sums.agg(*[F.sum(k).cast("int").alias(k) for k in kinds]).toArrow()  # 2 << BITS rows at most
    seen = np.zeros((FOLDS, 2, 2 << BITS), np.int32)
    for k, name in enumerate(kinds):
        seen[k // 2, k % 2, got["feature"].to_numpy()] = got[name].to_numpy()
    total = seen.sum(0)
    if not total.any(1).all():
        shared.remove(spark, texts)
        return None
    # where a class is in one part alone, its texts are scored by log-odds that have seen them
    apart = bool(all((total - seen[f]).any(1).all() for f in range(FOLDS)))
    held = spark.sparkContext.broadcast(seen)  # 8 << BITS numbers

    def models() -> dict[int, list[Model]]:
        own = held.value
        return {f: [_odds(own.sum(0) - own[f] if apart else own.sum(0), x) for x in SETTINGS] for f in range(FOLDS)}

    def by_fold(batch: pa.RecordBatch, text: int, fold: int) -> Iterator[tuple[int, pa.RecordBatch, pa.LargeStringArray]]:
        which = batch.column(fold).to_numpy()
        for f in np.unique(which).tolist():
            own = batch.take(pa.array(np.flatnonzero(which == f)))
            column = shared.texts(own.column(text))
            for a, b in shared.slices(column):
                yield f, own.slice(a, b - a), column.slice(a, b - a)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or models()
            for f, _, column in by_fold(batch, 0, 1):
                tokens = Tokens(column)
                for k, model in enumerate(known[f]):
                    value, n = np.unique(np.round(model.word_scores(tokens), 2), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"fold": np.full(len(n), f), "setting": np.full(len(n), k), "value": value, "n": n})

    clean = texts.where(F.col("label") <= 0).select("text", "fold")
    law = clean.mapInArrow(spread, "fold long, setting long, value double, n long").groupBy("fold", "setting", "value").agg(F.sum("n").alias("n")).toPandas()  # values of two decimals
    laws: dict[tuple[int, int], tuple[float, float]] = {}
    for f in range(FOLDS):
        for k in range(len(SETTINGS)):
            own = law[(law["fold"] == f) & (law["setting"] == k)]
            value, n = own["value"].to_numpy(), own["n"].to_numpy().astype(float)
            # the drift makes a word of a clean text cost a little on average, as the law of maximal segments asks for
            drift = max(0.05, float((value * n).sum() / max(n.sum(), 1)) + 0.1)
            laws[f, k] = drift, _root(value - drift, n) if len(n) else 1.0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if known is None:
                known = models()
                for (f, k), (drift, rate) in laws.items():
                    known[f][k].drift, known[f][k].rate = drift, rate
            for f, own, column in by_fold(batch, 2, 3):
                found = np.array([[x for x, _ in model.passages(column)] for model in known[f]])
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(x, pa.float64()) for x in found)], ["id", "label", *xs])

    xs = [f"x{k}" for k in range(len(SETTINGS))]
    rows = texts.mapInArrow(measure, "id long, label int, " + ", ".join(f"{x} double" for x in xs)).toPandas().sort_values(["id", "label", *xs])
    shared.remove(spark, texts)
    y = (rows["label"].to_numpy() > 0).astype(float)
    weight = np.where(y > 0, share.get(True, 1) / max(y.sum(), 1), share.get(False, 1) / max((1 - y).sum(), 1))
    weight *= len(y) / weight.sum()
    best, least = None, np.inf
    for k, setting in enumerate(SETTINGS):
        trial = Model(np.zeros(0), np.zeros(0))
        loss = _calibrate(rows[xs[k]].to_numpy(), y, weight, trial)
        if loss < least:
            best, least = (k, setting, trial), loss
    k, setting, trial = best
    model = _odds(total, setting)
    model.drift, model.rate = (float(np.mean([laws[f, k][i] for f in range(FOLDS)])) for i in range(2))
    model.place, model.scale, model.slope, model.shift = trial.place, trial.scale, trial.slope, trial.shift
    held.unpersist()
    return model


_KIND = "struct<score:double,passages:array<struct<first_word:int,last_word:int,evidence:double>>>"


def score(model: Model | None, text: Column) -> Column:
    """struct<score, passages> of each text; null counts as empty. Without a model all scores are 0."""

    @F.arrow_udf(_KIND)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        passage = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("evidence", pa.float64())])
        for batch in batches:
            column, found = shared.texts(batch), []
            for a, b in shared.slices(column):
                found += model.passages(column.slice(a, b - a)) if model else [(0.0, [])] * (b - a)
            chance = np.minimum(model.probability(np.minimum([x for x, _ in found], 1e6)), 1.0) if model and found else np.zeros(len(found))
            spans = pa.array([[dict(zip(("first_word", "last_word", "evidence"), p)) for p in kept] for _, kept in found], pa.list_(passage))
            yield pa.StructArray.from_arrays([pa.array(chance, pa.float64()), spans], ["score", "passages"])

    return scored(text)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; labels of the fold crc32(doc_id) mod 4 = 2 are not learned from.

    Null and empty texts score as texts without words; long ones are read whole; repeated rows each get their row, an empty
    table none; other columns are ignored. Equal segments side by side stay apart. passages: every significant toxic
    passage by word positions.
    """
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(labelled.fold("doc_id", 4) != 2))
    held_out = F.coalesce(labelled.fold("doc_id", 4) == 2, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), score(model, F.col("text")).alias("found"))
    scored = found.select("doc_id", "held_out", F.col("found.score").alias("score"), F.col("found.passages").alias("passages"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
