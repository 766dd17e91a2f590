"""Language identification: nearest of several clustered TF-IDF centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import labelled, shared

BITS = 12
WIDTH = 1 << BITS
#: Labelled documents that centroids are clustered from: of each language, and of all together, at most.
PER_LANGUAGE, ALL_LANGUAGES = 300, 3000
CENTROIDS = 3
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
#: Signs of a letter category; numbers that Unicode writes with letters are none.
_HAS_LETTER = regex.compile(r"\p{L}")
#: Texts that are counted at a time, each of which takes WIDTH numbers.
ROWS = 512


def counts(column: pa.LargeStringArray) -> np.ndarray:
    """Hashed counts of byte n-grams (1 to 3) of the lowered texts, other characters than letters as spaces."""
    data, offsets = shared.raw(pc.utf8_lower(column))
    clean = np.where(_LETTER[data], data, 32).astype(np.uint32)
    n = len(offsets) - 1
    base = np.repeat(np.arange(n) << BITS, np.diff(offsets))
    out = np.zeros(n * WIDTH, np.int64)
    code = clean
    for size in (1, 2, 3):
        if size > 1:
            code = (code[:-1] << np.uint32(8)) | clean[size - 1 :]
        hashed = ((code + np.uint32(size << 28)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        solid = (clean[: len(code)] != 32) | (clean[size - 1 :] != 32)
        same = base[: len(code)] == base[size - 1 :]
        keep = solid & same
        out += np.bincount(base[: len(code)][keep] + hashed[keep], minlength=n * WIDTH)
    return out.reshape(n, WIDTH)


def vectors(column: pa.LargeStringArray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a text without letters has zeros."""
    x = counts(column).astype(np.float32) * idf  # counts as they are, so that most of a mixed text decides
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centre: np.ndarray  # centroids x WIDTH, of length 1
    language: np.ndarray  # the language of each centroid
    reach: np.ndarray  # the cosine below which a text counts as too far from it

    def predict(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest centroid's language, its cosine (0 to 1), and whether it is too far."""
        likeness = vectors(column, self.idf) @ self.centre.T
        best = likeness.argmax(1)
        found = likeness[np.arange(len(best)), best]
        return self.language[best], np.clip(found, 0, 1), found < self.reach[best]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; returns unit centroids."""
    mean = x.mean(0)
    centres = [x[(x @ mean).argmax()]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.max(x @ np.stack(centres).T, axis=1).argmin()])
    centre = np.stack(centres)
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


def fit(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, k: int = CENTROIDS, slack: float = 0.5) -> Centroids | None:
    """Document frequencies from all rows, centroids from a bounded sample; None if no row has a language.

    A text is too far from a centroid if its cosine is below slack times the 1 % quantile of the centroid's own texts.
    """
    named = rows.where(F.col(lang_col).isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            column = shared.texts(batch.column(0))
            for a, b in shared.slices(column, rows=ROWS):
                seen += (counts(column.slice(a, b - a)) > 0).sum(0)
            n += len(column)
        if n:
            yield pa.RecordBatch.from_pydict({"feature": np.arange(WIDTH + 1), "n": np.append(seen, n)})

    found = np.zeros(WIDTH + 1)
    partial = named.select(text_col).mapInArrow(frequencies, "feature long, n long")
    for r in partial.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # WIDTH + 1 rows
        found[r["feature"]] = r["n"]
    if not found[-1]:
        return None
    idf = (np.log((1 + found[-1]) / (1 + found[:-1])) + 0.05).astype(np.float32)
    n_languages = named.select(lang_col).distinct().count()
    chosen = labelled.sample(named, id_col, lang_col, max(1, min(per_language, ALL_LANGUAGES // n_languages)))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = shared.texts(batch.column(2))
            for a, b in shared.slices(column, rows=ROWS):
                own = batch.slice(a, b - a)
                x = vectors(column.slice(a, b - a), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "label", "x"])

    # the language of each text is the one on its own row, so a repeated id can't mix them up
    texts = named.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    sampled = texts.join(F.broadcast(chosen), ["id", "label"]).select(F.col("id").cast("long"), F.col("label").cast("string"), "text")
    got = sampled.mapInArrow(embed, "id long, label string, x binary").toPandas().sort_values(["label", "id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, WIDTH).astype(np.float32)
    label = got["label"].to_numpy()
    languages, centres, owner, reach = sorted(set(label)), [], [], []
    for i, name in enumerate(languages):
        own = x[label == name]
        own = own[own.any(1)]
        if not len(own):
            continue
        centre = cluster(own, k)
        nearest, best = (own @ centre.T).argmax(1), (own @ centre.T).max(1)
        for c in range(len(centre)):
            mine = best[nearest == c]
            reach.append(slack * np.quantile(mine if len(mine) else best, 0.01))
            centres.append(centre[c])
            owner.append(i)
    if not centres:
        return None
    return Centroids(languages, idf, np.stack(centres).astype(np.float32), np.array(owner), np.array(reach))


def detect(model: Centroids | None, text: Column) -> Column:
    """struct<lang, score, rejected>; `und` and 0 if the text is null or has no letter. rejected: too far from all centroids."""

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def detected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            column, lang, score, far = shared.texts(batch), [], [], []
            for a, b in shared.slices(column, rows=ROWS):
                some = column.slice(a, b - a)
                if model is None:
                    lang += [UNKNOWN] * (b - a)
                    score.append(np.zeros(b - a))
                    far.append(np.ones(b - a, bool))
                    continue
                which, found, away = model.predict(some)
                letter = np.fromiter((bool(_HAS_LETTER.search(t)) for t in some.to_pylist()), bool, b - a)
                lang += [model.languages[w] if has else UNKNOWN for w, has in zip(which.tolist(), letter.tolist())]
                score.append(np.where(letter, found, 0.0))
                far.append(away | ~letter)
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(np.concatenate(far) if far else [], pa.bool_())],
                ["lang", "score", "rejected"],
            )

    return detected(text)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of all documents; rows of the fold crc32(doc_id) mod 3 = 1 are not learned from.

    rejected tells that the text lies too far from every centroid; lang_pred then still names the nearest language.
    Without any labelled row every text is `und`, as are null and empty texts and those without a letter. Long texts are
    counted whole. Of equally near centroids the first one wins, by language and then by the order of clustering.
    Repeated rows each get their row, an empty table none; other columns are ignored.
    """
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(labelled.fold("doc_id", 3) != 1))
    held_out = F.coalesce(labelled.fold("doc_id", 3) == 1, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), detect(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
