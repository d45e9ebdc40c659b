"""Language identification by nearest centroid.

A text is a vector of its letter n-grams, hashed to ``BINS`` bins, with log counts times IDF, normalised. Each language has
several centroids, found by spherical k-means on a bounded sample of its labelled texts. The language is that of the nearest
centroid by cosine; a text further from it than the language's labelled texts are is marked as rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tracewell.llm._shared import bound_batches, release, unit_hash

BINS = 1 << 12
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """1 for the code points that are letters."""
    out = np.zeros(0x110000, bool)
    out[[k for k in range(0x110000) if chr(k).isalpha()]] = True
    return out


_IS_LETTER: np.ndarray | None = None


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of the text's letter bigrams and trigrams by bin, word ends included, and its number of letters."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = _letters()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _IS_LETTER[codes]
    n = int(letter.sum())
    if not n:
        return np.zeros(BINS), 0
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint32)
    keep = (codes[1:] != 0) | (codes[:-1] != 0)  # runs of other characters count as one word end
    codes = codes[np.concatenate([[True], keep])]
    two = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) ^ codes[2:] * np.uint32(0x27D4EB2F)
    bins = np.concatenate([two ^ two >> 15, three ^ three >> 13]) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 12)
    return np.bincount(bins, minlength=BINS), n


@dataclass
class CentroidModel:
    idf: np.ndarray
    centroids: np.ndarray  # (number, BINS)
    languages: list[str]  # of each centroid
    least: np.ndarray  # of each centroid's language: cosine below which a text is rejected

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / (np.linalg.norm(v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected). ``und`` and rejected for null, texts without letters or no model."""
        counts, n = ngram_counts(text) if text else (None, 0)
        if not n or not self.languages:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ self.vector(counts).astype(np.float32)
        k = int(cosine.argmax())
        return self.languages[k], float(min(1.0, max(0.0, cosine[k]))), bool(cosine[k] < self.least[k])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from centres that are far apart."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[(x @ np.stack(centres).T).max(1).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_centroids(texts: list[str], languages: list[str], per_language: int = 4) -> CentroidModel:
    counted = [(ngram_counts(t), lang) for t, lang in zip(texts, languages, strict=True)]
    kept = [(c, n, lang) for (c, n), lang in counted if n]
    if not kept:
        return CentroidModel(np.ones(BINS), np.zeros((0, BINS), np.float32), [], np.zeros(0))
    raw = np.stack([c for c, _, _ in kept])
    model = CentroidModel(np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1, np.zeros((0, BINS), np.float32), [], np.zeros(0))
    x = np.log1p(raw) * model.idf
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    lang = np.array([v for _, _, v in kept])
    sets, names, least = [], [], []
    for name in sorted(set(lang.tolist())):
        own = x[lang == name]
        c = _kmeans(own, per_language)
        near = np.sort((own @ c.T).max(1))
        sets.append(c)
        names += [name] * len(c)
        least += [0.5 * float(near[int(0.005 * len(near))])] * len(c)
    model.centroids, model.languages, model.least = np.concatenate(sets).astype(np.float32), names, np.array(least)
    return model


def labelled_texts(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` texts of each language, chosen by a hash of the id; all of a language that has fewer."""
    known = docs.where("lang is not null and text is not null")
    shares = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    chosen = known.join(F.broadcast(shares), "lang").where(unit_hash("doc_id") < F.col("share"))  # a row per language
    return chosen.select("doc_id", "lang", "text")


def fitted(sample: DataFrame, per_language: int) -> CentroidModel:
    """The model fitted on ``sample`` (doc_id, lang, text), whose size is bounded, in one task; the driver gets the centroids."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        model = fit_centroids([t for *_, t in rows], [lang for _, lang, _ in rows], per_language)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = sample.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(made.model) if made else fit_centroids([], [], per_language)


def identify_language(docs: DataFrame, training: DataFrame, sample_per_language: int = 600, per_language: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected and the columns ``carry`` for every row of ``docs``, with a model fitted on rows of ``training`` (doc_id, text, lang).

    About ``sample_per_language`` texts of each language are used and must fit one task. Texts that are null or have no letter
    give ``und``, score 0, rejected. Ties between centroids go to the first language. Repeated rows and null ids are kept; an
    empty table gives no rows; without any labelled text all are ``und``. Extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_texts(training, sample_per_language), per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, *batch.columns[2:]], names=["doc_id", "lang_pred", "score", "rejected", *carry])

    made = {"doc_id": LongType(), "lang_pred": StringType(), "score": DoubleType(), "rejected": BooleanType()} | {c: docs.schema[c].dataType for c in carry}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    return rows.mapInArrow(run, StructType([StructField(k, v) for k, v in made.items()]))
