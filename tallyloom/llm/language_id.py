"""Language identification by nearest centroid.

A text becomes hashed letter n-grams of one to three code points, weighted by
TF-IDF and normalised.  Each language has several centroids, found by spherical
k-means; the nearest by cosine names the language, and a text that is further
from every centroid than training texts of about its length are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import smallest_hashes, tidy
from tallyloom.scratch import cut

DIMENSIONS = 1 << 14
UNKNOWN = "und"
#: Sizes of texts, as powers of two of their n-grams, that have limits of their own.
SIZES = 20
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased letters and their counts.  Runs of other
    characters are one blank; a text without letters has no n-grams."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.uint64)
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = np.concatenate([[0], codes[keep], [0]]).astype(np.uint64)
    found, mixed = [], np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        mixed = (mixed[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        found.append((mixed >> np.uint64(40)) % np.uint64(DIMENSIONS))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=DIMENSIONS)
    places = np.flatnonzero(counts)
    return places, counts[places]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return _weighted(*gram_counts(text), self.idf)

    def measure(self, batches):
        """Language, size and cosine to the nearest own centroid of training texts."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["places"]:
                    counts = np.array(r["counts"])
                    places, weights = _weighted(np.array(r["places"]), counts, self.idf)
                    own = self.centroids[places][:, self.owner == self.languages.index(r["lang"])]
                    rows.append((r["lang"], _size(counts), float((weights @ own).max())))
            lang, size, cosine = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(cosine, pa.float64())], names=["lang", "size", "cosine"]
            )

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether it is rejected."""
        places, counts = gram_counts(text)
        places, weights = _weighted(places, counts, self.idf)
        if not len(places) or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = weights @ self.centroids[places]
        k = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[k])))
        return self.languages[self.owner[k]], score, score < self.least[self.owner[k], _size(counts)]


def _weighted(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = ((1 + np.log(np.maximum(counts, 1))) * idf[places]).astype(np.float32)
    return places, weights / max(float(np.sqrt((weights**2).sum())), 1e-12)


def _size(counts: np.ndarray) -> int:
    return min(SIZES, int(counts.sum()).bit_length()) - 1


def _document_frequencies(batches):
    total, seen = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            places, _ = gram_counts(text)
            total[places] += 1
            seen += bool(len(places))
    places = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(places, -1), pa.int64()), pa.array(np.append(total[places], seen), pa.int64())], names=["place", "n"]
    )


def _grams(batches):
    """N-grams of texts and of their beginnings, which stand for shorter texts."""
    for batch in batches:
        lang, whole, found = [], [], []
        for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = [n for n in (1 << i for i in range(3, SIZES)) if n < len(text)]
            for n in [*ends, len(text)]:
                lang.append(name)
                whole.append(n == len(text))
                found.append(gram_counts(text[:n]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lang, pa.string()), pa.array(whole, pa.bool_()),
                pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64())),
            ],
            names=["lang", "whole", "places", "counts"],
        )


def _dense(sample: pa.Table, idf: np.ndarray) -> np.ndarray:
    """The unit vectors of one language's texts, by their n-grams' lists as they
    come from Arrow: Python's numbers would take the driver several times that."""
    vectors = np.zeros((sample.num_rows, DIMENSIONS), np.float32)
    for row, places, counts in zip(vectors, sample.column("places"), sample.column("counts"), strict=True):
        at, weights = _weighted(places.values.to_numpy(), counts.values.to_numpy(), idf)
        row[at] = weights
    return vectors


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means from spread-out starts."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen]
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == j].sum(axis=0) if (nearest == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def fit_languages(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 400, clusters: int = 4, slack: float = 0.5, quantile: float = 0.02,
) -> Model:
    """Fit on rows where ``learn`` holds and the language is not null.

    Document frequencies come from all of these rows.  Centroids come from
    ``per_language`` documents of each language, or all where there are fewer:
    those with the smallest hashes of id and text, which bounds what reaches the
    driver.  ``slack`` times a low quantile of the cosines of a language's
    training texts, and of beginnings of them, of one size is the limit of
    rejection for texts of that size; so neither an odd training text nor a
    short clean text decides for the others.

    Rows with a null id count where ``learn`` holds for them.  Rows that repeat
    count each.  Null texts and texts without a letter teach nothing, and a
    language of which only such were chosen is not learned.  An empty table
    gives a model that knows no language; other columns are ignored.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = rows.select("text").mapInArrow(tidy(_document_frequencies), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    place, n = (c.to_numpy() for c in totals.toArrow().columns)  # one row for each of the dimensions
    frequency, seen = np.zeros(DIMENSIONS), int(n[place < 0].sum())
    frequency[place[place >= 0]] = n[place >= 0]
    idf = np.log((1 + seen) / (1 + frequency)) + 1

    chosen = smallest_hashes(rows, per_language, "lang", ["id", "text"], "language-texts")
    chosen = chosen.select("lang", "text").mapInArrow(tidy(_grams), "lang string, whole boolean, places array<long>, counts array<long>")
    chosen = cut(chosen, "language-sample")
    slim = chosen.where("whole and size(places) > 0").orderBy("lang", F.hash("places", "counts"))
    sample = slim.select("lang", F.col("places").cast("array<int>").alias("places"), F.col("counts").cast("array<int>").alias("counts")).toArrow()
    names = sample.column("lang")
    languages, parts, owner = sorted(set(names.to_pylist())), [], []
    for i, lang in enumerate(languages):
        vectors = _dense(sample.filter(pc.equal(names, lang)), idf)
        centroids = _cluster(vectors, clusters)
        # Spread-out starts find odd texts first: what holds hardly any text does not stand for the language.
        held = np.bincount((vectors @ centroids.T).argmax(axis=1), minlength=len(centroids))
        centroids = centroids[held >= min(held.max(), max(2, quantile * len(vectors)))]
        parts.append(centroids)
        owner += [i] * len(centroids)
    centroids = np.concatenate(parts).T.astype(np.float32) if parts else np.zeros((DIMENSIONS, 0), np.float32)
    model = Model(languages, idf, centroids, np.array(owner, np.int64), np.zeros((len(languages), SIZES)))
    kinds = "lang string, size int, cosine double"
    measured = chosen.mapInArrow(model.measure, kinds).toArrow() if languages else None
    for i, lang in enumerate(languages):
        mine = measured.filter(pc.equal(measured.column("lang"), lang))
        sizes, cosines = mine.column("size").to_numpy(), mine.column("cosine").to_numpy()
        low = 0.0
        for size in range(SIZES):
            # A quantile of few texts is their least; a size without enough keeps the limit of smaller texts.
            if len(own := cosines[sizes == size]) >= 10:
                low = slack * float(np.quantile(own, quantile, method="lower"))
            model.least[i, size] = low
    return model


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, lang_pred, score, rejected, one row per input row.

    ``score`` is the cosine to the nearest centroid, from 0 to 1.  Null texts
    and texts without a letter are ``und`` with score 0 and rejected, as is
    every text under a model that learned no language.  ``rejected`` also marks
    texts beyond the centroid's limit, which keep the nearest language.  A null
    id stays null, rows that repeat are judged each, an empty table gives an
    empty result, and other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            lang, score, rejected = zip(*map(model.predict, texts.to_pylist()), strict=True) if len(ids) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def recognised(text: Column, model: Model) -> Column:
    """Whether a text is not rejected, as a column: a filter that needs no join."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not model.predict(t)[2] for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")(F.coalesce(text, F.lit("")))
