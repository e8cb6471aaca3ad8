"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all training documents, whatever
their label, are the unlabelled ones.  A linear classifier in numpy minimises
the class-prior-corrected risk

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

with the logistic loss; where the second term turns negative, which is
overfitting, the step goes up that term instead.  Features are hashed words and
word beginnings, present or not, chosen by how much more often they occur in
positives than in unlabelled documents, counted over all training documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, smallest_hashes, tidy, within
from tallyloom.llm.shingles import chunks, mix, word_hashes
from tallyloom.scratch import cut

#: Bytes that part words: all of ASCII but letters and digits.
SEPARATORS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)


def features(texts: pa.Array):
    """For each text, its distinct hashed features in ascending order."""
    for _, text, offsets in chunks(texts):
        whole, starts, _ = word_hashes(text, offsets, SEPARATORS)
        kinds = [whole] + [mix(word_hashes(text, offsets, SEPARATORS, n)[0] + np.uint64(n)) for n in BEGINNINGS]
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(np.concatenate([k[a:b] for k in kinds]))


@dataclass
class Model:
    hashes: np.ndarray  # ascending
    weights: np.ndarray
    bias: float

    def places(self, found: np.ndarray) -> np.ndarray:
        """Which chosen features are among a text's."""
        if not len(found) or not len(self.hashes):
            return np.zeros(0, np.int64)
        # The shorter side is looked up in the longer one.
        if len(found) < len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            return at[self.hashes[at] == found]
        at = np.minimum(np.searchsorted(found, self.hashes), len(found) - 1)
        return np.flatnonzero(found[at] == self.hashes)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weights[self.places(found)].sum() + self.bias))))


def fit_risk(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk by Adam."""
    w, b = np.zeros(x_p.shape[1], np.float32), 0.0
    m = v = np.zeros(len(w) + 1)
    sigmoid = lambda g: 1 / (1 + np.exp(-g))
    for t in range(1, steps + 1):
        g_p, g_u = x_p @ w + b, x_u @ w + b
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        up, uu = sigmoid(g_p) / len(g_p), sigmoid(g_u) / len(g_u)
        d_p, d_u = (-prior / len(g_p) + prior * up) - prior * up, uu
        if negative < 0:
            d_p, d_u = prior * up, -uu
        grad = np.append(x_p.T @ d_p + x_u.T @ d_u + decay * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def _counts(probe: Model | None, held: int = 1 << 20):
    """Numbers of documents that hold each feature, of those in ``probe`` if it
    is given, in parts of about ``held`` occurrences; the number of documents
    stands under no feature."""

    def part(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        columns = pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, len(found)), pa.int64())
        return pa.RecordBatch.from_arrays(list(columns), names=["h", "n"])

    def run(batches):
        for batch in batches:
            found, count = [], 0
            for f in features(batch.column(0)):
                found.append(f if probe is None else probe.hashes[probe.places(f)])
                if (count := count + len(found[-1])) > held:
                    yield part(found)
                    found, count = [], 0
            if found:
                yield part(found)

    return run


def _counted(texts: DataFrame, probe: Model | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(tidy(_counts(probe)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def choose_features(positives: DataFrame, rows: DataFrame, prior: float, n_features: int, least: int, probe_features: int) -> np.ndarray:
    """The features to fit on, ascending.  All that at least ``least`` positives
    hold are held against all documents; up to ``probe_features`` of them are
    looked up where documents are read, more meet by a join on the feature."""
    in_p = cut(_counted(positives), "toxic-counts")
    n_p = in_p.where("h is null").first()["n"]
    frequent = cut(in_p.where(F.col("h").isNotNull() & (F.col("n") >= min(least, n_p))), "toxic-frequent")
    probe = None
    if within(frequent, probe_features):
        known = np.array([r["h"] for r in frequent.select("h").collect()], np.int64)
        probe = Model(np.sort(known.view(np.uint64)), np.zeros(0), 0.0)
    in_u = cut(_counted(rows, probe), "toxic-unlabelled-counts")
    n_u = in_u.where("h is null").first()["n"]
    both = frequent.join(in_u.withColumnRenamed("n", "m"), "h", "left")
    p, q = (F.col("n") + 0.5) / (n_p + 1), (F.coalesce("m", F.lit(0)) + 0.5) / (n_u + 1)
    # By Bayes the share of positives among documents with a feature is prior * p / q;
    # it has to be over a half by more than the standard error of the count.
    sure = p * (1 - 1 / F.sqrt(F.col("n") + 1))
    gains = both.where(prior * sure >= 0.5 * q).select("h", (p * F.log(p / q)).alias("gain")).where("gain > 0")
    best = gains.orderBy(F.desc("gain"), "h").limit(n_features).collect()
    return np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    n_features: int = 768, least: int = 5, n_positive: int = 3000, n_unlabelled: int = 9000, most_prior: float = 0.9,
    broadcast_rows: int = 1_000_000, probe_features: int = 1_000_000,
) -> Model:
    """Fit on documents for whose id ``learn`` holds; no other label is read.

    The class prior is the share of positives among their labels, but at most
    ``most_prior``, as labels that are all positive say nothing of it.  The
    ``n_features`` features are chosen from all that at least ``least`` positives
    hold, by counts over all training documents.  The weights are fitted on
    ``n_positive`` positives and ``n_unlabelled`` documents, or on all where
    there are fewer: those with the smallest hashes of id and text.

    Null labels are none.  Of labels that contradict each other the positive one
    counts.  Rows with a null id are not learned from, rows that repeat count
    each, and null texts count as empty.  Without a positive or a document, as
    with empty tables, the model calls nothing toxic; other columns are ignored.
    """
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), -4.0)
    rows = docs.where(learn(F.col(id_col))).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = labels.where(learn(F.col(id_col)) & F.col(label_col).isNotNull())
    marked = cut(marked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")), "toxic-labels")
    share = marked.agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("p")).first()
    if not share["p"]:
        return nothing
    prior = min(most_prior, share["p"] / share["n"])
    toxic = broadcast_if_small(marked.where("y = 1").select("id"), broadcast_rows)
    positives = cut(rows.join(toxic, "id", "left_semi"), "toxic-positives")
    if positives.isEmpty():
        return nothing
    hashes = choose_features(positives, rows, prior, n_features, least, probe_features)
    probe = Model(hashes, np.zeros(len(hashes)), 0.0)

    def present(batches):
        for batch in batches:
            found = [probe.places(f) for f in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["places"])

    def sample(frame: DataFrame, n: int) -> np.ndarray:
        kept = smallest_hashes(frame.withColumn("all", F.lit(0)), n, "all", ["id", "text"], "toxic-sample").select("text")
        found = sorted(r["places"] for r in kept.mapInArrow(present, "places array<long>").collect())
        x = np.zeros((len(found), len(hashes)), np.float32)
        for i, places in enumerate(found):
            x[i, places] = 1
        return x

    w, b = fit_risk(sample(positives, n_positive), sample(rows, n_unlabelled), prior)
    return Model(hashes, w.astype(np.float64), b)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, score, predicted, one row per input row.

    Null and empty texts have no feature and so the score of the bias alone.  A
    null id stays null, rows that repeat are scored each, an empty table gives
    an empty result, and other columns are ignored.  A model that was fitted
    without any positive scores every text low.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            scores = [model.score(f) for f in features(texts)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int")
