"""Toxicity with a counterfactual-regularised classifier.

Features are words and word beginnings. How many toxic and clean documents have each is counted over
labelled training rows, of which a documented number are used; the features most associated with the label enter a logistic regression. Its loss
has a penalty on score changes when identity terms in a labelled text's sentences are swapped for others,
so that naming a group does not move the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import id_remainder, rows_where, slices
from barwise.llm.language import letter_runs

#: Terms that name a group, by kind; a term is swapped for the next one of its line.
IDENTITY_TERMS = (
    "women men girls boys", "woman man girl boy", "female male", "gay straight lesbian bisexual transgender",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab", "african american european mexican chinese indian", "immigrants refugees foreigners natives",
    "immigrant refugee foreigner native", "disabled blind deaf autistic", "old young elderly teenage",
    "frauen männer", "muslime christen juden", "ausländer flüchtlinge einheimische", "femmes hommes", "musulmans chrétiens juifs",
    "immigrés réfugiés étrangers", "mujeres hombres", "musulmanes cristianos judíos", "inmigrantes refugiados extranjeros",
)
SWAPS = {term: line.split()[(k + 1) % len(line.split())] for line in IDENTITY_TERMS for k, term in enumerate(line.split())}
PREFIXES = (4, 5, 6)
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(words: set[str]) -> list[str]:
    """The words, and the beginnings of longer ones marked by a star."""
    return [*words, *{f"{w[:n]}*" for n in PREFIXES for w in words if len(w) > n}]


def counterfactual(text: str) -> str | None:
    """The text with identity terms swapped, sentence by sentence; None if it names none."""
    if SWAPS.keys().isdisjoint(letter_runs(text)):
        return None
    return ".".join(" ".join(SWAPS.get(w, w) for w in letter_runs(s)) for s in _SENTENCE.split(text))


class Picker:
    """Finds the numbers of a text's known features."""

    def __init__(self, names: list[str]):
        self.number = {name: k for k, name in enumerate(names)}
        self.words = {n for n in names if not n.endswith("*")}
        self.starts = {k: {n for n in names if n.endswith("*") and len(n) == k + 1} for k in PREFIXES}

    def __call__(self, text: str) -> list[int]:
        words = set(letter_runs(text))
        found = list(words & self.words)
        for n, known in self.starts.items():
            if known:
                found += {f"{w[:n]}*" for w in words if len(w) > n} & known
        return sorted(map(self.number.__getitem__, found))


def _associated(labelled: DataFrame, most_features: int) -> list[str]:
    """The features with the clearest association with label 1, by the z of their log odds."""

    def counted(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(features_of(set(letter_runs(text))))
            if len(seen[0]) + len(seen[1]) > 2_000_000:
                yield rows(seen)
                seen = (Counter(), Counter())
        yield rows(seen)

    def rows(seen):
        # a feature that no toxic row of the task has is sent with the clean rows' count alone
        names = list(seen[0].keys() | seen[1].keys())
        return pa.record_batch([pa.array(names, pa.string()), pa.array([seen[1][n] for n in names], pa.int64()), pa.array([seen[0][n] for n in names], pa.int64())], names=["feature", "toxic", "clean"])

    totals = labelled.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    t, c, half = F.col("t"), F.col("c"), F.lit(0.5)
    z = (F.ln((t + half) / (totals["t"] - t + half)) - F.ln((c + half) / (totals["c"] - c + half))) / F.sqrt(1 / (t + half) + 1 / (c + half))
    counts = labelled.select("toxic", "text").mapInArrow(counted, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    kept = counts.where((t >= 3) & (z > 3)).orderBy(F.desc(z), "feature").limit(most_features)
    return [r.feature for r in kept.select("feature").collect()]


def _fit(rows: list[tuple[int, list[int], list[int] | None]], n_features: int, l2: float, consistency: float, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; `consistency` weighs the squared change of the log odds under the swap."""

    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((i for x in lists for i in x), dtype=np.int64)

    y = np.array([r[0] for r in rows], dtype=float)
    row, col = sparse([r[1] for r in rows])
    swapped = [r for r in rows if r[2] is not None]
    (row_a, col_a), (row_b, col_b) = sparse([r[1] for r in swapped]), sparse([r[2] for r in swapped])
    w, n = np.zeros(n_features + 1), max(1, len(rows))
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], minlength=len(rows)) + w[-1])))
        error = p - y
        grad = np.append(np.bincount(col, error[row], minlength=n_features), error.sum()) / n
        if swapped:
            change = np.bincount(row_a, w[col_a], minlength=len(swapped)) - np.bincount(row_b, w[col_b], minlength=len(swapped))
            grad[:-1] += 2 * consistency / len(swapped) * (np.bincount(col_a, change[row_a], minlength=n_features) - np.bincount(col_b, change[row_b], minlength=n_features))
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _some(ids: DataFrame, most: int, n: int) -> DataFrame:
    """About `most` of n rows at most, picked by a hash of the id."""
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < 1e9 * most / n) if n > most else ids


def train(docs: DataFrame, labels: DataFrame, count_rows: int = 100_000, fit_rows: int = 20_000, most_features: int = 4096, l2: float = 1e-4, consistency: float = 1.0) -> dict:
    """A model from the non-null texts of `docs` with a 0/1 label in `labels`.

    A bounded sample of labelled rows is used: about `count_rows` of them, picked by a hash of the id, for the
    counts of features and about `fit_rows` of those for the regression; where there are fewer, all. The
    bound makes the picked ids small enough to broadcast, so no text is shuffled. An id with several labels
    is toxic if one of them says so. Without labels the model scores 0 everywhere.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    if not n:
        return {"names": [], "weights": np.zeros(0), "bias": -np.inf}
    texts = docs.where("text is not null").select("doc_id", "text")
    labelled = texts.join(F.broadcast(_some(marked, count_rows, n)), "doc_id")
    names = _associated(labelled, most_features)
    known = docs.sparkSession.sparkContext.broadcast(names)

    def picked(batches):
        pick = Picker(known.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            other = [counterfactual(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([pick(t) for t in texts], pa.list_(pa.int32())), pa.array([None if o is None else pick(o) for o in other], pa.list_(pa.int32()))], names=["toxic", "found", "swapped"])

    sample = texts.join(F.broadcast(_some(marked, fit_rows, n)), "doc_id")
    rows = sample.select("toxic", "text").mapInArrow(picked, "toxic int, found array<int>, swapped array<int>").collect()
    weights, bias = _fit([tuple(r) for r in rows], len(names), l2, consistency)
    return {"names": names, "weights": weights, "bias": bias}


def _scores(texts: list[str | None], pick: Picker, model: dict) -> np.ndarray:
    logits = [model["bias"] + model["weights"][pick(t or "")].sum() for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(logits, dtype=float), -50, 50)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) per row, 0 to 1; a null text scores like an empty one."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        pick = Picker(known.value["names"])
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.record_batch([batch.column(0), pa.array(_scores(batch.column(1).to_pylist(), pick, known.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """`docs` without those that score `threshold` or more. All columns and null texts stay and nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        pick = Picker(known.value["names"])
        return lambda texts: _scores(texts, pick, known.value) < threshold

    return rows_where(docs, judge)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_remainder("doc_id", 4) != 2)


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt only where crc32 of the id leaves another remainder than 2 by 4."""
    scored = score(docs, train(training_rows(docs), training_rows(labels)))
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
