"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The classifier is fitted on a bounded sample of labelled rows, at most ``max_rows`` of each class in the
order of a hash of doc_id; every document is scored. A feature is a hashed character n-gram of the
lower-cased text whose white space is one space, valued by the logarithm of its rate in the text. Its
log-count ratio, counted over documents that have it, scales it, and an L2-regularised logistic
regression, in which both classes weigh the same, weighs the scaled features. What it says of rows that it was not fitted on, fold by fold,
calibrates it: a score is the probability of the label where both are as frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut, held_out

SIZES = (4, 6, 8)
HASH_BITS = 20
#: Labelled rows of each class that the fit uses at most.
MAX_ROWS = 10_000
#: Tasks that read the sample.
SAMPLE_PARTS = 8
#: N-grams that the classifier weighs, and rows of the sample that must have one.
FEATURES, LEAST_ROWS = 20_000, 4
THRESHOLD = 0.7
PENALTY = 0.3
#: Folds of the sample that calibrate the scores.
FOLDS = 3
#: Characters hashed at a time.
WINDOW = 1 << 18


def ngram_ids(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text, window by window, repeats included."""
    flat = f" {' '.join(text.lower().split())} "
    for at in range(0, max(1, len(flat) - min(SIZES) + 1), WINDOW):
        points = np.frombuffer(flat[at : at + WINDOW + max(SIZES) - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        rolled, power, out = np.zeros(len(points), np.uint64), 1, []
        for n in range(1, max(SIZES) + 1):
            if n > len(points):
                break
            rolled = rolled[: len(points) - n + 1] + points[n - 1 :] * np.uint64(power)
            power = power * 0x9E3779B97F4A7C15 % (1 << 64)
            if n in SIZES:
                out.append(((rolled + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS))
        if out:
            yield np.concatenate(out).astype(np.int32)


@dataclass
class Classifier:
    """``place`` maps a hashed n-gram to its weight's index, or -1."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the weighed n-grams in the text, and log(1 + rate a thousand characters) of each."""
        hits = [at[at >= 0] for ids in ngram_ids(text) if len(at := self.place[ids])]
        index, count = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.zeros(0, np.int32), np.zeros(0))
        return index, np.log1p(1000.0 * count / (len(text) + 200))

    def score(self, text: str) -> float:
        index, value = self.found(text)
        return float(_sigmoid(self.bias + (self.weights[index] * value).sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


# ---------------------------------------------------------------- fitting


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """``text, label`` of the sample, and for each label how many labelled rows one sampled row stands for.

    A document with several labels counts as toxic if one of them says so. The sample's ids are broadcast: they are 2 * max_rows at most.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("label")).filter(~held_out(F.col("doc_id"), 3, 1))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    return cut(chosen.select("text", "label").dropDuplicates().coalesce(SAMPLE_PARTS)), {k: max(1.0, n / max_rows) for k, n in total.items()}


def ngram_counts(sample: DataFrame) -> DataFrame:
    """``id, clean, toxic``: sampled rows of each label with the n-gram."""
    wide = 1 << HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, wide), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
                parts = [np.unique(ids) for ids in ngram_ids(text.as_py())]
                if parts:
                    seen[label.as_py(), np.unique(np.concatenate(parts))] += 1
        ids = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(ids), 1 << 16):
            some = ids[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[0, some]), pa.array(seen[1, some])], ["id", "clean", "toxic"])

    counted = sample.mapInArrow(run, "id int, clean long, toxic long")
    return counted.groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_count_ratios(counts: DataFrame, features: int = FEATURES, least_rows: int = LEAST_ROWS) -> pd.DataFrame:
    """``id, ratio`` of the n-grams with the largest ratios for their support; at most ``features`` rows."""
    sums = counts.agg(F.sum(F.col("clean") + 1).alias("c"), F.sum(F.col("toxic") + 1).alias("t")).first()
    if sums.c is None:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "ratio": np.zeros(0)})
    ratio = F.log((F.col("toxic") + 1) / F.lit(float(sums.t))) - F.log((F.col("clean") + 1) / F.lit(float(sums.c)))
    ranked = counts.filter(F.col("clean") + F.col("toxic") >= least_rows).select("id", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(F.col("clean") + F.col("toxic"))).alias("rank"))
    return ranked.orderBy(F.desc("rank"), "id").limit(features).select("id", "ratio").toArrow().to_pandas()


@dataclass
class SparseRows:
    """Weighed n-grams of the sampled rows, all in three flat arrays: 12 bytes each. ``row`` is ascending."""

    label: np.ndarray
    row: np.ndarray
    index: np.ndarray
    value: np.ndarray


def sparse_rows(sample: DataFrame, place: np.ndarray) -> SparseRows:
    """The rows of the sample in an order that the texts alone give."""
    model = Classifier(place, np.zeros(0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = zip(*[model.found(t.as_py()) for t in batch.column("text")], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array([i.astype(np.int32) for i in index], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for v in value], pa.list_(pa.float32()))], ["label", "key", "index", "value"])

    keyed = sample.select("text", "label", F.xxhash64("text").alias("key"))
    found = keyed.mapInArrow(run, "label int, key long, index array<int>, value array<float>").toArrow()
    label, key = found["label"].to_numpy(), found["key"].to_numpy()
    order = np.lexsort((label, key))
    size = pc.list_value_length(found["index"]).to_numpy().astype(np.int64)
    first, now = np.cumsum(size) - size, size[order]
    begins = np.cumsum(now) - now
    moved = np.repeat(first[order] - begins, now) + np.arange(now.sum())
    flat = {c: pc.list_flatten(found[c]).to_numpy() for c in ("index", "value")}
    return SparseRows(label[order], np.repeat(np.arange(len(order), dtype=np.int32), now), flat["index"][moved], flat["value"][moved])


def logistic(rows: SparseRows, y: np.ndarray, weight: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of sparse features scaled by ``scale``, and the bias; accelerated gradient descent with backtracking. A row of weight 0 takes no part."""
    at, col, k, n = rows.row, rows.index, len(scale), len(y)
    value = (scale.astype(np.float32)[col] * rows.value) if len(col) else rows.value
    sign, total = 2.0 * y - 1, weight.sum()

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = v[k] + np.bincount(at, v[col] * value, n)
        return float((weight * np.logaddexp(0, -sign * z)).sum() / total + penalty / 2 / total * (v[:k] ** 2).sum()), z

    def slope(v: np.ndarray, z: np.ndarray) -> np.ndarray:
        e = -sign * weight * _sigmoid(-sign * z) / total
        return np.append(np.bincount(col, e[at] * value, k) + penalty / total * v[:k], e.sum())

    v = np.zeros(k + 1)
    prior = (weight * y).sum() / total
    v[k] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    ahead, step, t = v, 1.0, 1.0
    for _ in range(steps):
        now, z = loss(ahead)
        g = slope(ahead, z)
        while True:
            new = ahead - step * g
            if loss(new)[0] <= now - step / 2 * (g**2).sum() + 1e-12 or step < 1e-9:
                break
            step /= 2
        grow = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, v, t, step = new + (t - 1) / grow * (new - v), new, grow, step * 1.1
    return v[:k], float(v[k])


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through margins, both classes weighing the same; with smoothed targets, so that separable margins have one too."""
    n1, n0 = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    v = np.array([1.0, 0.0])
    loss = lambda u: (weight * (np.logaddexp(0, x @ u) - target * (x @ u))).sum()
    for _ in range(50):
        p = _sigmoid(x @ v)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, t = np.linalg.solve(curve, x.T @ (weight * (p - target))), 1.0
        while loss(v - t * step) > loss(v) and t > 1e-6:
            t /= 2
        v = v - t * step
    return float(max(v[0], 1e-3)), float(v[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY, folds: int = FOLDS) -> Classifier:
    """A classifier from the labelled rows that are not held out. With labels of one kind only, it scores their share everywhere."""
    sample, stands_for = labelled_sample(docs, labels, max_rows)
    ratios = log_count_ratios(cut(ngram_counts(sample)))
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[ratios["id"].to_numpy(np.int64)] = np.arange(len(ratios), dtype=np.int32)
    rows = sparse_rows(sample, place)
    y = rows.label.astype(np.float64)
    if not len(y):
        return Classifier(place, np.zeros(len(ratios)), -np.log(99.0))
    scale = ratios["ratio"].to_numpy(np.float64)
    share = {k: stands_for[k] * (y == k).sum() for k in (0, 1) if (y == k).any()}
    weight = np.array([stands_for[int(k)] * sum(share.values()) / (len(share) * share[int(k)]) for k in y])

    w, bias = logistic(rows, y, weight, scale, penalty)
    if len(share) < 2 or min((y == 0).sum(), (y == 1).sum()) < 2 * folds:
        return Classifier(place, w * scale, bias)
    fold, margin = np.empty(len(y), np.int64), np.empty(len(y))
    for k in (0, 1):  # each class is dealt over the folds by itself
        mine = np.flatnonzero(y == k)
        fold[mine] = np.arange(len(mine)) % folds
    for f in range(folds):
        fw, fb = logistic(rows, y, np.where(fold == f, 0.0, weight), scale, penalty, 60)
        margin[fold == f] = (fb + np.bincount(rows.row, (fw * scale)[rows.index] * rows.value, len(y)))[fold == f]
    a, b = calibration(margin, y)
    return Classifier(place, a * w * scale, a * bias + b)


# ---------------------------------------------------------------- scoring


def score_documents(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row. A null or empty text gets the score of no n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Scores every row of ``docs (doc_id, text, ...)``, learning from ``labels (doc_id, toxic, ...)``.

    * Null labels and labels of unknown documents are ignored. Without labels every score is 0.01.
    * Repeated rows are scored each and equal texts get equal scores. Null doc_ids are scored.
    * No documents give no rows. Labels, lang, source and doc_id are never inputs of a score; other columns are ignored.
    """
    return score_documents(docs, fit(docs, labels, max_rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.score(t.as_py() or "") < threshold for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
