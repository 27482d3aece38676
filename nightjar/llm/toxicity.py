"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; the model of a later category
also gets the earlier categories' probabilities as features. While training,
those probabilities are out-of-fold predictions, so a later model sees them as
unsure as they will be on new documents; when scoring, they come from models
fitted on all training rows. Each model is a logistic regression on hashed
words and word beginnings (present or not), every feature scaled by its log
count ratio between the classes.

Spark makes the features (row-local expressions), finds the training rows and
scores every document in Arrow batches. The models are fitted on the driver with
NumPy on a bounded sample: the ``SAMPLE`` labelled documents with the smallest
hashed ids. Model size is fixed (``2 * BUCKETS`` weights per category). Features
that too few of them hold for any fit leave first, and numbers of rows and features take 32 bits.

Defined results: a null text has no words; null labels or ids and labels without
a document don't train; several labels of a document count as their maximum;
of documents with one id, one trains; a category with fewer than ``FOLDS``
examples of either class predicts its base rate everywhere and rejects nothing;
an empty table gives no rows; every row is scored by itself, repeated or not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.session import bound_batches

#: Labelled documents that train, at most.
SAMPLE = 8000
BUCKETS = 1 << 18
FOLDS = 5
#: Training documents that must hold a feature.
LEAST_DOCS = 3
#: Letters of a word's beginning that make a feature of their own.
STEM = 4
L2 = 1.0

#: Categories in chain order: name and the label column's condition.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def features(text: Column) -> Column:
    """Distinct hashed words (first half of the buckets) and word beginnings (second half)."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    stems = F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")),
                                     F.transform(stems, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + BUCKETS).cast("int"))))


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def margins(self, idx: np.ndarray, row: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.weights[idx], n) + before @ self.extra + self.bias


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, idx: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            p = _sigmoid(model.margins(idx, row, n, _logit(out)))
            out = np.column_stack([out, p])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _minimise(f, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - y @ q / (s @ y))
        step = 1.0 if pairs else min(1.0, 1 / (np.abs(q).sum() + 1e-12))
        for _ in range(30):
            new_value, new_g = f(x - step * q)
            if new_value <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            return x
        s, y = -step * q, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory:], (s, y)]
        x, done = x + s, value - new_value < 1e-6 * max(1.0, abs(value))
        value, g = new_value, new_g
        if done:
            break
    return x


def fit_linear(idx: np.ndarray, row: np.ndarray, n: int, before: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Logistic regression of ``y`` on present features (pairs idx, row) and the logits ``before``."""
    positives = int(y.sum())
    if min(positives, n - positives) < FOLDS:
        return Linear(np.zeros(size, np.float32), np.zeros(before.shape[1]), float(_logit(np.array([(positives + 0.5) / (n + 1)]))[0]))
    held = np.bincount(idx, minlength=size)
    ones = np.bincount(idx, y[row], size)
    used = np.flatnonzero(held >= LEAST_DOCS)
    ones, held = ones[used], held[used]
    scale = np.log((ones + 1) / (positives + 2)) - np.log((held - ones + 1) / (n - positives + 2))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[idx]
    kept = at >= 0
    at, row_at = at[kept].astype(np.intp), row[kept].astype(np.intp)
    del idx, row, kept
    k = len(used)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.bincount(row_at, (w[:k] * scale)[at], n) + before @ w[k:-1] + w[-1]
        p = _sigmoid(m)
        value = np.logaddexp(0, m).sum() - m @ y + L2 / 2 * (w[:-1] @ w[:-1])
        r = p - y
        g = np.concatenate([np.bincount(at, r[row_at], k) * scale, r @ before, [r.sum()]])
        g[:-1] += L2 * w[:-1]
        return value, g

    w = _minimise(loss, np.zeros(k + before.shape[1] + 1))
    weights = np.zeros(size, np.float32)
    weights[used] = w[:k] * scale
    return Linear(weights, w[k:-1], float(w[-1]))


def _threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The probability that best parts the classes by F1 on out-of-fold margins, mid-way to the next lower one."""
    if y.sum() < FOLDS:
        return 1.0
    order = np.argsort(-margin, kind="stable")
    hits, seen = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.diff(margin[order]) != 0, True)
    f1 = np.where(last, 2 * hits / (seen + y.sum()), 0)
    best = int(np.argmax(f1))
    after = margin[order][best + 1] if best + 1 < len(y) else margin[order][best] - 1
    return float(_sigmoid(np.array([(margin[order][best] + after) / 2]))[0])


def fit_chain(idx: np.ndarray, sizes: np.ndarray, labels: np.ndarray, names: Sequence[str], size: int = 2 * BUCKETS) -> Chain:
    """Chain from ragged feature lists (``idx``, ``sizes``) and a 0/1 label matrix (rows x categories)."""
    n = len(sizes)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    kept = np.bincount(idx, minlength=size)[idx] >= LEAST_DOCS  # the others have no weight in any fit
    idx, row = idx[kept].astype(np.int32), row[kept]
    fold = np.arange(n) % FOLDS
    chain, before = Chain(list(names)), np.zeros((n, 0))
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        out = np.zeros(n)
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            number = np.cumsum(train, dtype=np.int32) - 1
            model = fit_linear(idx[train[row]], number[row[train[row]]], int(train.sum()), before[train], y[train], size)
            number = np.cumsum(test, dtype=np.int32) - 1
            out[test] = model.margins(idx[test[row]], number[row[test[row]]], int(test.sum()), before[test])
        chain.models.append(fit_linear(idx, row, n, before, y, size))
        chain.thresholds.append(_threshold(out, y))
        before = np.column_stack([before, np.clip(out, _logit(np.array(1e-4)), _logit(np.array(1 - 1e-4)))])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain:
    flags = [F.max(F.expr(condition).cast("int")).alias(f"c{i}") for i, (_, condition) in enumerate(categories)]
    names = [f"c{i}" for i in range(len(categories))]
    chosen = (labels.filter("doc_id is not null").groupBy("doc_id").agg(*flags).na.drop(subset=names)
              .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` narrow rows
    one = rows.groupBy("doc_id", "h", *names).agg(F.min(F.struct(F.xxhash64("text").alias("t"), features(F.col("text")).alias("f")))["f"].alias("f"))
    got = one.orderBy("h", "doc_id").select("f", *names).toArrow()
    lists = got.column("f").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    marks = np.column_stack([got.column(c).to_numpy() for c in names]) if len(lists) else np.zeros((0, len(names)))
    return fit_chain(lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64), sizes, marks, [n for n, _ in categories])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns and, per category, ``p_<name>``; plus ``is_<name>`` for the last one."""
    bound_batches(docs.sparkSession)
    models, width = chain, len(chain.names)
    kind = ", ".join(f"p{i}: double" for i in range(width))

    @F.arrow_udf(f"struct<{kind}>")
    def predict(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        p = models.probabilities(lists.flatten().to_numpy(), row, len(lists))
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(width)], [f"p{i}" for i in range(width)])

    scored = docs.withColumn("__p", predict(features(F.col("text"))))
    for i, name in enumerate(chain.names):
        scored = scored.withColumn(f"p_{name}", F.col(f"__p.p{i}"))
    last = chain.names[-1]
    return scored.withColumn(f"is_{last}", F.col(f"p_{last}") >= F.lit(chain.thresholds[-1])).drop("__p")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a chain trained on the labelled ones."""
    return score(docs, train(docs, labels))
