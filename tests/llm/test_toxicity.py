import tracemalloc

import numpy as np
import pytest
from nightjar.llm import toxicity as T

DOCS = "doc_id long, text string, p_toxic string"
BAD = ["stinkard", "stinkling", "stinkette", "grotwad", "grotling"]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(5, 60)))]
        bad, low = rng.random() < 0.15, rng.random() < 0.3
        if bad:
            words[1:1] = [str(rng.choice(BAD)) + str(rng.integers(30)) for _ in range(3)]
        if low:
            words += ["spamword"] * 3
        rows.append((i, " ".join(words), None))
        labels.append((i, 0 if low else 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(700)
    docs = spark.createDataFrame(rows, DOCS)
    return docs, {d: t for d, _, t in labels}, T.train(docs, spark.createDataFrame(labels[:500] + [(None, 1, 1), (9_999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(trained):
    docs, truth, chain = trained
    got = {r.doc_id: r.is_toxic for r in T.score(docs, chain).collect()}
    held_out = [i for i in truth if i >= 500]
    assert sum(got[i] == bool(truth[i]) for i in held_out) / len(held_out) > 0.97
    assert chain.names == ["low_quality", "toxic"] and len(chain.models[1].extra) == 1 and len(chain.models[0].extra) == 0


def test_odd_rows_are_scored(spark, trained):
    *_, chain = trained
    rows = [(None, None, "x"), (1, "", None), (2, "w1 " * 200_000, None), (2, "w1 " * 200_000, None), (5, "stinkard1 stinkling2 grotwad3", None)]
    got = T.score(spark.createDataFrame(rows, DOCS), chain).collect()
    assert len(got) == 5 and all(0 < r.p_low_quality < 1 and r.is_toxic is not None for r in got)
    assert {r.doc_id: r.is_toxic for r in got}[5] and not {r.doc_id: r.is_toxic for r in got}[1]
    assert T.score(spark.createDataFrame([], DOCS), chain).count() == 0


def test_no_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", None)] * 3, DOCS)
    for labels in ([], [(1, 1, 0)]):
        got = T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 3 and not any(r.is_toxic for r in got)


def test_chain_uses_out_of_fold_probabilities():
    """A later category that repeats the earlier one is learnt through the earlier probability even if its words are gone."""
    rng = np.random.default_rng(1)
    y = rng.random(400) < 0.4
    sizes = np.full(400, 4)
    idx = rng.integers(0, 50, (400, 4))
    idx[:, 0] = np.where(y, 60, 61)
    chain = T.fit_chain(idx.ravel(), sizes, np.column_stack([y, y]).astype(int), ["a", "b"], 64)
    assert chain.models[1].extra[0] > 0
    p = chain.probabilities(idx.ravel(), np.repeat(np.arange(400), 4), 400)
    assert ((p[:, 1] > 0.5) == y).mean() > 0.98


def test_minimiser_finds_a_quadratic_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = T._minimise(lambda v: (v @ a @ v / 2 - v.sum(), a @ v - 1), np.zeros(3), steps=200)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-2)


def test_a_fit_holds_few_bytes_for_each_feature_of_a_document():
    rng = np.random.default_rng(2)
    sizes = np.full(3000, 200)
    idx = np.where(rng.random(600_000) < 0.5, rng.integers(0, 2000, 600_000), 2000 + np.arange(600_000)).astype(np.int32)
    labels = np.column_stack([rng.random(3000) < 0.2, rng.random(3000) < 0.1]).astype(int)
    tracemalloc.start()
    T.fit_chain(idx, sizes, labels, ["a", "b"], 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
