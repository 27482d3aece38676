import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from nightjar.llm import lexical as L

DOCS = "doc_id long, text string, rank string, score int"
ITEMS = "item_id long, text string, doc_id string, digest string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    got = L.rank(spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "clash", "x") for i in items], ITEMS), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(L, "BLOCK_DOCS", 16)


def made(rng, n, words, longest):
    p = 1 / np.arange(1, words + 1)
    return [" ".join(f"W{j}" for j in rng.choice(words, rng.integers(0, longest), p=p / p.sum())) for _ in range(n)]


def test_equals_scoring_every_document(spark, small_shards, monkeypatch):
    rng = np.random.default_rng(0)
    docs = list(enumerate(made(rng, 700, 400, 60)))
    docs += [(5, docs[5][1]), (5, docs[9][1]), (None, docs[7][1]), (None, "w1 w2 w3"), (9000, None), (9001, ""), (9002, "-- // \x7f"), (9003, "w1 " * 3000 + "W2-w3")]
    docs += [(10_000 + i, docs[3][1]) for i in range(60)]
    items = list(enumerate(made(rng, 40, 400, 25))) + [(3, "w1 w1 W2"), (3, "w1 w1 W2"), (None, "w3 w390"), (77, None), (78, ""), (79, "?!"), (80, "neverseen"), (81, "é w2 É")]
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(L, "QUESTION_CHARS", 300)  # several blocks of items
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables_and_few_documents(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == []
    assert run(spark, [(1, "a b"), (2, "b")], [(1, None)]) == []
    assert run(spark, [(1, "a b"), (2, "b"), (3, "c")], [(1, "B")]) == brute([(1, "a b"), (2, "b"), (3, "c")], [(1, "B")])


def test_pair_bounds_hold_and_are_tighter_than_independent_maxima():
    rng = np.random.default_rng(1)
    tighter = 0
    for _ in range(200):
        n, r = 30, int(rng.integers(1, 9))
        impact = rng.integers(0, 100, (r, n)) * (rng.random((r, n)) < 0.4)
        most = impact.max(1).tolist()
        pair = [int((impact[i] + impact[i + 1])[(impact[i] > 0) & (impact[i + 1] > 0)].max(initial=0)) for i in range(r - 1)]
        bounds = L.prefix_bounds(most, pair)
        assert all(bounds[i] >= impact[:i].sum(0).max() for i in range(r + 1)) and bounds == sorted(bounds)
        assert all(b <= sum(most[:i]) for i, b in enumerate(bounds))
        tighter += bounds[-1] < sum(most)
    assert tighter > 150


def test_search_skips_documents_and_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, r = 60, int(rng.integers(1, 8))
        impact = rng.integers(1, 50, (r, n)) * np.arange(1, r + 1)[:, None] * (rng.random((r, n)) < 0.4)
        term, doc = np.nonzero(impact)
        terms, counts = np.unique(term, return_counts=True)
        shard = L.Shard.of(n, terms, counts, doc, impact[term, doc])
        pair = [int(shard.joint(i, i + 1)[1].max(initial=0)) for i in range(r - 1)]
        bounds = L.prefix_bounds(impact.max(1).tolist(), pair)
        total = impact.sum(0)
        threshold = int(rng.integers(0, total.max() + 2))
        docs, scores = L.search_shard(shard, list(range(r)), bounds, threshold)
        want = np.flatnonzero((total > 0) & (total >= threshold))
        assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(db.execute(L.ORACLE).fetchall(), key=str)
    got = L.rank(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert sorted((tuple(r) for r in got), key=str) == want and len(want) > 100
