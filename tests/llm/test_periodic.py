import hashlib
import zlib

import numpy as np
import pytest
from nightjar.llm import periodic as P

SCHEMA = "doc_id long, text string, start string, n_runs int"


def brute_runs(words, least=12, repeats=2):
    """Every period of every stretch by plain comparison."""
    n, spans = len(words), {}
    for p in range(1, n // repeats + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            a = i
            while i < n and words[i] == words[i - p]:
                i += 1
            if i - a + p >= max(least, repeats * p):
                spans.setdefault((a - p, i - a + p), p)
    return sorted((s, n, p) for (s, n), p in spans.items())


def brute_row(doc_id, text):
    words = [w.decode("utf-8") for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(((-m, s, p) for s, m, p in runs), default=None)
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *head, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(kept))


def check(spark, rows):
    got = P.periodic_runs(spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(3), P.edited, with_text=False)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    order = lambda rs: sorted(rs, key=lambda r: str(r))
    assert order(tuple(r) for r in got.collect()) == order(brute_row(*r) for r in rows), key


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_runs_of_random_words_equal_plain_comparison(letters):
    rng = np.random.default_rng(letters)
    texts = []
    for _ in range(120):
        words = list("abcdefghijklmnopqrstuvwxyzABCD"[:letters])
        parts = []
        while sum(map(len, parts)) < 150:
            root = rng.choice(words, rng.integers(1, 40)).tolist()
            parts.append((root * 6)[:rng.integers(1, len(root) * 5 + 2)])
        texts.append(sum(parts, [])[:rng.integers(1, 220)])
    made = P.summaries([None] * len(texts), [" ".join(t) for t in texts], None)
    for text, runs in zip(texts, made["runs"]):
        assert [(r["start"], r["length"], r["period"]) for r in runs] == brute_runs(text)


def test_other_least_and_repeats():
    rng = np.random.default_rng(5)
    texts = [rng.choice(list("ab"), 60).tolist() for _ in range(60)]
    for least, repeats in ((3, 2), (6, 3), (20, 2)):
        made = P.summaries([None] * len(texts), [" ".join(t) for t in texts], None, least, repeats)
        for text, runs in zip(texts, made["runs"]):
            assert [(r["start"], r["length"], r["period"]) for r in runs] == brute_runs(text, least, repeats)


def test_rows_equal_a_brute_force_version(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["an", "on", "Ün", "the", " x"], rng.integers(0, 90)))) for i in range(300)]
    rows += [(None, None), (None, "a " * 40), (7, None), (8, ""), (9, " \t\n"), (11, "x\x0by\x0cx y " * 9), (11, "x\x0by\x0cx y " * 9), (11, "z"), (-20, "q r s " * 8)]
    check(spark, rows)


def test_empty_table_and_given_documents(spark):
    check(spark, [])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs if r.text is None or len(r.text) < 6000])


def test_one_word_a_hundred_thousand_times_is_done_in_bounded_pairs():
    made = P.summaries([1, 2], ["ha " * 100_000, "a b c " * 30_000 + "d " + "a b c " * 30_000], None)
    assert made["n_runs"][0] == 1 and made["runs"][0] == [{"start": 0, "length": 100_000, "period": 1}]
    assert {"start": 0, "length": 90_000, "period": 3} in made["runs"][1] and made["collapsed"][0] == b"ha"


def test_real_outputs(spark):
    got = P.periodic_runs(spark.createDataFrame([(1, "x " + "a b c " * 5 + "y", "s", 1)], SCHEMA)).first()
    assert got.collapsed == "x a b c y" and [tuple(r) for r in got.runs] == [(1, 15, 3)] and got.exponent_milli == 5000
