import re
from collections import Counter, defaultdict

import pytest
from nightjar.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string, size string"


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    made = [(i, words(30 + i % 50, f"a{i}_"), "a", None, "x") for i in range(300)]
    made += [(1000 + i, words(40, f"b{i}_"), "b", None, "x") for i in range(20)]
    made += [(2000 + i, words(10, f"c{i}_"), "c", None, "x") for i in range(3)]
    made += [(3000 + i, words(25), None, None, None) for i in range(40)]
    made += [(4000, None, "a", None, None), (4001, "", "b", None, None), (4002, " \t\n", "d", None, None), (None, words(9), "b", None, None)]
    return made + [(4003, words(20_000, "long"), "a", None, None), (5007, "same row", "a", None, None), (5007, "same row", "a", None, None)]


def test_counts_meet_targets(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = M.mix_counts(df, shards=4).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    want = water(sizes)
    for s, x in by.items():
        assert {r.source_size for r in x} == {sizes[s]}
        assert x[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in x) == round(want[s])
        assert all(0 <= r.taken <= 3 * r.size for r in x)
    assert {r.doc_id: r.size for r in got}[4002] == 0
    again = M.mix_counts(df.repartition(3), shards=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_pieces_are_the_counts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {(r.doc_id, r.size): r.taken for r in M.mix_counts(df, shards=4).collect() if r.doc_id != 5007}
    pieces = M.mix_pieces(df, shards=4, keep=())
    texts = {r[0]: r[1] or "" for r in rows}
    taken, shards = Counter(), Counter()
    for p in pieces.collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", p.text)) == p.n_words
        assert p.text in texts[p.doc_id]
        taken[p.doc_id] += p.n_words
        shards[p.shard] += 1
    assert set(shards) <= set(range(4)) and len(shards) == 4
    for (doc, _), n in counts.items():
        assert taken[doc] == n


def test_splitting_tree_deals_every_quota(spark):
    counts = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 1)], "sid int, n long")
    got = M.split_quotas(counts, shards=8).collect()
    per, shard = Counter(), Counter()
    for r in got:
        per[r.sid] += r.quota
        shard[r.shard] += r.quota
    assert per == Counter({0: 1000, 1: 37, 3: 1, 2: 0})
    assert max(shard.values()) - min(shard.values()) <= 3 and len(shard) == 8
    for sid in range(4):
        runs = sorted((r.first, r.quota) for r in got if r.sid == sid)
        assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:]))


def test_split_is_hypergeometric(spark):
    """Over many seeds the left child's share of a source has the mean and spread of a draw without replacement."""
    drawn = []
    counts = spark.createDataFrame([(0, 30), (1, 10)], "sid int, n long")
    for seed in range(40):
        drawn.append(next(r.quota for r in M.split_quotas(counts, shards=2, seed=seed).collect() if (r.shard, r.sid) == (0, 1)))
    mean = sum(drawn) / len(drawn)
    spread = sum((x - mean) ** 2 for x in drawn) / (len(drawn) - 1)
    assert 4.3 < mean < 5.7 and 0.8 < spread < 4  # 5 and 10/4 * 30/39 = 1.92


def test_empty_table(spark):
    assert M.mix_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.mix_pieces(spark.createDataFrame([], SCHEMA), keep=()).count() == 0
