from collections import Counter, defaultdict

import numpy as np
import pytest
from nightjar.llm import minhash as M
from nightjar.operators.lineage import materialize

SCHEMA = "doc_id long, text string, digest string, class_id string"


def bags(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return out


def brute(rows, t=0.8):
    """class id per row: components over weighted Jaccard similarity and equal texts."""
    texts = [x or "" for _, x, *_ in rows]
    shingled, n = bags(texts), len(rows)
    df = Counter(k for b in shingled for k in b)
    w = {k: float(M.idf(np.array([min(255, round(np.log2(v) * 8))]), n)[0]) for k, v in df.items()}
    total = [sum(c * w[k] for k, c in b.items()) for b in shingled]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, b in enumerate(shingled):
        common = Counter()
        for k, c in b.items():
            for j in holders[k]:
                common[j] += min(c, shingled[j][k]) * w[k]
            holders[k].append(i)
        for j, v in common.items():
            if v / (total[i] + total[j] - v) >= t - 1e-9:
                root[find(i)] = find(j)
    first = {}
    for i, x in enumerate(texts):
        root[find(i)] = find(first.setdefault(x, i))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(n)]


def check(spark, rows, parts=4):
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    want = Counter((r[0], c) for r, c in zip(rows, brute(rows)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    per = Counter(c for _, c in want.elements())
    for r in got:
        assert r.class_size == per[r.class_id] or r.class_id is None
    return got


def text(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def changed(t, *places):
    words = t.split()
    for p in places:
        words[p] = f"new{p}{t[:4]}"
    return " ".join(words)


def test_groups_copies_and_odd_texts(spark):
    a = text(200, "a")
    rows = [(10, a), (11, a), (12, changed(a, 50)), (13, changed(a, 20, 120)), (14, changed(a, *range(0, 200, 8))), (20, text(40, "b")), (21, changed(text(40, "b"), 0)), (22, changed(text(40, "b"), 20)),
            (30, None), (31, ""), (32, "  "), (40, "one two"), (41, "One  TWO"), (42, "one two"), (50, "x " * 3000), (51, "x " * 2990 + "y"), (None, "no id"), (60, "no id"), (61, text(30_000, "long")), (62, changed(text(30_000, "long"), 5, 999))]
    got = {r.doc_id: r for r in check(spark, [(*r, "clash", None) for r in rows])}
    assert got[13].class_id == got[12].class_id == 10 and got[14].class_id == 14 and got[62].class_id == 61 and got[21].class_id == 20
    assert [d for d in (10, 11, 12, 13) if got[d].kept] == [10] and got[60].class_id == got[None].class_id == 60


def test_a_large_group_of_near_copies(spark):
    base = text(120, "c")
    rows = [(i, changed(base, i % 120, (i * 7) % 120) if i else base, None, None) for i in range(300)] + [(1000 + i, base, None, None) for i in range(300)]
    rows += [(2000 + i, base[:200] + " " + text(90, f"d{i}"), None, None) for i in range(200)]
    check(spark, rows, 7)


def test_whole_table(spark):
    check(spark, [(r.doc_id, r.text, None, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_empty_and_repeated_rows(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = M.near_duplicates(spark.createDataFrame([(1, text(9, "e"), None, None)] * 4, SCHEMA)).collect()
    assert len(got) == 4 and {(r.class_id, r.class_size) for r in got} == {(1, 4)}


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 40, 300).astype(np.uint64)
    w = rng.uniform(0.5, 4, 300)
    v = np.where(rng.random(300) < 0.3, w * rng.uniform(0.2, 3, 300), w)
    sig = M.samples(np.concatenate([h, h[40:]]), np.concatenate([w, v[40:]]), np.array([0, 300]), 4096)
    low, high = np.minimum(w[40:], v[40:]).sum(), np.maximum(w[40:], v[40:]).sum() + w[:40].sum()
    assert abs((sig[0] == sig[1]).mean() - low / high) < 0.03


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    got = {r.node: r.component for r in M.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and got[5] == 4 and {got[100 + i] for i in range(41)} == {100} and {got[600 + i] for i in range(30)} == {500}


@pytest.mark.parametrize("values", [[], [0], [1, 2, 70_000, 1 << 47], [(1 << 63) + 5]])
def test_packing(values):
    x = np.array(values, np.uint64)
    assert (M.unpack(M.pack(x)) == x).all() and len(M.unpack(M.pack(x))) == len(x)


@pytest.mark.parametrize("few", [1 << 14, 3])
def test_components_end_without_a_round_to_confirm(spark, monkeypatch, few):
    """A star takes one round of two tables, a path of 40 nodes a few; the classes are the components."""
    written = []
    monkeypatch.setattr(M, "FEW_EDGES", few)
    monkeypatch.setattr(M, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    star = M.components(spark.createDataFrame([(9, i) for i in range(1, 9)] + [(9, 9)], "x long, y long"))
    assert {tuple(r) for r in star.collect()} == {(i, 1) for i in range(1, 10)} and written.count("near-small") == 1
    path = [(i * 7 % 41, (i + 1) * 7 % 41) for i in range(40)] + [(100, 101), (102, 101)]
    got = {tuple(r) for r in M.components(spark.createDataFrame(path, "x long, y long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}


def test_rounds_without_new_links_are_not_computed_again(spark, monkeypatch):
    """Copies with one changed word are all linked to the first of them; no band is split after that, so no later round is run."""
    written = []
    monkeypatch.setattr(M, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in (50, 120, 180)] + [f"quite another text number {i} here" for i in range(5)]
    got = M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert written.count("near-edges") == 1 and written.count("near-open") == 1
