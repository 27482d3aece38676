import numpy as np
import pytest
from nightjar.llm import itq as Q

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep string"


def brute(rows, t=0.98):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: set() for i in range(len(rows))}, list(range(len(rows)))
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= t:
                    links[a].add(b)
                    links[b].add(a)

    def up(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen

    out = []
    for i, (name, *_) in enumerate(rows):
        least = min((rows[j][0] for j in up(i) if rows[j][0] is not None), default=None)
        out.append((name, len(links[i]), least, least == name))
    return sorted(out, key=str), root


def run(spark, rows, **kw):
    got = Q.near_duplicates(spark.createDataFrame([(*r, "clash", "x") for r in rows], SCHEMA).repartition(4), **kw)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(rng, n, d, spread, labels=3):
    rows = []
    while len(rows) < n:
        centre, lab = rng.standard_normal(d), int(rng.integers(0, labels))
        for _ in range(int(rng.integers(1, 7))):
            rows.append((len(rows), (centre + spread * rng.standard_normal(d)).astype(np.float32).tolist(), lab))
    return rows


@pytest.mark.parametrize("cell", [1024, 8])
def test_links_and_components_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(Q, "CELL", cell)
    rng = np.random.default_rng(cell)
    rows = clusters(rng, 500, 64, 0.06)
    rows += [(1000 + i, (np.arange(64) + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(60)]  # one large group of near copies
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(40)] + [(3000, rows[3][1], 9), (7, rows[9][1], rows[9][2])]
    assert run(spark, rows) == brute(rows)[0]


def test_recall_at_the_threshold_and_nothing_below_it(spark):
    rng = np.random.default_rng(3)
    rows = clusters(rng, 1200, 64, 0.14, labels=2)  # cosines around 0.98
    want, got = brute(rows)[0], run(spark, rows)
    total, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert total > 400 and found >= 0.98 * total
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))


@pytest.mark.parametrize("d", [1, 3, 100])
def test_few_and_many_dimensions(spark, d):
    rng = np.random.default_rng(d)
    rows = clusters(rng, 150, d, 0.05, labels=2)
    want, got = brute(rows)[0], run(spark, rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert len(got) == len(rows)


def test_unfit_vectors_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1),
            (10, [1.0, 2.0], 2), (None, [1.0, 2.0], 1), (None, [1.0, 2.0], 3), (None, None, None), (11, [1.0, 2.0, 0.0], 1), (2, [2.0, 4.0], 1), (12, [3e38, 3e38], 4), (13, [1e-30, 1e-30], 4)]
    assert run(spark, rows) == brute(rows)[0]
    assert run(spark, []) == []


def test_rotation_gives_balanced_bits_and_near_codes_for_near_vectors():
    rng = np.random.default_rng(0)
    x = Q.unit(rng.standard_normal((3000, 64)) * np.linspace(0.2, 2, 64) + 1)
    coder = Q.Coder.learned(x, 64)
    codes = coder.codes(x)
    share = [(codes >> np.uint64(i) & np.uint64(1)).mean() for i in range(64)]
    assert 0.3 < min(share) and max(share) < 0.7
    assert np.allclose(coder.turn.T @ coder.turn, np.eye(64))
    # The learned rotation brings the points nearer to corners of the cube than a random one.
    plain = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    assert np.abs((x - coder.centre) @ coder.turn).sum() > np.abs((x - coder.centre) @ plain).sum()


def test_tables_count_every_pair_within_the_radius_once(spark):
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(300)], np.uint64)
    codes = np.concatenate([code, code ^ flips])
    for partners in (10, 1e5, 1e7):
        tables = Q.Tables.planned(9, partners)
        frame = spark.createDataFrame([(i, Q._signed(int(c))) for i, c in enumerate(codes)], "i int, c long")
        from pyspark.sql import functions as F

        met = {}
        for r in frame.select("i", F.explode(tables.places(F.col("c"))).alias("p")).select("i", "p.*").collect():
            met.setdefault((r.t, r.key), []).append((r.side, r.i))
        times = {}
        for (t, _), rows in met.items():
            rows.sort()
            bucket, side = np.zeros(len(rows), int), np.array([s for s, _ in rows])
            at = np.array([i for _, i in rows])
            for i, j in Q.bucket_pairs(bucket, side, np.ones(len(rows), bool)):
                near = tables.counted(codes[at[i]], codes[at[j]], np.full(len(i), t))
                for a, b in zip(at[i[near]].tolist(), at[j[near]].tolist()):
                    times[min(a, b), max(a, b)] = times.get((min(a, b), max(a, b)), 0) + 1
        assert set(times.values()) == {1}
        assert all((i, i + 300) in times for i in range(300) if int(flips[i]).bit_count() <= 9)
