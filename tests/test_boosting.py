import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.operators import boosting as B


def rows(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    data = pd.DataFrame(x, columns=list("abcd"))
    data["y"] = 80 + 9 * data.a - 4 * (data.b > 0.5) + 2 * data.c * data.a
    data.loc[rng.random(n) < 0.1, "c"] = None
    data["fold"], data["source_index"] = rng.integers(1, 4, n), np.arange(n)
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, c double, d double, y double, fold int, source_index long"), data


MEDIANS = {k: {"c": 0.5 + k / 100} for k in range(4)}


def fit(spark, frame, **kw):
    settings = kw.pop("settings", B.Settings(trees=12, rate=0.3, depth=3, bins=16))
    return B.fit_models(frame, MEDIANS, kw.pop("held_out", (0, 1, 2, 3)), settings, list("abcd"), "y", **kw)


def listed(nodes):
    return sorted(tuple(r) for r in nodes.collect())


def test_blocks_and_partitions_do_not_change_the_trees(spark):
    frame, _ = rows(spark)
    one = listed(fit(spark, frame.repartition(3)))
    assert one == listed(fit(spark, frame.orderBy(F.rand(3)).repartition(5)))
    assert one == listed(fit(spark, frame, task_rows=250))  # a job a level over several blocks
    assert {r[0] for r in one} == {0, 1, 2, 3} and max(r[1] for r in one) == 11


def test_predictions_learn_the_target_and_equal_a_plain_walk(spark):
    frame, data = rows(spark)
    nodes = fit(spark, frame, settings=B.Settings(trees=80, rate=0.2, depth=3, bins=32), held_out=(0,))
    values = [F.coalesce(F.col(c), F.lit(MEDIANS[0].get(c, 0.0))) for c in "abcd"]
    got = B.predicted(frame, nodes, F.lit(0), values, 3).select("source_index", "prediction").toPandas().set_index("source_index").prediction
    table = nodes.toPandas()
    base = table[table.tree < 0].value.iloc[0]
    x = data[list("abcd")].fillna({"c": 0.5}).to_numpy()
    for i in (0, 17, 400):
        total = base
        for _, tree in table[table.tree >= 0].groupby("tree"):
            tree, at = tree.set_index("node"), 1
            while tree.loc[at].feature >= 0:
                at = 2 * at + int(x[i, int(tree.loc[at].feature)] > tree.loc[at].threshold)
            total += tree.loc[at].value
        assert got[i] == total
    assert np.abs(got.to_numpy() - data.y[got.index].to_numpy()).mean() < 0.2


def test_a_held_out_fold_has_no_say(spark):
    frame, _ = rows(spark)
    spoiled = frame.withColumn("y", F.when(F.col("fold") == 2, 0.0).otherwise(F.col("y")))
    edges = lambda train, features, bins: [np.linspace(0, 1, bins)[1:-1] for _ in features]
    two = [r[1:] for r in listed(fit(spark, frame, edges=edges)) if r[0] == 2]
    assert two == [r[1:] for r in listed(fit(spark, spoiled, edges=edges)) if r[0] == 2]


def test_limits_of_splits(spark):
    frame, _ = rows(spark, 60)
    nodes = fit(spark, frame, held_out=(0,), settings=B.Settings(trees=3, depth=5, least_rows=7, rows=1.0, columns=0.5)).toPandas()
    trees = nodes[nodes.tree >= 0]
    assert trees.cover.min() >= 7 and trees[trees.node == 1].cover.tolist() == [60, 60, 60]
    for number, tree in trees.groupby("tree"):
        assert set(tree.feature) - {-1} <= set(B.tree_columns(number, 4, B.Settings(columns=0.5))) and len(B.tree_columns(number, 4, B.Settings(columns=0.5))) == 2
        inner = tree[tree.feature >= 0].node
        assert all(tree[tree.node.isin([2 * n, 2 * n + 1])].cover.sum() == tree[tree.node == n].cover.iloc[0] for n in inner)


def test_share_of_sampled_rows_and_other_trees_other_rows():
    keys = np.arange(100_000)
    one, two = (B.sampled(keys, t, B.Settings()) for t in (0, 1))
    assert abs(one.mean() - 0.8) < 0.01 and abs((one & two).mean() - 0.64) < 0.02


def test_no_rows_no_values_and_too_many_bins(spark):
    frame, _ = rows(spark, 20)
    assert listed(fit(spark, frame.limit(0), held_out=(0,))) == []
    blank = frame.withColumn("c", F.lit(None).cast("double"))
    assert 2 not in {r.feature for r in fit(spark, blank, held_out=(0,)).collect()}
    with pytest.raises(ValueError, match="255 bins"):
        fit(spark, frame, settings=B.Settings(bins=300))


def test_a_tree_counts_each_row_on_half_of_the_levels_at_most(monkeypatch):
    """Siblings and last leaves come from their parents' histograms, and equal those that are counted."""
    rng = np.random.default_rng(3)
    n, settings = 4000, B.Settings(trees=3, rate=0.3, depth=5, rows=1.0, columns=1.0, bins=16)
    x = rng.random((n, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    plan = B.Plan([np.arange(1, 16) / 16] * 3, [2], [[7, 3, 0]], settings)
    fold = rng.integers(1, 4, n)
    block = B.Block(plan.binned(x), 80 + 9 * np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]), fold, np.arange(n), 1)
    counted, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda values, *more: counted.append(len(values)) or plain(values, *more))
    _, trees = B._fit_block(block, plan)
    mine = np.count_nonzero(fold != 2)
    assert sum(counted) <= 3 * 2 * 3 * mine * (1 + 4 / 2)
    again = B.Block(plan.binned(x), block.target, fold, np.arange(n), 1)
    again.start([again.base(2)[0] / mine / B.UNITS])
    for tree in trees:
        nodes = [i for i in range(32, 64) if tree.cover[i]]
        sums = again.sums(0, tree, 0, nodes, [0], plan)
        assert tree.cover[nodes].tolist() == sums[1, :, 0].sum(1).tolist()
        assert np.array_equal(tree.value[nodes], settings.rate * (sums[0, :, 0].sum(1) / B.UNITS / (sums[1, :, 0].sum(1) + 1.0)))
        again.add(0, tree, plan.missing[0])
    assert np.array_equal(again.predicted[0], block.predicted[0])


def test_blocks_stay_with_the_executors_and_are_made_again_when_lost(spark, monkeypatch):
    """Passes send names of files, not rows; without the files the same trees are grown from all trees so far."""
    import glob
    import shutil

    from pyspark import SparkFiles

    frame, _ = rows(spark)
    one, plain, sent = listed(fit(spark, frame)), B.grown_trees, []

    def lost(number, *more):
        folders = glob.glob(f"{SparkFiles.getRootDirectory()}/boost-*")
        sent.append(len(folders))
        if number in (0, 5):
            for folder in folders:
                shutil.rmtree(folder)
        return plain(number, *more)

    monkeypatch.setattr(B, "grown_trees", lost)
    assert one == listed(fit(spark, frame, task_rows=250)) and len(sent) == 12 and min(sent) > 1
    assert not glob.glob(f"{SparkFiles.getRootDirectory()}/boost-*")


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
def test_packed_histograms_equal_plain_sums(scale):
    """Also where residuals are so large that a number would hold few rows of them."""
    rng = np.random.default_rng(5)
    n, settings = 3000, B.Settings(depth=2, bins=32)
    x = np.column_stack([rng.random(n), rng.integers(0, 3, n) / 4, rng.random(n), rng.random(n)])
    x[rng.random(x.shape) < 0.1] = np.nan
    plan = B.Plan([np.arange(1, 32) / 32, np.array([0.1, 0.3]), np.arange(1, 32) / 32, np.zeros(0)], [3], [[4, 1, 9, 0]], settings)
    fold, target = np.sort(rng.integers(1, 4, n)), scale * rng.normal(size=n)
    block = B.Block(plan.binned(x), target, fold, np.arange(n), 1)
    tree = B.Tree.empty(2)
    tree.feature[1], tree.bin[1] = 2, 9
    used = B.sampled(np.arange(n), 7, settings) & (fold != 3)
    residual = np.floor(target * B.UNITS + 0.5)
    bins = np.where(plan.binned(x) == B.MISSING, [4, 1, 9, 0], plan.binned(x))
    for nodes, inside in (([1], [used]), ([2, 3], [used & (bins[:, 2] <= 9), used & (bins[:, 2] > 9)])):
        found = block.sums(0, tree, 7, nodes, [1, 2, 3], plan)
        for i, rows_of in enumerate(inside):
            for j, f in enumerate((1, 2, 3)):
                assert found[1, i, j].tolist() == np.bincount(bins[rows_of, f], minlength=32).tolist()
                sums = [sum(map(int, residual[rows_of & (bins[:, f] == b)])) for b in range(32)]
                assert found[0, i, j].tolist() == sums
