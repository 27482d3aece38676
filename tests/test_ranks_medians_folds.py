import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.folds import GroupedValidationError, attach_folds, check_participants, deal_class, \
    fold_overlap, participant_folds
from nightjar.operators.impute import fold_medians
from nightjar.operators.ranks import average_ranks, row_positions


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_average_ranks_match_pandas(spark, buckets):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 3, 400)
    v = rng.integers(0, 25, 400).astype(float)
    pdf = pd.DataFrame({"g": g, "v": v})
    keys = spark.createDataFrame(pdf).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = average_ranks(keys, "v", "n", ["g"], buckets).toPandas()
    expect = pdf.assign(r=pdf.groupby("g")["v"].rank(method="average")).drop_duplicates(["g", "v"])
    merged = expect.merge(got, on=["g", "v"])
    assert len(merged) == len(expect)
    assert np.allclose(merged["r"], merged["avg_rank"])


def test_row_positions_are_a_permutation(spark):
    df = spark.range(0, 500).withColumn("k", (F.col("id") * 7919) % 500)
    out = row_positions(df, [F.col("k").desc()], 5).toPandas()
    assert sorted(out["position"]) == list(range(1, 501))
    assert (out.sort_values("position")["k"].diff().dropna() < 0).all()


def test_fold_medians_match_numpy(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({f: rng.integers(0, 9, n).astype(float) for f in K.MODEL_FEATURES})
    pdf["fold"] = rng.integers(1, 4, n)
    pdf.loc[rng.random(n) < 0.2, "rmssd"] = np.nan
    pdf["day_cos"] = np.nan  # an all-missing feature
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    med = fold_medians(df, 3, num_buckets=4).toPandas()
    for k in range(0, 4):
        part = pdf if k == 0 else pdf[pdf["fold"] != k]
        for f in K.MODEL_FEATURES:
            row = med[(med["fold"] == k) & (med["feature"] == f)].iloc[0]
            expect = part[f].median()
            if np.isnan(expect):
                assert pd.isna(row["median"]) and row["n_values"] == 0
            else:
                assert row["median"] == pytest.approx(expect)


def grouped_rows(spark):
    parts = [f"p{i}" for i in range(6)]
    return spark.createDataFrame([(p, j) for p in parts for j in range(3)], "participant_id string, j int")


@pytest.mark.parametrize("buckets", [1, 16])
def test_folds_are_disjoint_and_balanced(spark, buckets):
    rows = grouped_rows(spark)
    folds = participant_folds(rows, 3, num_buckets=buckets)
    check_participants(folds, 3)
    wf = attach_folds(rows, folds)
    sizes = wf.groupBy("fold").count().toPandas().set_index("fold")["count"]
    assert sorted(sizes.index) == [1, 2, 3] and set(sizes) == {6}
    ov = fold_overlap(wf).toPandas()
    assert (ov["participant_overlap_count"] == 0).all()


def test_fold_assignment_invariant_to_buckets(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"participant_id": [f"u{int(x)}" for x in rng.integers(0, 40, 600)]})
    df = spark.createDataFrame(pdf)
    a = participant_folds(df, 5, num_buckets=1).toPandas().sort_values("participant_id").reset_index(drop=True)
    b = participant_folds(df, 5, num_buckets=9).toPandas().sort_values("participant_id").reset_index(drop=True)
    assert a.equals(b)


def one_by_one(sizes, k):
    """Fold of each size, given in falling order: the lightest one, the first of equally light ones."""
    held, folds = [0] * k, []
    for size in sizes:
        lightest = min(range(k), key=lambda f: (held[f], f))
        held[lightest] += size
        folds.append(lightest + 1)
    return folds, held


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(200, 3000), max_size=3), st.integers(0, 300), st.integers(2, 7))
def test_dealing_a_class_is_dealing_one_by_one(middling, giants, ones, k):
    sizes = sorted(middling + giants + [1] * ones, reverse=True)
    held, folds = [0] * k, []
    for size in sorted(set(sizes), reverse=True):
        rounds = deal_class(held, size, sizes.count(size))
        assert len(rounds) <= k
        for place in range(sizes.count(size)):
            start, turn = [r for r in rounds if r[0] <= place][-1]
            folds.append(turn[(place - start) % len(turn)])
    assert (folds, held) == one_by_one(sizes, k)


MIDDLING = [97 - i % 60 for i in range(400)]


@pytest.mark.parametrize("sizes, k", [([2000] + [10] * 800, 5), ([3000, 500, 500] + [1] * 5000, 3), ([700, 600, 500, 400] + [3] * 1000, 4), ([1] * 3001, 5), (MIDDLING, 5), (MIDDLING + [5000, 4000], 10)])
def test_every_participant_goes_to_the_lightest_fold(spark, sizes, k, monkeypatch):
    from nightjar.operators import folds as module

    monkeypatch.setattr(module, "BROADCAST_CLASSES", 20)  # joined with and without a broadcast
    rows = spark.createDataFrame([(f"p{i:05d}", n) for i, n in enumerate(sizes)], "participant_id string, n int").selectExpr("participant_id", "explode(sequence(1, n)) as j")
    got = participant_folds(rows, k, num_buckets=7).toPandas().sort_values(["n_rows", "participant_id"], ascending=[False, True])
    expected, held = one_by_one(sorted(sizes, reverse=True), k)
    assert list(got["fold"]) == expected and list(got["n_rows"]) == sorted(sizes, reverse=True)
    assert list(got.groupby("fold")["n_rows"].sum()) == held


def test_folds_of_an_empty_table(spark):
    assert participant_folds(spark.createDataFrame([], "participant_id string"), 3).collect() == []


def test_too_few_participants(spark):
    rows = grouped_rows(spark)
    with pytest.raises(GroupedValidationError, match="at least 7 participants; found 6"):
        check_participants(participant_folds(rows, 7), 7)


@pytest.mark.parametrize("margin, sketch", [(0.01, 2048), (0.001, 8)])
def test_medians_by_selection_are_exact(spark, monkeypatch, margin, sketch):
    """Ties, hot values and signs; a coarse sketch with narrow brackets has to widen them."""
    from nightjar.operators import impute

    monkeypatch.setattr(impute, "SKETCH_K", sketch)
    rng = np.random.default_rng(11)
    n = 4000
    pdf = pd.DataFrame({"spread": rng.normal(0, 1e6, n), "hot": np.where(rng.random(n) < 0.4, 3.5, rng.normal(3.5, 1, n)),
                        "two": np.where(np.arange(n) % 2, -1.0, 1.0), "one": 7.0, "none": np.nan, "rare": np.where(rng.random(n) < 0.001, rng.random(n), np.nan)})
    pdf["fold"] = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 4, n))
    names = [c for c in pdf.columns if c != "fold"]
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = fold_medians(df, 3, names, margin=margin).toPandas().set_index(["fold", "feature"])
    for k in range(4):
        part = pdf[pdf["fold"] != k] if k else pdf
        for f in names:
            assert got.loc[(k, f), "n_values"] == part[f].notna().sum()
            assert got.loc[(k, f), "median"] == pytest.approx(part[f].median(), rel=1e-15, nan_ok=True)
    ranked = fold_medians(df, 3, names, num_buckets=3, margin=margin).toPandas().set_index(["fold", "feature"])
    pd.testing.assert_frame_equal(ranked, got)


def test_medians_of_an_empty_table(spark):
    got = fold_medians(spark.createDataFrame([], "fold int, x double"), 2, ["x"]).collect()
    assert [tuple(r) for r in got] == [(k, "x", None, 0) for k in range(3)]


@pytest.mark.parametrize("buckets", [1, 4, 13])
def test_spearman_matches_ranks_of_all_rows(spark, buckets):
    """Hot values that fill several buckets, ties on both sides, a constant fold, one row, empty values."""
    from nightjar.operators.metrics import spearman

    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({"fold": rng.integers(1, 4, n), "a": np.where(rng.random(n) < 0.6, 80.0, rng.integers(60, 99, n)), "p": rng.normal(80, 9, n)})
    pdf.loc[rng.random(n) < 0.3, "p"] = 81.5
    pdf.loc[:40, ["a", "p"]] = [-0.0, 0.0]
    pdf = pd.concat([pdf, pd.DataFrame({"fold": 4, "a": 5.0, "p": rng.normal(0, 1, 30)}), pd.DataFrame({"fold": [5], "a": [1.0], "p": [2.0]})], ignore_index=True)
    rows = [(int(f), float(a), float(p)) for f, a, p in pdf.itertuples(index=False)] + [(1, None, 2.0), (2, 3.0, None)]
    got = {r[0]: r[1] for r in spearman(spark.createDataFrame(rows, "fold int, a double, p double"), "fold", "a", "p", buckets).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5} and got[4] is None and got[5] is None
    for k in range(4):
        part = pdf if k == 0 else pdf[pdf["fold"] == k]
        assert got[k] == pytest.approx(part["a"].rank().corr(part["p"].rank()), abs=1e-12)


def test_spearman_joins_no_rows_with_ranks(spark):
    """Every join of the plan has a broadcast side of at most a few rows a bucket."""
    from nightjar.operators.metrics import spearman

    preds = spark.range(500).selectExpr("cast(id % 3 + 1 as int) fold", "cast(id % 37 as double) a", "cast(id * id % 101 as double) p")
    plan = spearman(preds, "fold", "a", "p", 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
