import hashlib
import re

import pytest
from nightjar.llm import spotsigs as S
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, spots string"


def spots(text):
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    found = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            chain = [x for x in words[i + 1:] if x not in S.ANCHORS][:S.CHAIN]
            if len(chain) == S.CHAIN:
                found.add((w, *chain))
    return found or {("whole", *words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t, *_) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + following[:cut]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(spots(t), spots(edited)), jaccard(spots(t), spots(following)))
    return out


def check(spark, rows, monkeypatch=None):
    got = S.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, near = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(near)
    return got


def test_small_table_with_odd_texts(spark):
    rows = [(5, "the quick fox and the lazy dog of a house", "x"), (3, "the quick fox and the lazy dog of a house", None), (9, None, None), (1, "", None), (7, "no anchor words here", None),
            (8, "The THE the", None), (2, "ün die schöne Straße und der alte Baum 😀 im Wald", None), (12, "the " * 2_000 + "end of it", None), (None, "is it so", None)]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[5].fingerprint == got[3].fingerprint and got[9].fingerprint == got[1].fingerprint != ""


def test_many_cells_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 7)
    rows = [(i * i, f"the word{i} of the tree{i % 5} and a leaf{i % 3} in the sun " * (1 + i % 4), None) for i in range(60)]
    check(spark, rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_single_repeated_and_no_rows(spark):
    one = check(spark, [(4, "the only text of all", None)])
    assert one[0].near_next == 1
    same = S.edited_likeness(spark.createDataFrame([(4, "the one text of all", None)] * 5, SCHEMA)).collect()
    assert len(same) == 5 and {r.near_next for r in same} == {1.0}
    assert S.edited_likeness(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similar_pairs_are_exact(spark):
    rows = []
    for g in range(30):
        base = " ".join(f"the a{g}x{k} b{g}y{k}" for k in range(20))
        rows += [(g * 10 + v, base.replace(f"a{g}x{v}", f"z{g}{v}") if v else base) for v in range(4)]
    sets = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc_id").alias("key"), "spots")
    truth = {r.key: set(r.spots) for r in sets.collect()}
    for t in (0.5, 0.8, 0.95):
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in S.similar_pairs(sets, t).collect()}
        assert got == {(a, b) for a in truth for b in truth if a < b and jaccard(truth[a], truth[b]) >= t}
