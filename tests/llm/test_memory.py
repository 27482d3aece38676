"""What a Python worker holds at once doesn't follow its block, its batch or its longest text."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from nightjar.llm import minhash as M
from nightjar.llm import pieces as P
from nightjar.llm import sp_codec, toxicity
from nightjar.llm.catalog import PIECE_MODEL
from nightjar.session import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def most(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_runs_are_hashed_in_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 0x3000, 2_000_000).astype("<u4")
    bounds = np.unique(np.concatenate([[0, 1_000_000, 1_300_000], rng.integers(1_300_000, 2_000_000, 100_000)]))
    P.run_hashes(codes[:400_000], np.array([0]), np.array([400_000]), 0)
    got, mb = most(lambda: P.run_hashes(codes, bounds[2:-1], bounds[3:], 0))
    assert mb < 12 and len(got) == len(bounds) - 3
    monkeypatch.setattr(P, "STRETCH", 1 << 22)
    whole = P.run_hashes(codes, bounds[:-1], bounds[1:], 0)
    assert (whole[2:] == got).all()
    monkeypatch.setattr(P, "STRETCH", 1 << 10)  # runs longer than a stretch
    assert (P.run_hashes(codes, bounds[:-1], bounds[1:], 0) == whole).all()


def test_samples_are_drawn_in_turns(monkeypatch):
    rng = np.random.default_rng(2)
    h, w = rng.integers(1, 1 << 62, 60_000).astype(np.uint64), rng.uniform(0.5, 4, 60_000)
    starts = np.array([0, 30, 40, 20_000, 20_001])  # the last text has 39,999 elements
    got, mb = most(lambda: M.samples(h, w, starts))
    assert mb < 30
    monkeypatch.setattr(M, "CELLS", 1 << 23)
    assert (M.samples(h, w, starts) == got).all()


@pytest.mark.parametrize("operator", ["minhash", "encode", "toxicity"])
def test_batches_of_long_texts_are_bounded(spark, operator):
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id as doc_id", "repeat('abcd efghi ', 1000) as text")  # 33 MB in one partition
    chain = toxicity.Chain(["toxic"], [toxicity.Linear(np.zeros(2 * toxicity.BUCKETS, np.float32), np.zeros(0), 0.0)], [1.0])
    spark.conf.unset(KEY)
    {"minhash": lambda: M.text_classes(docs.limit(2)), "encode": lambda: sp_codec.encode(docs, PIECE_MODEL), "toxicity": lambda: toxicity.score(docs, chain)}[operator]()

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    rows = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in rows) == 3_000 and max(r.bytes for r in rows) < 1.2 * BATCH_BYTES
