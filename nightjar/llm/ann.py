"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Largest inner products are nearest points once every vector gets one more
dimension that brings all vectors to the same length; queries get a zero there.
Vectors are then turned by a seeded random rotation, which spreads every
vector's length evenly over the dimensions, so the first d of D dimensions give
an estimate of a distance that is off by a known amount. k-means centres, fitted
on the larger part of a bounded sample, deal all vectors to lists; a query visits
its nearest lists, as many as trial queries need to find their neighbours among the
vectors of the sample that were held out from the fit. Inside a list vectors lie in blocks of columns: distances are summed
block by block, and after each block a hypothesis test drops the candidates
whose partial distance is already too large for their full distance to be below
the query's bound; a block is computed for all queries of a task at once. The bound starts at the query's k-th distance within the
sample and falls as the list's own candidates are completed. The sample gives
bounds only: a query that finds fewer than k asks again without a bound, and visits
further lists, nearest first, until it has k or has seen all. What is left is
scored by the inner product of the original vectors in double precision, summed
in order of the dimensions.

Scale: the sample (``SAMPLE`` vectors) and the centres, at most ``MAX_LISTS``, are
the only data on the driver. Lists are dealt to cells of about ``CELL`` vectors by a
hash of the id, queries of a list to groups of ``CELL``, so a list that holds a third
of all vectors, or of all queries, is many tasks' work. Per query and cell only
the best k leave a task.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither as queries nor as candidates; nor do those
whose length is not the commonest one; ids that are null take no part; rows
with one id are candidates of their own if their vectors score differently, a
query with that id skips them, and the smallest of their vectors asks;
fewer than k candidates in the whole table are all returned; ties go to
the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightjar.operators.lineage import materialize

K = 20
QUERY_STEP = 20
#: Vectors that give the first bounds, at most; all but the share HELD_OUT fit the centres.
SAMPLE = 16_384
HELD_OUT = 0.25
#: Vectors that fit a centre, at least.
POINTS = 16
#: Vectors in a list, about, as long as there are at most MAX_LISTS lists.
LIST = 512
MAX_LISTS = 4096
#: Held-out queries that set how many lists a query visits, and the share of their held-out neighbours that these lists must hold.
TRIALS, COVERED = 256, 0.96
CELL = 4096
#: Dimensions of a column block.
STEP = 16
#: Pairs of a query and a vector whose partial distances a task holds at once; the share of them, as 1 / SPARSE, from which on they are computed singly.
PAIRS, SPARSE = 1 << 18, 16
#: Standard errors that a partial distance may be off before its candidate is dropped.
EPSILON = 2.1
SEED = 9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _centres(points: np.ndarray, n: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n]].copy()
    for _ in range(rounds):
        at = _nearest(points, centres, 1)[:, 0]
        held = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest centres of each point, nearest first."""
    n = min(n, len(centres))
    out = np.zeros((len(points), n), np.int64)
    half = (centres ** 2).sum(1) / 2
    for i in range(0, len(points), 4096):
        far = half - points[i:i + 4096] @ centres.T
        part = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable")
        out[i:i + 4096] = np.take_along_axis(part, order, 1)
    return out


class Index:
    """What every task needs: rotation, centres, the common length and the sample in rotated form."""

    def __init__(self, sample: np.ndarray, n_rows: int, longest: float, k: int):
        self.d, self.k, self.longest = sample.shape[1], k, longest
        self.sample_vectors = sample
        self.turn = rotation(self.d + 1)
        self.sample = self.rotated(sample, False)
        # The sample comes in hash order, so any part of it is a random one.
        out = int(HELD_OUT * len(sample))
        fit = len(sample) - out
        lists = max(1, min(MAX_LISTS, math.ceil(n_rows / LIST), fit // POINTS))
        self.centres = _centres(self.sample[:fit], lists)
        self.probes = self._probes(fit)

    def _probes(self, fit: int) -> int:
        """The fewest lists that hold COVERED of the trial queries' k nearest among the held-out vectors."""
        others = self.sample[fit:]
        trials = self.rotated(self.sample_vectors[fit:][:TRIALS], True)
        if len(others) < 2 or len(self.centres) == 1:
            return len(self.centres)
        far = (others ** 2).sum(1) - 2 * (trials @ others.T)
        far[np.arange(len(trials)), np.arange(len(trials))] = np.inf  # itself
        near = np.argsort(far, axis=1, kind="stable")[:, :min(self.k, len(others) - 1)]
        home = _nearest(others, self.centres, 1)[:, 0]
        place = np.argsort(_nearest(trials, self.centres, len(self.centres)), axis=1)
        return int(np.quantile(np.take_along_axis(place, home[near], 1), COVERED, method="higher")) + 1

    def rotated(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """With queries scaled to the common length, which leaves the order of their products as it is."""
        lengths = np.sqrt((vectors ** 2).sum(1))
        if queries:
            vectors = vectors * (self.longest / lengths)[:, None]
            last = np.zeros(len(vectors))
        else:
            last = np.sqrt(np.maximum(0, self.longest ** 2 - lengths ** 2))
        return np.column_stack([vectors, last]) @ self.turn

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The squared distance within which the k + 1 nearest of the sample lie (one more, for the query itself)."""
        bounds = np.full(len(queries), np.inf)
        own = (self.sample ** 2).sum(1)
        for i in range(0, len(queries), 1024):
            q = queries[i:i + 1024]
            far = own - 2 * (q @ self.sample.T) + (q ** 2).sum(1)[:, None]
            if len(self.sample) > self.k:
                bounds[i:i + 1024] = np.partition(far, self.k, axis=1)[:, self.k]
        return np.maximum(bounds, 0) * (1 + 1e-9) + 1e-9 * self.longest ** 2


def scan_many(queries: np.ndarray, columns: list[np.ndarray], bounds: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and squared distance of the pairs that survive the column blocks. ``columns``: blocks (rows x dimensions); ``slack``: rounding of a distance.

    A block is a product of matrices for all pairs while many are left, and is computed for single pairs after that.
    """
    width = sum(c.shape[1] for c in columns)
    n, own = len(columns[0]), [np.einsum("ij,ij->i", c, c) for c in columns]
    step, out = max(1, PAIRS // max(1, n)), []
    for a in range(0, len(queries), step):
        q, bound = queries[a:a + step], bounds[a:a + step]
        far, alive, at = np.zeros((len(q), n)), np.ones((len(q), n), bool), 0
        asks = rows = np.zeros(0, np.int64)
        dense = True
        for block, length in zip(columns, own):
            part = q[:, at:at + block.shape[1]]
            at += block.shape[1]
            if dense:
                far += length + np.einsum("ij,ij->i", part, part)[:, None] - 2 * (part @ block.T)
            else:
                gap = block[rows] - part[asks]
                far += np.einsum("ij,ij->i", gap, gap)
            if at < width:
                most = bound * (1 + EPSILON / math.sqrt(at)) ** 2 * (at / width) + slack
                if dense:
                    alive &= far <= most[:, None]
                    if np.count_nonzero(alive) * SPARSE <= alive.size:
                        dense, (asks, rows) = False, np.nonzero(alive)
                        far = far[asks, rows]
                else:
                    kept = far <= most[asks]
                    asks, rows, far = asks[kept], rows[kept], far[kept]
        if dense:
            asks, rows = np.nonzero(alive)
            far = far[asks, rows]
        kept = far <= bound[asks] + slack
        asks, rows, far = asks[kept], rows[kept], far[kept]
        order = np.lexsort((far, asks))
        asks, rows, far = asks[order], rows[order], far[order]
        first = np.searchsorted(asks, np.arange(len(q)))
        held = np.diff(np.append(first, len(asks)))
        last = np.full(len(q), np.inf)  # one more than k: the query itself may be among them
        last[held > k + 1] = far[first[held > k + 1] + k] * (1 + 1e-9) + slack
        kept = far <= last[asks]
        out.append((asks[kept] + a, rows[kept], far[kept]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def scan(query: np.ndarray, columns: list[np.ndarray], bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that survive the column blocks and their squared distances, for one query."""
    return scan_many(query[None], columns, np.array([bound]), k, 1e-12)[1:]


def pair_products(queries: np.ndarray, vectors: np.ndarray, asks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of a query and a vector, summed in order of the dimensions."""
    total = np.zeros(len(asks))
    step = max(1, PAIRS // vectors.shape[1])
    for a in range(0, len(asks), step):
        x, q = vectors[rows[a:a + step]], queries[asks[a:a + step]]
        for j in range(x.shape[1]):
            total[a:a + step] += x[:, j] * q[:, j]
    return total


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def search(vectors: DataFrame, is_query: Column, k: int = K, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found in its lists of every row with ``is_query``."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    good = named.filter(F.col("id").isNotNull() & usable(F.col("v")))
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    common = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], shape)
    d, n_rows = common["d"], common["n"]
    base = good.filter(F.size("v") == d)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = float(base.agg(F.max(norm)).first()[0])
    chosen = base.select("id", "v").orderBy(F.xxhash64("id", "v", F.lit(SEED)), "id").limit(SAMPLE).toArrow()
    index = vectors.sparkSession.sparkContext.broadcast(Index(_matrix(chosen.column("v"), d), n_rows, longest, k))

    def place(batches):
        own = index.value
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            turned = own.rotated(x, False)
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(turned, own.centres, 1)[:, 0], pa.int32()), batch.column("id"), batch.column("v")], ["list", "id", "v"])

    def asker(least: int, bounded: bool):
        """Queries go to the lists to visit, and to further ones until these hold ``least`` vectors."""
        def ask(batches):
            own = index.value
            for batch in batches:
                q = own.rotated(_matrix(batch.column("v"), d), True)
                near = _nearest(q, own.centres, len(own.centres))
                before = np.cumsum(held_by[near], axis=1) - held_by[near]
                row, place = np.nonzero((np.arange(near.shape[1]) < (probes or own.probes)) | (before < least))
                bounds = own.bounds(q) if bounded else np.full(len(q), np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, place], pa.int32()), batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)),
                                                  pa.array(bounds[row])], ["list", "id", "v", "bound"])
        return ask

    lists = materialize(base.select("id", "v").mapInArrow(place, "list int, id bigint, v array<double>"), "ann-lists")
    asking = base.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    held_by = np.zeros(len(index.value.centres), np.int64)  # one number per list, at most MAX_LISTS
    for r in lists.groupBy("list").count().collect():
        held_by[r["list"]] = r["count"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = index.value
        x, q = _matrix(left.column("v"), d), _matrix(right.column("v"), d)
        ids, bounds = left.column("id").to_numpy(), right.column("bound").to_numpy()
        turned = own.rotated(x, False) if len(x) else np.zeros((0, d + 1))
        columns = [np.ascontiguousarray(turned[:, i:i + STEP]) for i in range(0, d + 1, STEP)]
        asked_ids = right.column("id").to_numpy()
        asks, rows = scan_many(own.rotated(q, True), columns, bounds, own.k, 1e-9 * own.longest ** 2)[:2] if len(q) and len(x) else (np.zeros(0, np.int64),) * 2
        other = ids[rows] != asked_ids[asks]
        asks, rows = asks[other], rows[other]
        score = pair_products(q, x, asks, rows)
        order = np.lexsort((ids[rows], -score, asks))
        asks, rows, score = asks[order], rows[order], score[order]
        best = np.arange(len(asks)) - np.searchsorted(asks, asks) < own.k
        return pa.table({"query_id": pa.array(asked_ids[asks[best]], pa.int64()), "vec_id": pa.array(ids[rows[best]], pa.int64()), "score": pa.array(score[best], pa.float64())})

    keys = ["list", "cell", "grp"]
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(asking: DataFrame, least: int, bounded: bool) -> DataFrame:
        asked = materialize(asking.mapInArrow(asker(least, bounded), "list int, id bigint, v array<double>, bound double"), "ann-queries")
        # How many cells a list's vectors, and a list's queries, are dealt to: two numbers per list, at most MAX_LISTS rows.
        cells = F.broadcast(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
                            .join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("groups")), "list"))
        held = (lists.join(cells, "list").withColumn("cell", F.pmod(F.xxhash64("id", "v"), F.col("cells")).cast("int"))
                .withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("list", "cell", "grp", "id", "v"))
        probing = (asked.join(cells, "list").withColumn("grp", F.pmod(F.xxhash64("id", "v"), F.col("groups")).cast("int"))
                   .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("list", "cell", "grp", "id", "v", "bound"))
        found = held.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double").distinct()
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return materialize(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ann-found")

    done, least, bounded = [], k + 1, True
    while True:
        found = answers(asking, least, bounded)
        full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
        short = asking.join(full, "id", "left_anti")
        if least > n_rows and not bounded or short.isEmpty():
            done.append(found)
            break
        done.append(found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi"))
        # Without a bound first; then lists that hold four times as many, up to all.
        asking, least, bounded = materialize(short, "ann-short"), least if bounded else 4 * least, False
    return functools.reduce(DataFrame.unionByName, done).select(*(c.split()[0] for c in shape.split(", ")))
