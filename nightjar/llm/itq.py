"""Embedding near-duplicates: codes by iterative quantisation, multi-index Hamming tables, exact cosine.

Vectors with one label (and one length) are linked if their cosine is at least ``THRESHOLD``.

1. Equal vectors of a label become one vector with a weight.
2. A rotation is learned on a bounded sample: principal axes first, then alternately
   the signs of the rotated points and the orthogonal rotation nearest to these signs
   (Procrustes). The signs are the bits of a code; the sample is centred, so they are balanced. Vectors
   of fewer than ``BITS`` dimensions get several rotations, longer ones their main axes. How far the codes
   of a pair at the threshold lie apart is measured on the sample: at most ``radius`` bits
   in all but ``MISSED`` of trial pairs made at exactly this cosine.
3. Codes are cut into m substrings, each the key of a table. Two codes within ``radius``
   bits have some substring within r = ceil((radius + 1) / m) - 1 bits, so a vector lies at its key in
   each table and visits the greater keys within r bits. m is chosen from the radius and the
   number of vectors that share a label. A pair is counted in the first table whose substrings
   are within r bits, and there at one key, so no pair counts twice.
4. Buckets are compared twice: first by codes alone, which leaves the vectors that have a
   partner within the radius in the bucket; only these are joined with their original vectors,
   and their pairs are reranked by the cosine in double precision. A task returns the number
   of each vector's links and a spanning forest of them; pairs are never written.
5. Components of the forests (alternating stars) are the classes.

Scale: buckets without partners leave before any comparison. Small buckets share a task by hash; a
bucket of more than ``CELL`` vectors is dealt to cells, and each pair of cells is a task's work, so a group of
near copies of a third of all rows is cut evenly. On the driver are the sample
(``SAMPLE`` vectors) and the codes' matrices alone. Memory in a task is bounded by ``CELL`` and ``PAIRS``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
and vectors without a label link with nothing, nor do vectors of unequal lengths; rows
with one id are rows of their own; component_id is the smallest id of the component, null if none has
one, and an unlinked row's own id; kept compares it with vec_id, nulls being equal; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.ann import _matrix, usable
from nightjar.llm.minhash import components
from nightjar.operators.lineage import materialize

THRESHOLD = 0.98
BITS = 64
#: Vectors that the rotation is learned on, at most.
SAMPLE = 16_384
ROUNDS = 40
#: Share of pairs at the threshold that may have codes further apart than the radius, and trial pairs.
MISSED, TRIALS = 5e-4, 40_000
#: Bits by which the codes of a compared pair may differ beyond the radius.
SLACK = 4
#: What a row of a table costs, in comparisons of codes.
ROW_COST = 60
CELL = 1024
#: Rows of a task that holds small buckets, about, and pairs that are compared at a time.
TASK_ROWS, PAIRS = 60_000, 32_768
SEED = 13


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1; first by their largest component, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Coder:
    """Signs of the rotated, centred vector: BITS columns of ``turn`` for each length of vectors."""

    centre: np.ndarray
    turn: np.ndarray

    @staticmethod
    def learned(x: np.ndarray, d: int, seed: int = SEED) -> Coder:
        """From unit vectors (rows); without enough of them from random rotations alone."""
        rng = np.random.default_rng(seed + d)
        width = min(d, BITS)
        enough = len(x) >= 2 * width
        centre = x.mean(0) if enough else np.zeros(d)
        axes = np.eye(d)[:, :width]
        if enough:
            _, vectors = np.linalg.eigh(np.cov((x - centre).T).reshape(d, d))
            axes = vectors[:, ::-1][:, :width]
        points = (x - centre) @ axes if enough else None
        parts = []
        while sum(p.shape[1] for p in parts) < BITS:
            r = np.linalg.qr(rng.standard_normal((width, width)))[0]
            for _ in range(ROUNDS if enough else 0):
                u, _, vt = np.linalg.svd(np.where(points @ r >= 0, 1.0, -1.0).T @ points)
                r = (u @ vt).T
            parts.append(axes @ r)
        return Coder(centre, np.column_stack(parts)[:, :BITS])

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.centre) @ self.turn >= 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()

    def radius(self, x: np.ndarray, threshold: float, seed: int = SEED) -> int:
        """Bits between the codes of two vectors at the threshold, in all but MISSED of the trials."""
        rng = np.random.default_rng(seed)
        d = self.turn.shape[0]
        if d == 1:
            return 0
        x = x if len(x) else unit(rng.standard_normal((256, d)))
        a = x[np.arange(TRIALS) % len(x)]
        side = rng.standard_normal(a.shape)
        side -= (side * a).sum(1, keepdims=True) * a
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold ** 2)) * unit(side)
        return int(np.quantile(np.bitwise_count(self.codes(a) ^ self.codes(b)), 1 - MISSED, method="higher"))


@dataclass
class Tables:
    """m substrings of a code: shifts and widths, and the masks of up to ``reach`` bits within each."""

    shifts: list[int]
    widths: list[int]
    reach: int
    radius: int

    @staticmethod
    def planned(radius: int, partners: float) -> Tables:
        """The cheapest cut whose tables find every pair within the radius; ``partners``: vectors that share a vector's label."""
        def cost(m: int) -> float:
            reach, width = math.ceil((radius + 1) / m) - 1, BITS // m
            visits = (1 + sum(math.comb(width, i) for i in range(min(reach, width) + 1))) / 2
            return m * visits * (ROW_COST + partners / 2 ** width)

        m = min(range(1, min(BITS, radius + 1) + 1), key=cost)
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        shifts = [sum(widths[i + 1:]) for i in range(m)]
        return Tables(shifts, widths, math.ceil((radius + 1) / m) - 1, radius)

    def masks(self, t: int) -> list[int]:
        return [sum(1 << b for b in chosen) for n in range(1, min(self.reach, self.widths[t]) + 1) for chosen in combinations(range(self.widths[t]), n)]

    def places(self, code: Column) -> Column:
        """Array of (t, key, side): the own key of each table (side 0), and the greater keys within reach (side 1)."""
        return F.concat(*[self._places_in(t, code) for t in range(len(self.widths))])

    def _places_in(self, t: int, code: Column) -> Column:
        # A pair meets once: at the greater key, where its highest differing bit is set.
        key = F.shiftrightunsigned(code, self.shifts[t]).bitwiseAND(F.lit((1 << self.widths[t]) - 1 if self.widths[t] < 64 else -1))
        own = F.array(F.struct(F.lit(t).alias("t"), key.alias("key"), F.lit(0).alias("side")))
        if not (masks := self.masks(t)):
            return own
        listed = F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.lit(_signed(1 << m.bit_length() - 1)).alias("top")) for m in masks])
        lower = F.filter(listed, lambda x: key.bitwiseAND(x["top"]) == 0)
        return F.concat(own, F.transform(lower, lambda x: F.struct(F.lit(t).alias("t"), key.bitwiseXOR(x["m"]).alias("key"), F.lit(1).alias("side"))))

    def counted(self, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Which pairs of codes are compared in table t: near enough, and in no earlier table."""
        apart = a ^ b
        near = np.bitwise_count(apart) <= self.radius + SLACK
        for i, (shift, width) in enumerate(zip(self.shifts, self.widths)):
            part = (apart >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            near &= (t <= i) | (np.bitwise_count(part) > self.reach)
        return near


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_pairs(bucket: np.ndarray, side: np.ndarray, within: np.ndarray):
    """Pairs of positions in a bucket (rows sorted by bucket, then side): left with right and, where ``within``, left with left; in chunks."""
    n = len(bucket)
    if n == 0:
        return
    end = np.searchsorted(bucket, bucket, "right")
    turn = np.searchsorted(2 * np.unique(bucket, return_inverse=True)[1] + side, 2 * np.unique(bucket, return_inverse=True)[1] + 1)
    first = np.where(within, np.arange(n) + 1, turn)
    count = np.where(side == 0, end - first, 0)
    rows = np.flatnonzero(count > 0)
    cut = np.cumsum(count[rows])
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(cut, (cut[start - 1] if start else 0) + PAIRS, "right")))
        own, c = rows[start:stop], count[rows[start:stop]]
        i = np.repeat(own, c)
        yield i, np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[own], c)
        start = stop


class Forest:
    """Components of positions, kept as each position's smallest known one."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


PLACED = "part bigint, a int, b int, bucket bigint, side int, t int, rep bigint, code bigint, grp bigint"


def _sorted(group: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], np.ndarray]:
    group = group.sort_by([("bucket", "ascending"), ("side", "ascending"), ("rep", "ascending")])
    rows = {name: group.column(name).to_numpy() for name in ("bucket", "side", "t", "rep", "code", "grp", "a", "b")}
    rows["code"] = rows["code"].astype(np.int64).view(np.uint64)
    return group, rows, rows["a"] == rows["b"]


def _compared(rows: dict[str, np.ndarray], within: np.ndarray, tables: Tables):
    for i, j in bucket_pairs(rows["bucket"], rows["side"], within):
        near = tables.counted(rows["code"][i], rows["code"][j], rows["t"][i]) & (rows["grp"][i] == rows["grp"][j]) & (rows["t"][i] == rows["t"][j])
        yield i[near], j[near]


def _involved(tables: Tables):
    def run(group: pa.Table) -> pa.Table:
        group, rows, within = _sorted(group)
        involved = np.zeros(len(within), bool)
        for i, j in _compared(rows, within, tables):
            involved[i] = involved[j] = True
        return group.filter(pa.array(involved)).select([c.split()[0] for c in PLACED.split(", ")])

    return run


LINKS = "rep bigint, other bigint, links bigint"


def _linked(tables: Tables, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group, rows, within = _sorted(group)
        weight = group.column("n").to_numpy()
        sizes = np.array([len(v) for v in group.column("v")]) if len(group) else np.zeros(0, int)
        links, forest = np.zeros(len(group), np.int64), Forest(len(group))
        # Vectors of one group have one length, but a task may hold several groups.
        number = np.zeros(len(group), np.int64)
        points = {}
        for d in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == d)
            points[d] = unit(_matrix(group.column("v").take(pa.array(mine)), d))
            number[mine] = np.arange(len(mine))
        for i, j in _compared(rows, within, tables):
            for d, x in points.items():
                own = (sizes[i] == d) & (sizes[j] == d)
                near = np.flatnonzero(own)[np.einsum("ij,ij->i", x[number[i[own]]], x[number[j[own]]]) >= threshold]
                np.add.at(links, i[near], weight[j[near]])
                np.add.at(links, j[near], weight[i[near]])
                forest.join(i[near], j[near])
        met, up = np.flatnonzero(links), np.flatnonzero(forest.root != np.arange(len(group)))
        rep = rows["rep"]
        return pa.table({"rep": pa.array(np.concatenate([rep[met], rep[up]]), pa.int64()),
                         "other": pa.array(np.concatenate([np.zeros(len(met), np.int64), rep[forest.root[up]]]), pa.int64(), mask=np.arange(len(met) + len(up)) < len(met)),
                         "links": pa.array(np.concatenate([links[met], np.zeros(len(up), np.int64)]), pa.int64())})

    return run


def _coded(coders: dict[int, Coder]):
    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")])
            for d in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == d))
                coder = coders.get(d) or Coder.learned(np.zeros((0, d)), d)
                codes = coder.codes(unit(_matrix(mine.column("v"), d)))
                yield pa.RecordBatch.from_arrays([mine.column(c) for c in ("rep", "grp", "h1", "h2", "n", "least", "v")] + [pa.array(codes.view(np.int64))], ["rep", "grp", "h1", "h2", "n", "least", "v", "code"])

    return run


def _units(places: DataFrame, parts: int) -> DataFrame:
    """Rows of the buckets that can hold a pair, dealt to tasks: (part, a, b)."""
    sizes = places.groupBy("grp", "t", "key").agg(F.sum(1 - F.col("side")).alias("homes"), F.count(F.lit(1)).alias("all")).filter("homes > 0 and all > 1")
    rows = places.join(sizes, ["grp", "t", "key"]).withColumn("bucket", F.xxhash64("grp", "t", "key"))
    cells = F.ceil(F.col("homes") / CELL).cast("int")
    guests = F.ceil((F.col("all") - F.col("homes")) / CELL).cast("int")
    small = (cells == 1) & (guests <= 1)
    cell = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.when(F.col("side") == 0, cells).otherwise(guests)).cast("int")
    unit_of = lambda part, a, b, side: F.struct(part.alias("part"), a.alias("a"), b.alias("b"), side.alias("side"))
    whole = F.array(unit_of(F.pmod(F.col("bucket"), F.lit(parts)), F.lit(-1), F.lit(-1), F.col("side")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # A home meets the homes of all cells (its own cell once) and the guests of all cells; cells of guests are numbered after those of homes.
    homes = F.transform(upto(cells), lambda c: unit_of(F.col("bucket"), F.least(F.col("cell"), c), F.greatest(F.col("cell"), c), F.when(c < F.col("cell"), 1).otherwise(0)))
    hosted = F.when(guests > 0, F.transform(upto(F.greatest(guests, F.lit(1))), lambda g: unit_of(F.col("bucket"), F.col("cell"), cells + g, F.lit(0))))
    visits = F.transform(upto(cells), lambda c: unit_of(F.col("bucket"), c, cells + F.col("cell"), F.lit(1)))
    units = F.when(small, whole).when(F.col("side") == 1, visits).when(guests > 0, F.concat(homes, hosted)).otherwise(homes)
    dealt = rows.withColumn("cell", cell).withColumn("unit", F.explode(units))
    return dealt.select("unit.part", "unit.a", "unit.b", "bucket", "unit.side", "t", "rep", "code", "grp")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & usable(F.col("v"))
    hashed = named.withColumn("h1", F.when(fit, F.xxhash64("label", "v"))).withColumn("h2", F.when(fit, F.xxhash64(F.lit(SEED), F.col("v"), F.col("label"))))
    distinct = (hashed.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
                .select(F.monotonically_increasing_id().alias("rep"), F.xxhash64("label", F.size("v")).alias("grp"), "h1", "h2", "n", "least", "v"))
    reps = materialize(distinct, "itq-vectors")
    id_type = dict(reps.dtypes)["least"]
    sample = reps.select("v").orderBy(F.xxhash64("v", F.lit(SEED)), "v").limit(SAMPLE).toArrow().column("v")
    lengths = np.array([len(v) for v in sample], int)
    coders, radius = {}, 0
    for d in np.unique(lengths).tolist():
        x = unit(_matrix(sample.take(pa.array(np.flatnonzero(lengths == d))), d))
        coders[d] = Coder.learned(x, d)
        radius = max(radius, coders[d].radius(x, threshold))
    shape = reps.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    tables = Tables.planned(radius, (shape["nn"] or 0) / max(1, shape["n"] or 0))
    coded = materialize(reps.mapInArrow(_coded(coders), f"rep bigint, grp bigint, h1 bigint, h2 bigint, n bigint, least {id_type}, v array<double>, code bigint"), "itq-codes")
    places = coded.select("rep", "grp", "code", F.explode(tables.places(F.col("code"))).alias("p")).select("rep", "grp", "code", "p.t", "p.key", "p.side")
    rows_per_vector = sum((1 + len(tables.masks(t))) for t in range(len(tables.widths)))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((shape["n"] or 0) * rows_per_vector / TASK_ROWS))
    unit_key = ["part", "a", "b"]
    involved = materialize(_units(places, parts).groupBy(*unit_key).applyInArrow(_involved(tables), PLACED), "itq-candidates")
    whole = involved.join(coded.select("rep", "v", "n"), "rep")
    found = materialize(whole.groupBy(*unit_key).applyInArrow(_linked(tables, threshold), LINKS), "itq-links")
    links = found.filter(F.col("other").isNull()).groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.filter(F.col("other").isNotNull()).select(F.col("rep").alias("x"), F.col("other").alias("y")))
    placed = (coded.select("rep", "h1", "h2", "n", "least").join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("smallest"))
    facts = placed.join(smallest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "smallest")
    out = hashed.select("id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
