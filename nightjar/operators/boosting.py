"""Gradient-boosted regression trees by histograms, for all folds and the final fit at once.

A feature is cut into at most ``bins`` bins, from one sketch pass over the training
rows; a row becomes one byte per feature. Every level of every tree needs the sums of
residuals and the number of rows per (model, node, feature, bin), and a split is
chosen from these alone. The models of all folds share the rows and each pass: a row counts in
every model that doesn't hold out its fold. Missing values go where the model's median goes.

Residuals are counted in units of 1 / ``UNITS``, so all sums are whole numbers: trees don't
depend on the order or partitioning of rows. Rows (by a key) and columns are sampled per
tree by arithmetic on key, tree and seed.

Of two children only the one with fewer rows is counted, the other is what its parent has
more; the totals of leaves on the last level are known from their parents' histograms. So a tree takes ``depth``
passes, all but the first over at most half of the rows. All sums being whole numbers, this changes no tree.

Up to ``TASK_ROWS`` rows (one byte per feature; twice as many for several models) are one block, and the rounds of a
model run inside one task, the models side by side. More rows are several blocks, one a core at least, which all
models share: they are files of the executors, mapped into memory by the workers, and a pass is one job that
adds up the blocks' histograms, whose size the parameters set (on the executors, when there are more than
``DRIVER_BLOCKS``). Both give the same trees. So a job sends neither rows nor predictions to the workers; when an executor
is lost, the blocks are made again and all trees so far are added to them.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.lineage import materialize

MISSING = 255
UNITS = float(1 << 20)
TASK_ROWS = 1_000_000
#: The most rows of a block, if there is more than one.
BLOCK_ROWS = 4_000_000
#: The driver itself adds up the histograms of at most this many blocks.
DRIVER_BLOCKS = 32
#: A split has to gain more than this.
LEAST_GAIN = 1e-6
#: Rows that are worked on together; a row's worth in packed histograms, the most rows of one and its most places a node.
CHUNK, ONE, MOST_ROWS, MOST_PLACES = 1 << 16, 1 << 46, 1 << 17, 1 << 13
#: Fixed values of the sampling arithmetic; all products stay below 2^63.
MODULUS, KEY_FACTOR, TREE_FACTOR = 2_147_483_647, 48_271, 16_950_463
NODES = "model int, tree int, node int, feature int, threshold double, value double, cover bigint"


@dataclass(frozen=True)
class Settings:
    trees: int = K.GBT_PARAMS["n_estimators"]
    rate: float = K.GBT_PARAMS["learning_rate"]
    depth: int = K.GBT_PARAMS["max_depth"]
    least_rows: int = K.GBT_PARAMS["min_child_weight"]
    rows: float = K.GBT_PARAMS["subsample"]
    columns: float = K.GBT_PARAMS["colsample"]
    seed: int = K.GBT_PARAMS["seed"]
    #: L2 penalty of leaf values.
    penalty: float = 1.0
    bins: int = 64


def sampling_key(key: np.ndarray) -> np.ndarray:
    """The part of the sampling arithmetic that is the same for all trees."""
    return key % MODULUS * KEY_FACTOR % MODULUS


def sampled(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Whether a tree uses a row."""
    return sampled_by(sampling_key(key), tree, settings)


def sampled_by(start: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """The same by its ``sampling_key``."""
    out = np.empty(len(start), bool)
    for i in range(0, len(start), CHUNK):
        x = start[i:i + CHUNK] + (settings.seed + tree * TREE_FACTOR) % MODULUS
        x -= MODULUS * (x >= MODULUS)
        x *= x
        # The modulus is 2^31 - 1: what is above 31 bits counts as often as what is below.
        x = (x & MODULUS) + (x >> 31)
        x -= MODULUS * (x >= MODULUS)
        np.less(x, settings.rows * MODULUS, out=out[i:i + CHUNK])
    return out


def tree_columns(tree: int, n: int, settings: Settings) -> list[int]:
    """The features that a tree may split on, in order."""
    order = sorted(range(n), key=lambda f: (((f + 1) * KEY_FACTOR + settings.seed + tree * TREE_FACTOR) % MODULUS) ** 2 % MODULUS)
    return sorted(order[:max(1, int(settings.columns * n))])


def sketched_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of all bins but the last, from the features' approximate quantiles: one pass."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def even_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """The same from equal steps between a feature's least and greatest value."""
    row = train.agg(*[F.struct(F.min(F.col(f).cast("double")).alias("a"), F.max(F.col(f).cast("double")).alias("b")).alias(f) for f in features]).first()
    return [np.unique([row[f]["a"] + (row[f]["b"] - row[f]["a"]) * i / bins for i in range(1, bins)]) if row[f]["a"] is not None else np.zeros(0) for f in features]


@dataclass(frozen=True)
class Plan:
    """What all tasks need: edges, each model's held-out fold (0: none) and the bin of a missing value."""

    edges: list[np.ndarray]
    held_out: list[int]
    missing: list[list[int]]
    settings: Settings

    @property
    def width(self) -> int:
        return self.settings.bins

    @cached_property
    def sizes(self) -> list[int]:
        """By feature its bins and a last one for missing values."""
        return [len(edges) + 2 for edges in self.edges]

    @cached_property
    def groups(self) -> list[list[int]]:
        """Features that are counted together, in a table of all combinations of their bins: few enough of these, but as many features as fit."""
        groups: list[list[int]] = []
        for f in sorted(range(len(self.edges)), key=lambda f: -self.sizes[f]):
            fits = [group for group in groups if math.prod(self.sizes[g] for g in (f, *group)) <= MOST_PLACES]
            if fits:
                fits[0].append(f)
            else:
                groups.append([f])
        return groups

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.full(values.shape, MISSING, np.uint8)
        for f, edges in enumerate(self.edges):
            known = ~np.isnan(values[:, f])
            out[known, f] = np.searchsorted(edges, values[known, f], "left")
        return out


@dataclass
class Tree:
    """Nodes by heap number (root 1): the feature and bin of a split or -1, the leaf's value, the rows."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 << depth
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64))


class Block:
    """Rows of the training table, as all models see them: bins by feature, target, fold and sampling key, and each model's predictions so far.

    Work goes chunk by chunk, so that what it touches stays in the processor's cache; a chunk without a row of a model is left out, so
    rows of one fold should lie together."""

    KEPT = "bins", "target", "fold", "key", "places"

    def __init__(self, bins: np.ndarray, target: np.ndarray, fold: np.ndarray, key: np.ndarray, models: int):
        self.bins = np.ascontiguousarray(bins.T)
        self.target, self.fold, self.key = target, fold, sampling_key(key)
        self.predicted = [np.zeros(len(target)) for _ in range(models)]
        self.places: np.ndarray | None = None
        self.last: tuple[int, np.ndarray] | None = None

    def save(self, folder: str, plan: Plan) -> None:
        self.place(plan)
        for name in self.KEPT:
            np.save(f"{folder}/{name}.npy", getattr(self, name))

    @staticmethod
    def open(folder: str, predicted: list[np.ndarray]) -> Block:
        """A saved block; what a pass reads of it comes from the files when it is read."""
        block = Block.__new__(Block)
        for name in Block.KEPT:
            path = f"{folder}/{name}.npy"
            setattr(block, name, np.load(path, mmap_mode="r"))
        block.predicted, block.last = predicted, None
        return block

    def mine(self, held_out: int) -> np.ndarray:
        """The rows that a model learns from."""
        return self.fold != held_out if held_out else np.ones(len(self.fold), bool)

    def base(self, held_out: int) -> np.ndarray:
        mine = self.mine(held_out)
        return np.array([np.floor(self.target[mine] * UNITS + 0.5).sum(), np.count_nonzero(mine)])

    def start(self, bases: Sequence[float]) -> None:
        for predicted, base in zip(self.predicted, bases):
            predicted[:] = base

    def chunks(self) -> Iterator[slice]:
        return (slice(i, min(i + CHUNK, len(self.target))) for i in range(0, len(self.target), CHUNK))

    def place(self, plan: Plan) -> None:
        """By group of features the rows' places in its table."""
        self.places = np.zeros((len(plan.groups), len(self.target)), np.uint16)
        for part in self.chunks():
            for place, group in zip(self.places, plan.groups):
                for f in group:
                    place[part] *= plan.sizes[f]
                    place[part] += np.minimum(self.bins[f, part], plan.sizes[f] - 1)

    def nodes(self, part: slice, tree: Tree, level: int, missing: list[int]) -> np.ndarray:
        """The nodes of some rows on a level of a tree; from a leaf they go on to the left."""
        n = part.stop - part.start
        at = np.ones(n, np.min_scalar_type(len(tree.value) - 1))
        right, above, here = (np.empty(n, bool) for _ in range(3))
        for up in range(level):
            right[:] = False
            for node in (np.flatnonzero(tree.feature[1 << up:2 << up] >= 0) + (1 << up)).tolist():
                feature, cut = int(tree.feature[node]), int(tree.bin[node])
                bins = self.bins[feature, part]
                np.greater(bins, np.uint8(cut), out=above)
                if missing[feature] <= cut:
                    above &= np.not_equal(bins, np.uint8(MISSING), out=here)
                if up:
                    above &= np.equal(at, at.dtype.type(node), out=here)
                right |= above
            at += at
            at |= right.view(np.uint8)
        return at

    def sums(self, model: int, tree: Tree, number: int, nodes: list[int], columns: list[int], plan: Plan) -> np.ndarray:
        """(2, nodes, columns, bins) for some nodes of a level: sums of residuals and numbers of rows.

        Features that share a table are counted at once, and each entry is residuals and rows in one number. It is read out
        before it could overflow."""
        out = np.zeros((2, len(nodes), len(columns), plan.width), np.int64)
        if not nodes:
            return out
        if self.places is None:
            self.place(plan)
        if self.last is None or self.last[0] != number:
            self.last = number, sampled_by(self.key, number, plan.settings)
        level, missing, held_out = nodes[0].bit_length() - 1, plan.missing[model], plan.held_out[model]
        shared = [(place, group, tuple(plan.sizes[f] for f in group)) for place, group in zip(self.places, plan.groups) if {*group} & {*columns}]
        turn_of = np.full(len(tree.value), -1)
        turn_of[nodes] = np.arange(len(nodes))
        tables, held = [np.zeros(len(nodes) * math.prod(shape), np.int64) for *_, shape in shared], 0

        def read() -> None:
            for (_, group, shape), table in zip(shared, tables):
                by_node = table.reshape(len(nodes), *shape)
                for axis, f in enumerate(group):
                    if f in columns:
                        by = by_node.sum(tuple(i + 1 for i in range(len(group)) if i != axis))
                        rows, j = (by + ONE // 2) // ONE, columns.index(f)
                        for kind, sums in enumerate((by - rows * ONE, rows)):
                            out[kind, :, j, :plan.sizes[f] - 1] += sums[:, :-1]
                            out[kind, :, j, missing[f]] += sums[:, -1]
                table[:] = 0

        # Memory that is used again needs no clearing; all indices are within bounds ("clip" spares a copy).
        spare = [np.empty(min(CHUNK, len(self.target)), kind) for kind in (float, float, np.int64, np.intp, np.intp, np.uint16)]
        for part in self.chunks():
            used = self.last[1][part]
            if held_out:
                mine = self.fold[part] != held_out
                if not mine.any():
                    continue
                used = used & mine
            turns = turn_of.take(self.nodes(part, tree, level, missing).astype(np.intp)) if level else None
            rows = np.flatnonzero(used if turns is None else used & (turns >= 0))
            if not len(rows):
                continue
            residual, before, added, turn, index, short = (own[:len(rows)] for own in spare)
            np.take(self.target[part], rows, out=residual, mode="clip")
            residual -= np.take(self.predicted[model][part], rows, out=before, mode="clip")
            residual *= UNITS
            residual += 0.5
            np.floor(residual, out=residual)
            if len(nodes) > 1:
                np.take(turns, rows, out=turn, mode="clip")
            added[:] = residual
            # Only residuals of thousands could overflow within a chunk; then it is added a few rows at a time, or unpacked if these are one.
            limit = min(ONE // 2 // max(1, int(added.max()), -int(added.min())), MOST_ROWS)
            if limit <= 1:
                for j, f in enumerate(columns):
                    bins = self.bins[f, part].take(rows).astype(np.intp)
                    bins[bins == MISSING] = missing[f]
                    for kind, weight in enumerate((added, 1)):
                        np.add.at(out[kind, :, j], (turn if len(nodes) > 1 else 0, bins), weight)
                continue
            added += ONE
            for i in range(0, len(rows), limit):
                some = slice(i, min(i + limit, len(rows)))
                if held + some.stop - i > limit:
                    read()
                    held = 0
                held += some.stop - i
                for table, (place, *_) in zip(tables, shared):
                    np.take(place[part], rows[some], out=short[some], mode="clip")
                    if len(nodes) > 1:
                        np.multiply(turn[some], len(table) // len(nodes), out=index[some])
                        index[some] += short[some]
                    else:
                        index[some] = short[some]
                    np.add.at(table, index[some], added[some])
        read()
        return out

    def add(self, model: int, tree: Tree, missing: list[int]) -> None:
        depth, value = len(tree.value).bit_length() - 2, np.zeros(len(tree.value))
        for node in np.flatnonzero(tree.feature < 0).tolist():
            if node == 1 or node and tree.feature[node >> 1] >= 0:
                value[node << (depth + 1 - node.bit_length())] = tree.value[node]  # where rows of a leaf come to, going on to the left
        for part in self.chunks():
            self.predicted[model][part] += value.take(self.nodes(part, tree, depth, missing).astype(np.intp))


def score(total: np.ndarray, rows: np.ndarray, penalty: float) -> np.ndarray:
    return total * total / (rows + penalty)


def grow(tree: Tree, level: int, sums: np.ndarray, columns: list[int], settings: Settings) -> None:
    """Splits the nodes of a level, or gives them their leaf value, from their histograms."""
    total, rows = sums[0, :, 0].sum(1), sums[1, :, 0].sum(1)
    left, left_rows = np.cumsum(sums, axis=3)
    for i in np.flatnonzero(rows):
        node = (1 << level) + i
        tree.cover[node] = rows[i]
        g, n = total[i] / UNITS, rows[i]
        tree.value[node] = settings.rate * (g / (n + settings.penalty))
        if level == settings.depth:
            continue
        gl, nl = left[i] / UNITS, left_rows[i]
        gain = score(gl, nl, settings.penalty) + score(total[i] / UNITS - gl, n - nl, settings.penalty) - score(g, n, settings.penalty)
        gain[(nl < settings.least_rows) | (n - nl < settings.least_rows)] = 0
        best = int(np.argmax(gain))  # the first of equal ones
        if gain.flat[best] > LEAST_GAIN:
            column, tree.bin[node] = divmod(best, gain.shape[1])
            tree.feature[node], tree.value[node] = columns[column], 0.0


def smaller_children(tree: Tree, level: int, sums: np.ndarray, columns: list[int]) -> list[int]:
    """The child with fewer rows of every node that was split on a level."""
    out = []
    for i in np.flatnonzero(tree.feature[1 << level:2 << level] >= 0).tolist():
        node = (1 << level) + i
        rows = sums[1, i, columns.index(tree.feature[node])]
        left = rows[:tree.bin[node] + 1].sum()
        out.append(2 * node + int(2 * left > rows.sum()))
    return out


def sums_below(level: int, sums: np.ndarray, nodes: list[int], found: np.ndarray) -> np.ndarray:
    """The histograms of the next level, from those of one child of every split."""
    out = np.zeros((2, 2 << level, *sums.shape[2:]), np.int64)
    for i, node in enumerate(nodes):
        place = node - (2 << level)
        out[:, place], out[:, place ^ 1] = found[:, i], sums[:, place >> 1] - found[:, i]
    return out


def totals_below(tree: Tree, level: int, sums: np.ndarray, columns: list[int]) -> np.ndarray:
    """The same with a node's totals alone (one column of one bin), from the histograms of the splits."""
    out = np.zeros((2, 2 << level, 1, 1), np.int64)
    for i in np.flatnonzero(tree.feature[1 << level:2 << level] >= 0).tolist():
        split = sums[:, i, columns.index(tree.feature[(1 << level) + i])]
        left = split[:, :tree.bin[(1 << level) + i] + 1].sum(1)
        out[:, 2 * i, 0, 0], out[:, 2 * i + 1, 0, 0] = left, split.sum(1) - left
    return out


def grown_trees(number: int, n_models: int, plan: Plan, measured: Callable[[list[Tree], list[list[int]], list[int]], list[np.ndarray]]) -> list[Tree]:
    """The tree of this number of every model; ``measured`` gives the histograms of some nodes of each."""
    settings, columns = plan.settings, tree_columns(number, len(plan.edges), plan.settings)
    trees = [Tree.empty(settings.depth) for _ in range(n_models)]
    sums = measured(trees, [[1]] * n_models, columns)
    for level in range(settings.depth + 1):
        for tree, own in zip(trees, sums):
            grow(tree, level, own, columns, settings)
        if level + 1 == settings.depth:
            sums = [totals_below(t, level, s, columns) for t, s in zip(trees, sums)]
        elif level < settings.depth:
            nodes = [smaller_children(t, level, s, columns) for t, s in zip(trees, sums)]
            if not any(nodes):
                break
            sums = [sums_below(level, s, n, f) for s, n, f in zip(sums, nodes, measured(trees, nodes, columns))]
    return trees


def _fit_block(block: Block, plan: Plan) -> tuple[float, list[Tree]]:
    """The one model of a plan, whose rows are all in one block."""
    total, n = block.base(plan.held_out[0])
    base = total / n / UNITS if n else 0.0
    block.start([base])
    out = []
    for number in range(plan.settings.trees if n else 0):
        [tree] = grown_trees(number, 1, plan, lambda trees, nodes, columns, number=number: [block.sums(0, trees[0], number, nodes[0], columns, plan)])
        block.add(0, tree, plan.missing[0])
        out.append(tree)
    return base, out


def _node_rows(model: int, base: float, trees: list[Tree], plan: Plan) -> pa.Table:
    """Node 0 of tree -1 carries the base value; bins become thresholds."""
    rows = [(model, -1, 0, -1, None, base, 0)]
    for number, tree in enumerate(trees):
        for node in np.flatnonzero(tree.cover).tolist():
            f = int(tree.feature[node])
            rows.append((model, number, node, f, float(plan.edges[f][tree.bin[node]]) if f >= 0 else None, float(tree.value[node]), int(tree.cover[node])))
    types = {"int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], types[c.split()[1]]) for i, c in enumerate(NODES.split(", "))})


PACKED = "bins binary, target binary, fold binary, key binary"


def _pack(plan: Plan, features: Sequence[str]):
    def run(batches):
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            columns = [plan.binned(values), batch.column("__y").to_numpy(zero_copy_only=False).astype("<f8"), batch.column("__fold").to_numpy(zero_copy_only=False).astype("<i4"),
                       batch.column("__key").to_numpy(zero_copy_only=False).astype("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [c.split()[0] for c in PACKED.split(", ")])

    return run


def _unpacked(rows: Iterator, n_features: int) -> tuple[np.ndarray, ...]:
    rows = list(rows)
    joined = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)
    return joined("bins", np.uint8).reshape(-1, n_features), joined("target", "<f8"), joined("fold", "<i4"), joined("key", "<i8")


def _block(rows: Iterator, plan: Plan) -> Block:
    """The rows that any model learns from, those of a fold together."""
    bins, target, fold, key = _unpacked(rows, len(plan.edges))
    order = np.argsort(fold, kind="stable")
    if len(plan.held_out) == 1 and plan.held_out[0]:
        order = order[fold[order] != plan.held_out[0]]
    return Block(bins[order], target[order], fold[order], key[order], len(plan.held_out))


def _fit_in_tasks(packed: DataFrame, plan: Plan) -> DataFrame:
    def one(key: tuple, group: pa.Table) -> pa.Table:
        model = key[0].as_py()
        own = replace(plan, held_out=[plan.held_out[model]], missing=[plan.missing[model]])
        return _node_rows(model, *_fit_block(_block(group.to_pylist(), own), own), own)

    models = F.explode(F.array(*[F.lit(m) for m in range(len(plan.held_out))])).alias("model")
    return packed.select(models, "*").groupBy("model").applyInArrow(one, NODES)


class Kept:
    """The blocks of a fit as files of the executors that made them, which all their workers map into memory.

    A pass over the blocks is one job over their cached numbers, by which Spark finds the executors. A model's predictions after so many trees are a file of
    their own, so a task may be repeated. Where files are missing (an executor was lost, or a task ran on another), all
    blocks are made again from the packed rows and all trees so far."""

    def __init__(self, packed: DataFrame, plan: Plan, parts: int):
        self.packed, self.plan, self.parts, self.grown, self.bases = packed, plan, parts, [], None
        self._make()

    def _make(self) -> None:
        from pyspark import StorageLevel

        name, plan = f"boost-{uuid.uuid4().hex}", self.plan

        def make(number: int, rows: Iterator) -> Iterator[str]:
            folder = f"{SparkFiles.getRootDirectory()}/{name}-{number}"
            os.makedirs(folder, exist_ok=True)
            _block(rows, plan).save(folder, plan)
            yield f"{name}-{number}"

        self.names = self.packed.repartition(self.parts).rdd.mapPartitionsWithIndex(make).persist(StorageLevel.MEMORY_AND_DISK)
        if self.bases is None:
            totals = self._total(lambda block: [block.base(h) for h in plan.held_out], None)
            self.bases = [t / n / UNITS if n else 0.0 for t, n in totals]

    def _total(self, of: Callable[[Block], list[np.ndarray]], trees: int | None, more: list[list[Tree]] | None = None) -> list[np.ndarray]:
        """The blocks' sum of what is ``of`` them after some trees, of which ``more`` are the last ones; files that are missing are made again."""
        plan, bases = self.plan, self.bases

        def run(name: str) -> list[np.ndarray] | None:
            folder = f"{SparkFiles.getRootDirectory()}/{name}"
            try:
                predicted = _predicted(folder, plan, bases, trees, more or []) if trees is not None else []
                return of(Block.open(folder, predicted))
            except FileNotFoundError:
                return None

        def add(a: list[np.ndarray] | None, b: list[np.ndarray] | None) -> list[np.ndarray] | None:
            return None if a is None or b is None else [x + y for x, y in zip(a, b)]

        found = self.names.map(run)
        total = found.reduce(add) if self.parts <= DRIVER_BLOCKS else found.treeReduce(add)
        if total is None:
            if more is self.grown:
                raise RuntimeError("Boosting: files of the executors went missing twice in a row")
            self.drop()
            self._make()
            return self._total(of, trees, self.grown if trees else None)
        return total

    def sums(self, number: int, trees: list[Tree], nodes: list[list[int]], columns: list[int]) -> list[np.ndarray]:
        plan = self.plan
        return self._total(lambda block: [block.sums(m, t, number, n, columns, plan) for m, (t, n) in enumerate(zip(trees, nodes))], len(self.grown), self.grown[-1:])

    def drop(self) -> None:
        def remove(name: str) -> None:
            shutil.rmtree(f"{SparkFiles.getRootDirectory()}/{name}", ignore_errors=True)

        self.names.foreach(remove)
        self.names.unpersist()


def _predicted(folder: str, plan: Plan, bases: list[float], trees: int, more: list[list[Tree]]) -> np.ndarray:
    """The models' predictions after so many trees, from a file or that of a number of trees before, to which the others are added."""
    path = lambda n: f"{folder}/predicted-{n}.npy"
    if not os.path.exists(path(trees)):
        began = trees - len(more)
        if began:
            predicted = np.load(path(began))
        else:
            predicted = np.repeat(np.array(bases)[:, None], np.load(f"{folder}/target.npy", mmap_mode="r").shape[0], 1)
        block = Block.open(folder, [*predicted])
        for own in more:
            for model, tree in enumerate(own):
                block.add(model, tree, plan.missing[model])
        np.save(part := f"{folder}/{uuid.uuid4().hex}.npy", predicted)
        os.replace(part, path(trees))
        with suppress(FileNotFoundError):
            os.remove(path(began - 1))
    return np.load(path(trees), mmap_mode="r")


def _fit_by_levels(packed: DataFrame, plan: Plan, parts: int) -> DataFrame:
    n_models = len(plan.held_out)
    blocks = Kept(packed, plan, parts)
    try:
        for number in range(plan.settings.trees):
            trees = grown_trees(number, n_models, plan, lambda trees, nodes, columns, number=number: blocks.sums(number, trees, nodes, columns))
            blocks.grown.append(trees)
    finally:
        blocks.drop()
    return packed.sparkSession.createDataFrame(pa.concat_tables([_node_rows(m, blocks.bases[m], [own[m] for own in blocks.grown], plan) for m in range(n_models)]), NODES)


def fit_models(train: DataFrame, medians: dict[int, dict[str, float | None]], held_out: Sequence[int] = (0,), settings: Settings = Settings(),
               features: Sequence[str] = K.MODEL_FEATURES, target: str = K.TARGET_NAME, key: str = "source_index", edges=sketched_edges,
               task_rows: int = TASK_ROWS) -> DataFrame:
    """The node table (NODES) of one model per held-out fold (0: none), with ``medians`` by fold for missing values.

    ``train`` has the features, the target, ``fold`` (unless no fold is held out) and, for
    sampling, a whole-number key (rows without one use a hash of their values). No rows give no nodes."""
    if settings.bins > MISSING:
        raise ValueError(f"at most {MISSING} bins")
    cuts = edges(train, features, settings.bins)
    missing = [[int(np.searchsorted(cuts[i], medians.get(m, {}).get(f) or 0.0, "left")) for i, f in enumerate(features)] for m in held_out]
    plan = Plan(cuts, list(held_out), missing, settings)
    row_key = F.col(key).cast("long") if key in train.columns else F.shiftrightunsigned(F.xxhash64(*features, target), 1)
    fold = F.col("fold").cast("int") if "fold" in train.columns else F.lit(0)
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("__y"), fold.alias("__fold"), F.pmod(row_key, F.lit(MODULUS)).alias("__key"))
    packed = materialize(rows.mapInArrow(_pack(plan, features), PACKED), "boost-rows")
    n = (packed.agg(F.sum(F.length("target"))).first()[0] or 0) // 8
    parts = max(-(-n // BLOCK_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    return materialize(_fit_in_tasks(packed, plan) if n <= task_rows * min(2, len(held_out)) else _fit_by_levels(packed, plan, parts), "boost-nodes")


# ---------------------------------------------------------------- prediction
def ensembles(nodes: DataFrame) -> DataFrame:
    """model, base, trees: a row a model, its trees as arrays by heap number (place 0 unused); as large as the model."""
    per_tree = nodes.filter("tree >= 0").groupBy("model", "tree").agg(
        F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "threshold", "value")))).alias("by_node"), F.max("node").alias("last"))
    at = lambda field: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("by_node")[i][field])
    shaped = per_tree.select("model", "tree", at("feature").alias("feature"), at("threshold").alias("threshold"), at("value").alias("value"))
    trees = shaped.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "threshold", "value"))).alias("trees"))
    return nodes.filter("tree < 0").select("model", F.col("value").alias("base")).join(trees, "model", "left")


def predicted(rows: DataFrame, nodes: DataFrame, model, values: Sequence, depth: int = K.GBT_PARAMS["max_depth"], name: str = "prediction") -> DataFrame:
    """Adds the prediction of the model whose number is the column ``model``; ``values`` are the imputed features.

    Each tree is walked down by expressions: from node i to 2i, or 2i + 1 if the value is above the threshold. The
    model table has a row a model and its size is set by the fit's parameters, so it is broadcast."""
    x = F.array(*values)
    steps = F.array(*[F.lit(i) for i in range(depth)])

    def leaf(tree):
        def step(node, _):
            feature = F.get(tree["feature"], node)
            right = F.get(F.col("__x"), feature) > F.get(tree["threshold"], node)
            return F.when(F.coalesce(feature, F.lit(-1)) < 0, node).otherwise(2 * node + right.cast("int"))
        return F.get(tree["value"], F.aggregate(steps, F.lit(1), step))

    joined = rows.withColumn("__x", x).withColumn("__model", model).join(F.broadcast(ensembles(nodes).withColumnRenamed("model", "__model")), "__model", "left")
    # Summed from the base on, tree by tree, as the fit does.
    total = F.aggregate(F.coalesce("trees", F.array().cast(dict(joined.dtypes)["trees"])), F.col("base"), lambda so_far, tree: so_far + leaf(tree))
    return joined.withColumn(name, total).drop("__x", "__model", "base", "trees")
