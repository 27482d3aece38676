"""Mixing sources to target weights by exact block quotas.

Each source is one stream of words: its documents in hashed order. The stream
is cut into blocks of (almost) equal length. The source's target in words
becomes a number of whole passes over its blocks, further whole blocks in
permuted order, and one cut block, so the words taken equal the rounded target.
The drawn blocks are dealt to output shards by a splitting tree: a node with
known block counts per source sends half of its blocks to the left child, and
how many of each source go there is one multivariate hypergeometric draw (each
block in turn goes left with probability places left / blocks left). A shard
then owns a disjoint run of every source's permuted blocks and orders them by
its own hash.

Memory and skew: the block table has at most ``MAX_BLOCKS`` blocks plus one per
source at every input size (blocks grow with the input instead), so broadcasting
it is bounded. Positions in a source's stream come from a two-level running sum
over (source, hash bucket) cells of about ``CELL_ROWS`` rows, so a source that
holds a third of all rows is many cells. One row per source passes through
unpartitioned windows.

Defined results: null texts have size 0 and are never taken; null sources are
one source, last in order; an empty table gives no rows; repeated rows follow
one another in the stream, and rows equal in id and text are interchangeable.
Reruns give the same rows. Other columns ride along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightjar.llm.common import WORD
from nightjar.operators.lineage import materialize

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
MIN_BLOCK_WORDS = 512
MAX_BLOCKS = 1 << 16
CELL_ROWS = 8192
SHARDS = 16
SEED = 20


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, a hash of the text, and the columns asked for."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", *keep, size.alias("size"), F.xxhash64("text").alias("text_hash"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, sid, source_size, weight, target from rows (source, size).

    Weights repeat over the sources in code-point order. Targets share the total
    size by weight; a source above ``max_repeat`` times its size stops there and
    its excess is shared by weight among the others. Taking sources by rising
    limit per unit of weight, the first one whose share stays within its limit
    fixes the share of all that follow.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("sid", sid).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(max_repeat))
    order = W.orderBy(F.col("limit") / F.col("weight"), "sid")
    whole = W.partitionBy()
    left = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("double")
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", left / open_weight).withColumn("rank", F.row_number().over(order))
    first_open = F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct("rank", "level"))).over(whole)["level"]
    target = F.least(F.col("limit").cast("double"), F.coalesce(first_open, F.lit(0.0)) * F.col("weight"))
    return per.select("source", F.col("sid").cast("int"), "source_size", "weight", target.alias("target"))


def blocks(targets: DataFrame, block_words: int, seed: int = SEED) -> DataFrame:
    """Every draw of a block: sid, block, lo, length, epoch, place (in the source's draws), take (words)."""
    lo = F.expr("(block * source_size) div n_blocks")
    cut = (targets.filter("source_size > 0")
           .withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / F.lit(block_words))).cast("long"))
           .withColumn("words", F.round("target").cast("long"))
           .withColumn("block", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
           .withColumn("lo", lo).withColumn("length", F.expr("((block + 1) * source_size) div n_blocks") - F.col("lo"))
           .withColumn("order", F.xxhash64("sid", "block", F.lit(seed))))
    along = W.partitionBy("sid").orderBy("order", "block")
    passes = F.expr("words div source_size")
    rest = (cut.withColumn("passes", passes).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
            .withColumn("before", F.sum("length").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length"))
            .withColumn("nth", F.row_number().over(along) - 1)
            .withColumn("last", F.greatest(F.lit(0), F.least(F.col("length"), F.col("rest") - F.col("before")))))
    epochs = F.expr("filter(sequence(0L, passes), e -> e < passes or last > 0)")
    return (rest.withColumn("epoch", F.explode(epochs))
            .select("sid", "block", "n_blocks", "lo", "length", "epoch", (F.col("epoch") * F.col("n_blocks") + F.col("nth")).alias("place"),
                    F.when(F.col("epoch") < F.col("passes"), F.col("length")).otherwise(F.col("last")).alias("take")))


def split_quotas(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Deal every source's block count to shards: rows (sid, shard, quota, first).

    ``counts`` has one row (sid, n) per source. Level by level each node halves
    its places; within a node the blocks are passed one by one, which draws the
    multivariate hypergeometric exactly.
    """
    levels = max(0, math.ceil(math.log2(max(1, shards))))
    nodes = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("sid", F.col("n").cast("long").alias("n")))).alias("own")).withColumn("node", F.lit(0))
    for level in range(levels):
        salt = F.lit(seed * 1000 + level)

        def left(acc: Column, x: Column) -> Column:
            def step(a: Column, j: Column) -> Column:
                u = F.pmod(F.xxhash64(salt, F.col("node"), x["sid"], j), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))  # noqa: B023
                goes = (u * a["rest"] < a["places"]).cast("long")
                return F.struct((a["places"] - goes).alias("places"), (a["rest"] - 1).alias("rest"), (a["k"] + goes).alias("k"))
            steps = F.when(x["n"] > 0, F.sequence(F.lit(1).cast("long"), x["n"])).otherwise(F.array().cast("array<bigint>"))
            drawn = F.aggregate(steps, F.struct(acc["places"].alias("places"), acc["rest"].alias("rest"), F.lit(0).cast("long").alias("k")), step)
            return F.aggregate(F.array(drawn), acc, lambda b, d: F.struct(
                d["places"].alias("places"), d["rest"].alias("rest"),
                F.concat(b["out"], F.array(F.struct(x["sid"].alias("sid"), d["k"].alias("n")))).alias("out")))
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        start = F.struct(F.floor(F.col("total") / 2).cast("long").alias("places"), F.col("total").alias("rest"),
                         F.array().cast("array<struct<sid:int,n:bigint>>").alias("out"))
        nodes = nodes.withColumn("total", total).withColumn("left", F.aggregate("own", start, left)["out"])
        right = F.zip_with("own", "left", lambda o, x: F.struct(o["sid"].alias("sid"), (o["n"] - x["n"]).alias("n")))
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("own")),
                                  F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("own"))))
        nodes = nodes.select(child.alias("c")).select("c.node", "c.own")
    dealt = nodes.select(F.col("node").alias("shard"), F.inline("own")).withColumnRenamed("n", "quota")
    before = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def draw_plan(targets: DataFrame, total: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The drawn blocks with their shard and place in the shard (bounded by MAX_BLOCKS x MAX_REPEAT)."""
    block_words = max(MIN_BLOCK_WORDS, math.ceil(total / MAX_BLOCKS))
    drawn = materialize(blocks(targets, block_words, seed), "mix-blocks")
    quotas = split_quotas(drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    # A source's draws in order of place are dealt as disjoint runs; places count from 0 without gaps.
    placed = drawn.withColumn("pos", F.row_number().over(W.partitionBy("sid").orderBy("place")) - 1)
    mine = (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("quota"))
    shuffled = F.xxhash64("shard", "sid", "pos", F.lit(seed + 1))
    return placed.join(quotas, "sid").filter(mine).select(
        "sid", "block", "n_blocks", "lo", "length", "epoch", "take", "shard", shuffled.alias("shard_order"))


def positions(rows: DataFrame, targets: DataFrame, n_rows: int, seed: int = SEED) -> DataFrame:
    """Adds sid, source_size, target and ``start``, the words before the document in its source's stream."""
    cells = max(1, math.ceil(n_rows / CELL_ROWS))
    keyed = (rows.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source", "weight")
             .withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed))).withColumn("cell", F.pmod("h", F.lit(cells)).cast("int")))
    per = keyed.groupBy("sid", "cell").agg(F.sum("size").alias("cell_size"))
    before = W.partitionBy("sid").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("cell_size")
    within = W.partitionBy("sid", "cell").orderBy("h", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (keyed.join(per, ["sid", "cell"]).withColumn("start", F.col("cell_start") + F.sum("size").over(within) - F.col("size"))
            .drop("h", "cell", "cell_start"))


def _prepare(docs: DataFrame, weights, max_repeat: int, shards: int, seed: int):
    slim = materialize(sized(docs), "mix-sizes")
    targets = materialize(source_targets(slim, weights, max_repeat), "mix-targets")
    totals = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("rows")).first()
    plan = materialize(draw_plan(targets, totals["words"], shards, seed), "mix-plan")
    return slim, targets, plan, totals["rows"]


def mix_counts(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    slim, targets, plan, n_rows = _prepare(docs, weights, max_repeat, shards, seed)
    whole = F.col("take") == F.col("length")
    used = plan.groupBy("sid", "block", "n_blocks", "lo", "length").agg(
        F.sum(whole.cast("long")).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("take"))), F.lit(0)).alias("part"), F.sum("take").alias("words"))
    # Blocks never drawn count too: words taken before a block, over all blocks of the source.
    grid = targets.filter("source_size > 0").join(plan.select("sid", "n_blocks").distinct(), "sid").select("sid", "n_blocks", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    before = W.partitionBy("sid").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    table = (grid.join(used.drop("n_blocks", "lo", "length"), ["sid", "block"], "left").na.fill(0, ["times", "part", "words"])
             .join(targets.select("sid", "source_size"), "sid").withColumn("lo", F.expr("(block * source_size) div n_blocks")).drop("source_size")
             .withColumn("cum", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words"))
    table = materialize(table, "mix-table")
    sizes = table.groupBy("sid").agg(F.max("n_blocks").alias("n_blocks"))
    placed = positions(slim, targets, n_rows, seed).join(sizes, "sid", "left")
    at = lambda x: F.expr(f"(({x} + 1) * n_blocks - 1) div source_size")
    placed = placed.withColumn("a", F.when(F.col("size") > 0, at("start"))).withColumn("z", F.when(F.col("size") > 0, at("(start + size - 1)")))

    def edge(key: str) -> DataFrame:
        cols = [F.col(c).alias(f"{c}_{key}") for c in ("lo", "times", "part", "cum")]
        return F.broadcast(table.select("sid", F.col("block").alias(key), *cols))  # at most MAX_BLOCKS rows and one per source

    def taken(key: str, x: Column) -> Column:
        into = x - F.col(f"lo_{key}")
        return F.col(f"cum_{key}") + F.col(f"times_{key}") * into + F.least(into, F.col(f"part_{key}"))

    out = placed.join(edge("a"), ["sid", "a"], "left").join(edge("z"), ["sid", "z"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target",
                      F.coalesce(taken("z", F.col("start") + F.col("size")) - taken("a", F.col("start")), F.lit(0)).cast("long").alias("taken"))


def mix_pieces(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The mix itself: shard, shard_order, doc_id, source, kept columns, n_words and the piece's text.

    A piece is the part of one document inside one drawn block; white space
    before a piece is dropped, inside and at the end of a text it stays.
    """
    _, targets, plan, n_rows = _prepare(docs, weights, max_repeat, shards, seed)
    rows = positions(sized(docs, "text", *keep), targets, n_rows, seed).filter("size > 0")
    counts = F.broadcast(plan.groupBy("sid").agg(F.max("n_blocks").alias("n_blocks")))
    at = lambda x: f"(({x} + 1) * n_blocks - 1) div source_size"
    rows = rows.join(counts, "sid").withColumn("tokens", F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"), F.lit(0)))
    parts = F.expr(f"""transform(sequence({at('start')}, {at('(start + size - 1)')}), b -> struct(b as block,
        greatest(start, (b * source_size) div n_blocks) as from,
        slice(tokens, int(greatest(0L, (b * source_size) div n_blocks - start)) + 1,
              int(least(start + size, ((b + 1) * source_size) div n_blocks) - greatest(start, (b * source_size) div n_blocks))) as words))""")
    pieces = rows.select("sid", "doc_id", "source", *keep, F.explode(parts).alias("p")).select("sid", "doc_id", "source", *keep, "p.*")
    draws = F.broadcast(plan.select("sid", "block", "lo", "take", "shard", "shard_order", "epoch"))  # at most MAX_REPEAT + 1 draws of a bounded block table
    n = F.least(F.size("words").cast("long"), F.col("lo") + F.col("take") - F.col("from"))
    return (pieces.join(draws, ["sid", "block"]).withColumn("n_words", n).filter("n_words > 0")
            .withColumn("text", F.regexp_replace(F.array_join(F.slice("words", F.lit(1), F.col("n_words").cast("int")), ""), r"\A[\x20\x09-\x0D]+", ""))
            .select("shard", "shard_order", "doc_id", "source", *keep, "epoch", "n_words", "text"))


def write_shards(pieces: DataFrame, path: str) -> None:
    """One folder per shard, its pieces in the shard's own shuffled order."""
    (pieces.repartition("shard").sortWithinPartitions("shard", "shard_order", "doc_id").write.partitionBy("shard").parquet(path))
