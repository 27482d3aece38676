"""Document fingerprints by spot signatures.

A spot is a very common word (an anchor); its signature is the anchor with the
next ``CHAIN`` content words, anchors between them skipped. A document's
fingerprint is the set of its hashed signatures, written as sorted
numbers. A text without a full signature has one signature made of all its words,
so only equal wordings look alike.

Likeness is the Jaccard similarity of two sets. Sets whose lengths differ too
much can't reach a threshold, so candidate pairs meet only within the same or
neighbouring length partitions (borders grow by 1 / threshold) and only through
the rarest part of each set; see ``similar_pairs``.

Defined results: a null text is empty; texts without words all have the
fingerprint of no words; equal texts have equal fingerprints whatever their
length; repeated rows each get a row; rows with equal ids follow one another in
the order of their text hash, null ids last; a single document is its own next one; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightjar.operators.lineage import materialize

#: Content words in a signature.
CHAIN = 2

#: Very common words of English, German, French and Spanish.
ANCHORS = """a an and are as at be by for from in is it of on or that the this to was with
als am auf aus das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von zu
au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une
al con como del el ella en es la las lo los no para por que se sin su un una y""".split()

#: Rows of one cell of the document order, and how many cells there are at most.
CELL_ROWS = 8192
MAX_CELLS = 1 << 16


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted distinct signature hashes of the column ``text``.

    With the k-th anchor (from 0) at word i, i - k content words come before it,
    so its chain starts at that place in the list of content words.
    """
    words, spots, content = (f"__{part}_{name}" for part in ("words", "spots", "content"))
    anchors = sorted(set(ANCHORS))
    rows = rows.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    places = F.sequence(F.lit(0), F.size(words) - 1)
    rows = (rows.withColumn(spots, F.when(F.size(words) > 0, F.filter(places, lambda i: F.get(F.col(words), i).isin(anchors))).otherwise(F.array().cast("array<int>")))
            .withColumn(content, F.filter(words, lambda w: ~w.isin(anchors))))
    chains = F.transform(F.col(spots), lambda i, k: F.when(i - k + CHAIN <= F.size(content), F.xxhash64(
        F.get(F.col(words), i), *[F.get(F.col(content), i - k + j) for j in range(CHAIN)])))
    rows = rows.withColumn(name, F.array_distinct(F.array_compact(chains)))
    whole = F.array(F.xxhash64(F.lit("whole"), F.col(words)))
    return rows.withColumn(name, F.when(F.size(name) > 0, F.sort_array(name)).otherwise(whole)).drop(words, spots, content)


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(signature_set.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; sets are never empty here."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def length_partition(size: Column, threshold: float) -> Column:
    """Number of the length partition: similar sets lie in the same or the next one."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def _cell(doc_id: Column, borders: list[int]) -> Column:
    """Descending cell number of an id: how many of the sorted borders are above it (binary search); nulls come last."""
    if not borders:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    table = F.lit(np.array(borders, np.int64))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = (a["lo"] < a["hi"]) & (F.get(table, mid) <= doc_id)
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), halve, lambda a: a["lo"])
    return F.when(doc_id.isNull(), len(borders) + 1).otherwise(len(borders) - found)


def _next_in_order(rows: DataFrame) -> DataFrame:
    """Adds ``spots`` and ``next``, text and spots of the next row by descending doc_id; the first row's for the last.

    Rows are dealt to cells by sampled borders of the id (at most ``MAX_CELLS``),
    so the order runs from cell to cell; the first row of the following cell
    closes each cell's end. Texts are shuffled once.
    """
    cells = min(MAX_CELLS, math.ceil(rows.select("doc_id").count() / CELL_ROWS))
    borders: list[int] = []
    if cells > 1:
        shares = [i / cells for i in range(1, cells)]
        borders = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * cells)).alias("m")).first()["m"] or []))
    dealt = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("cell", _cell(F.col("doc_id"), borders))
    heads = materialize(dealt.groupBy("cell").agg(F.min_by("text", F.struct(-F.col("doc_id"), F.col("text_hash"))).alias("text")), "spot-heads")
    numbers = heads.select("cell")  # one number per cell, at most MAX_CELLS + 1
    first = F.min("cell").over(W.partitionBy())
    links = numbers.select("cell", F.coalesce(F.lead("cell").over(W.orderBy("cell")), first).alias("next_cell"))
    heads = with_signatures(heads, "text", "spots").select(F.col("cell").alias("next_cell"), F.struct("text", "spots").alias("head"))
    ends = links.join(heads, "next_cell").drop("next_cell")
    within = W.partitionBy("cell").orderBy(F.col("doc_id").desc_nulls_last(), "text_hash")
    return (with_signatures(dealt, "text", "spots").withColumn("lead", F.lead(F.struct("text", "spots")).over(within)).join(ends, "cell")
            .withColumn("next", F.coalesce("lead", "head")).drop("lead", "head", "cell", "text_hash"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, signature set (spots) and fingerprint of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return with_signatures(slim, "text", "spots").withColumn("fingerprint", fingerprint(F.col("spots")))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    linked = _next_in_order(slim)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    both = linked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "spots", F.col("next.spots").alias("following"))
    sets = with_signatures(both.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "changed")
    return sets.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("spots"), F.col("changed")).alias("near_edited"), likeness(F.col("spots"), F.col("following")).alias("near_next"))


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, jaccard) of distinct signature sets at or over the threshold.

    ``sets``: key (unique), spots (sorted hashes). A set is indexed by the first
    |s| - ceil(threshold * |s|) + 1 of its hashes, in its own length partition
    and, as a probe, in the next longer one; hashes are as good as random, so no
    signature order is rarer than another only in cost, never in the result.
    """
    size = F.size("spots")
    base = sets.filter(size > 0).withColumn("n", size).withColumn("prefix", F.expr(f"slice(spots, 1, n - cast(ceil({threshold!r} * n) as int) + 1)"))
    part = length_partition(F.col("n"), threshold)
    held = base.select(F.col("key").alias("a"), F.col("n").alias("n_a"), part.alias("part"), F.explode("prefix").alias("h"))
    probes = base.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(part, part - 1)).alias("part"), "prefix").select("b", "n_b", "part", F.explode("prefix").alias("h"))
    longer = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))
    pairs = held.join(probes, ["part", "h"]).filter(longer & (F.col("n_a") >= F.col("n_b") * threshold)).select("a", "b").distinct()
    left, right = (materialize(base.select("key", "spots"), "spots").select(F.col("key").alias(k), F.col("spots").alias(f"spots_{k}")) for k in "ab")
    scored = pairs.join(left, "a").join(right, "b").withColumn("jaccard", likeness(F.col("spots_a"), F.col("spots_b")))
    return scored.filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard")
