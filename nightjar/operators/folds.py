"""Participant-disjoint, row-balanced folds.

A participant is in one fold whole. Participants are dealt in order of falling
rows (ties by id), each to the fold with the fewest rows so far (ties to the first
fold). Participants of equal size are one class: dealing them goes round the
lightest folds in a fixed order until a heavier fold joins the round, so a class is
at most k rounds. The driver walks the classes, at most sqrt(2 N) of them for N rows,
and a participant finds its fold from its place within its class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.constants import DEFAULT_SPLITS, PARTICIPANT_COLUMN
from nightjar.operators.lineage import materialize
from nightjar.operators.ranks import range_buckets, rows_before

#: A table of at most this many size classes is broadcast; the size of a larger one decides its join.
BROADCAST_CLASSES = 50_000


class GroupedValidationError(ValueError):
    pass


def deal_class(held: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Rounds (place of the first participant, folds from 1 in turn) of ``count`` participants of ``size`` rows.

    ``held``, the rows of every fold, is brought up to date.
    """
    rounds, place = [], 0
    while place < count:
        order = sorted(range(len(held)), key=lambda f: (held[f], f))
        first = order[0]
        turn = [f for f in order if (held[f], f) < (held[first] + size, first)]
        left = count - place
        if len(turn) < len(held):
            # The round is left when its last fold would come after the next heavier one.
            last, joins = turn[-1], order[len(turn)]
            times = (held[joins] - held[last] - (last > joins)) // size + 1
            left = min(left, times * len(turn))
        whole, part = divmod(left, len(turn))
        rounds.append((place, [f + 1 for f in turn[:left]]))
        for i, f in enumerate(turn):
            held[f] += size * (whole + (i < part))
        place += left
    return rounds


def participant_folds(train: DataFrame, n_splits: int = DEFAULT_SPLITS,
                      participant: str = PARTICIPANT_COLUMN, num_buckets: int | None = None) -> DataFrame:
    """``participant_id, n_rows, fold`` (1-based), one row per participant."""
    spark = train.sparkSession
    counts = materialize(train.groupBy(participant).agg(F.count(F.lit(1)).alias("n_rows")), "participants")
    # Sizes that differ sum to at most all rows: the table has at most sqrt(2 N) rows.
    sizes = counts.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n_rows").desc()).collect()
    held, before, classes = [0] * n_splits, 0, []
    for size, n in sizes:
        classes.append((size, before, deal_class(held, size, n)))
        before += n
    dealt = spark.createDataFrame(classes, "n_rows bigint, _first bigint, _rounds array<struct<place:bigint,folds:array<int>>>")
    if len(classes) <= BROADCAST_CLASSES:
        dealt = F.broadcast(dealt)
    order = [F.col("n_rows").desc(), F.col(participant).asc()]
    placed = rows_before(range_buckets(counts.withColumn("_one", F.lit(1)), order, num_buckets), order, ["_one"]).join(dealt, "n_rows")
    place = F.col("_before__one") - F.col("_first")
    turn = placed.withColumn("_place", place).withColumn("_turn", F.expr("element_at(filter(_rounds, r -> r.place <= _place), -1)"))
    fold = F.expr("_turn.folds[cast((_place - _turn.place) % size(_turn.folds) as int)]")
    return turn.select(participant, "n_rows", fold.alias("fold"))


def check_participants(folds: DataFrame, n_splits: int) -> int:
    """Refuse fewer participants than folds (one scalar aggregate)."""
    n = folds.count()
    if n < n_splits:
        raise GroupedValidationError(
            f"Grouped validation requires at least {n_splits} participants; found {n}.")
    return n


def attach_folds(train: DataFrame, folds: DataFrame, participant: str = PARTICIPANT_COLUMN) -> DataFrame:
    """Rows with their fold; the side's size decides the join, and a participant of many rows is split by AQE."""
    return train.join(folds.select(participant, "fold"), on=participant, how="inner")


def fold_overlap(with_folds: DataFrame, participant: str = PARTICIPANT_COLUMN) -> DataFrame:
    """E5: per fold, participants of its test part also present in its training part."""
    # Distinct (participant, fold) pairs: at most k per participant, so the
    # window below is bounded even for a participant holding many rows.
    pairs = with_folds.select(participant, "fold").distinct()
    n_folds = F.count(F.lit(1)).over(Window.partitionBy(participant))
    return pairs.withColumn("n_folds", n_folds).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_participants"),
        F.count_if(F.col("n_folds") > 1).alias("participant_overlap_count"))


def refuse_overlap(overlap: DataFrame) -> DataFrame:
    """E5: no participant may be in the training and the test part of a fold (k rows are looked at)."""
    shared = {r["fold"]: r["participant_overlap_count"] for r in overlap.collect() if r["participant_overlap_count"]}
    if shared:
        raise GroupedValidationError(f"Participants are in both parts of folds (fold: how many): {shared}")
    return overlap
