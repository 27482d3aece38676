"""Line dedup: an exact set-similarity join over lines that removes later matches.

A line is the set of its lower-case words. A line goes if an earlier line (by
doc_id, then line number, over all documents) has a Jaccard similarity of at
least ``THRESHOLD`` with it; equal lines are the simplest case. Lines without
words are never removed.

1. Words are ordered from rare to common by the frequency of their hash bucket,
   counted over all lines (``BUCKETS`` counters, whatever the vocabulary).
2. Lines with equal sets meet by a 128-bit hash of the set; the first stays in. A table
   holds each distinct set's first line, size, parity bitmaps, prefix (its
   n - ceil(t n) + 1 rarest words) and a few extreme word hashes.
3. A line is first tried against the earliest line that shares an extreme (least or
   greatest) hash with it. That settles nearly all lines of a group of near copies, so that the
   pairs of such a group are not enumerated.
4. The lines that are still open meet all earlier lines by their prefix words: two similar sets
   share a prefix word, and at the first one they share the length filter, the positional filter and
   a bitmap filter (the bits of the words that only one of two sets holds can't outnumber these
   words) let the pair pass, so none is lost. The filters are the join's condition; only pairs that pass are rows.
   The words take ``TURNS`` turns, so that a share of the index is on disk at a time, once for both sides of the join.
5. Candidate pairs are verified on their whole word sets, read again from the
   texts of the documents concerned; a bitmap of their ids keeps nearly all other
   texts from being shuffled. If they are many they take up to ``TURNS`` turns.

Intermediate tables are deleted as soon as the next step is written.

Word identity is the 64-bit hash of the word. Defined results: null texts have
no lines to remove and stay null; rows with equal doc_id and text are one
document (all keep the same lines), rows with equal doc_id and another text
follow in the order of a text hash; null ids come first; an empty table gives no
rows; a line of any length is one row until its prefix is indexed; other columns ride along, but for names that begin with ``__line_``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.operators.lineage import Tables

THRESHOLD = 0.8
#: Word-frequency counters; a power of two.
BUCKETS = 1 << 16
LOW_BITS = 64 - 16
#: Turns in which the index of prefix words is built and joined, a share of the words in each, and, at most, in which texts are read again,
#: a share of the documents in each; a power of two.
TURNS = 4
#: Bits of the bitmap of documents for each of them, and at most (2 ** this, 2 MB).
HELD_BITS, MOST_BITS = 16, 24
#: What the word hashes are combined with, for orders whose least and greatest hashes are tried first.
TRIED_ORDERS = (0, 0x1E3779B97F4A7C15)
#: White space of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, tp (32 bits of text hash, 32 bits of line number: orders and tells lines apart), line."""
    head = F.shiftleft(F.hash("text").cast("long"), 32)  # once for a text, not for each of its lines
    return (docs.select("doc_id", head.alias("head"), F.split("text", "\n").alias("lines")).select("doc_id", "head", F.posexplode("lines").alias("pos", "line"))
            .select("doc_id", (F.col("head") + F.col("pos").cast("long")).alias("tp"), "line"))


def _words(line: Column) -> Column:
    """A line's lower-case words, with empty ones between neighbouring blanks."""
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.split(F.lower(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)), " ")


def _hashes(line: Column) -> Column:
    """Distinct 64-bit hashes of a line's lower-case words."""
    words = F.transform(_words(line), lambda w: F.xxhash64(w))
    return F.array_distinct(F.array_remove(words, F.xxhash64(F.lit(""))))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, LOW_BITS)


def word_ranks(docs: DataFrame) -> np.ndarray:
    """For each bucket its place from rare to common, shifted to be centred on 0. BUCKETS numbers reach the driver."""
    words = docs.select(F.explode(_words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''")
    counted = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    ranks = np.zeros(BUCKETS, np.int32)
    ranks[np.lexsort((np.arange(BUCKETS), frequency))] = np.arange(BUCKETS) - BUCKETS // 2
    return ranks


def ordered_words(hashes: Column, ranks: np.ndarray) -> Column:
    """Sorted keys of a line's word hashes: the bucket's place, then the other bits of the hash. A key stands for one hash."""
    table = F.split(F.lit(",".join(map(str, ranks.tolist()))), ",").cast("array<int>")  # folded to one array when planned
    low = (1 << LOW_BITS) - 1
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.get(table, _bucket(h).cast("int")).cast("long"), LOW_BITS).bitwiseOR(h.bitwiseAND(low))))


def _may_match(x: dict[str, Column], y: dict[str, Column], t: float) -> Column:
    """Length, positional and bitmap filters at a shared prefix word."""
    total = x["n"] + y["n"]
    need = F.ceil(total * F.lit(t / (1 + t)) - 1e-9)
    most = F.lit(1) + F.least(x["n"] - x["i"], y["n"] - y["i"]) - 1
    apart = F.bit_count(x["bits"].bitwiseXOR(y["bits"])) + F.bit_count(x["more"].bitwiseXOR(y["more"]))
    return (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * t - 1e-9) & (most >= need) & (apart <= total - 2 * need)


def _sets(docs: DataFrame, ranks: np.ndarray, t: float) -> DataFrame:
    """One row per distinct set: a and b (its hash), place (first line), n, bits, prefix, extremes. Sets too small for unequal matches have one key, their hash."""
    # A filter on the words would be pushed below their projection and make them twice.
    worded = _lines(docs).filter(F.length(F.btrim("line", F.lit(BLANKS))) > 0)
    hashed = worded.select("doc_id", "tp", _hashes(F.col("line")).alias("hashes"))
    other = [F.transform("hashes", lambda h, k=k: h.bitwiseXOR(F.lit(k))) if k else F.col("hashes") for k in TRIED_ORDERS]
    words = hashed.select("doc_id", "tp", ordered_words(F.col("hashes"), ranks).alias("words"), *[o.alias(f"order{i}") for i, o in enumerate(other)])
    n = F.size("words")
    alone = math.ceil(t / (1 - t) - 1e-9) - 1  # up to so many words only equal sets reach t
    prefix = F.when(n <= alone, F.array().cast("array<bigint>")).otherwise(F.slice("words", F.lit(1), n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1))
    # Parities of 128 word classes: 64 would leave long lines alike by chance.
    bits = F.expr("aggregate(words, 0L, (a, w) -> a ^ shiftleft(1L - (shiftright(w, 6) & 1L), cast(w & 63L as int)))")
    more = F.expr("aggregate(words, 0L, (a, w) -> a ^ shiftleft(shiftright(w, 6) & 1L, cast(w & 63L as int)))")
    extreme = [f(f"order{i}") for i in range(len(TRIED_ORDERS)) for f in (F.array_min, F.array_max)]
    extremes = F.when(n > alone, F.array(*[F.xxhash64(F.lit(i), x) for i, x in enumerate(extreme)])).otherwise(F.array().cast("array<bigint>"))
    line = F.struct(F.struct("doc_id", "tp").alias("place"), n.alias("n"), bits.alias("bits"), more.alias("more"), prefix.alias("prefix"), extremes.alias("extremes"))
    sets = words.select(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), F.col("words")).alias("b"), line.alias("line"))
    return sets.groupBy("a", "b").agg(F.min("line").alias("line")).select("a", "b", "line.*")


def _tries(sets: DataFrame, t: float) -> DataFrame:
    """Pairs (x, y): each line with the earliest line that shares one of its extremes."""
    keyed = sets.select("place", "n", "bits", "more", F.explode("extremes").alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("place", "n", "bits", "more")).alias("y"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    x = {"n": F.col("n"), "bits": F.col("bits"), "more": F.col("more"), "i": F.lit(0)}
    y = {"n": F.col("y.n"), "bits": F.col("y.bits"), "more": F.col("y.more"), "i": F.lit(0)}
    met = keyed.join(first, "key").filter((F.col("y.place") < F.col("place")) & _may_match(x, y, t))
    return met.select(F.col("place").alias("x"), F.col("y.place").alias("y")).distinct()


def _marked(sets: DataFrame, gone: DataFrame) -> DataFrame:
    """The sets, with open: 0 for lines that are settled, else 1. The sets lie dealt out by their hash, so the settled ones come to them by it."""
    settled = sets.select("a", "b", "place").join(gone.select(F.col("x").alias("place")), "place").select("a", "b", F.lit(0).alias("settled"))
    return sets.join(settled, ["a", "b"], "left").withColumn("open", F.coalesce("settled", F.lit(1))).drop("settled", "a", "b", "extremes")


def _candidates(marked: DataFrame, turn: int, t: float) -> DataFrame:
    """Pairs (x, y): each open line with the earlier lines that share a prefix word of the turn and pass all filters."""
    rows = marked.select(F.col("place.doc_id").alias("doc"), F.col("place.tp").alias("tp"), "n", "open", "bits", "more", F.posexplode("prefix").alias("i", "token"))
    # Size, place in the prefix and openness are one number: as both sides read it, they have the same columns and share one exchange.
    facts = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    index = rows.filter(F.pmod("token", F.lit(TURNS)) == turn).select("token", "doc", "tp", facts.alias("facts"), "bits", "more")

    def side(k: str) -> dict[str, Column]:
        held = F.col(f"{k}.facts")
        return {"n": F.shiftright(held, 32), "i": F.shiftright(held.bitwiseAND((1 << 32) - 1), 1), "bits": F.col(f"{k}.bits"), "more": F.col(f"{k}.more")}

    x, y = (F.struct(F.col(f"{k}.doc").alias("doc_id"), F.col(f"{k}.tp").alias("tp")) for k in "xy")
    is_open = F.col("x.facts").bitwiseAND(1) * F.col("y.facts") > 0  # not pushed to one side, as it names both
    pairs = index.alias("x").join(index.alias("y"), (F.col("x.token") == F.col("y.token")) & is_open & _may_match(side("x"), side("y"), t) & (y < x))
    return pairs.select(x.alias("x"), y.alias("y")).distinct()


def _held(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The documents whose id may be among the n wanted ones: none of these is left out, and few others are kept while the bitmap has room."""
    bits = 1 << min(MOST_BITS, max(6, (HELD_BITS * n).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    word = F.shiftright(at, 6).cast("int")
    found = wanted.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    table = docs.sparkSession.createDataFrame(pa.table({"bitmap": pa.array([bitmap], pa.list_(pa.int64()))}))
    return docs.filter(F.get(table.scalar(), word).bitwiseAND(mask) != 0)


def _verified(tables: Tables, pairs: DataFrame, docs: DataFrame, n_docs: int, t: float) -> DataFrame:
    """The places x of pairs (x, y) whose whole sets reach the threshold, as a table. Sets are compared as they are: the table of ranks, which is
    written out in each plan that holds it and in each of its updates on the driver, stays out of these plans."""
    places = pairs.select(F.explode(F.array("x", "y")).alias("place")).distinct()
    wanted = tables.write(places.groupBy("place.doc_id", F.expr("cast(shiftright(place.tp, 32) as int)").alias("th")).agg(F.collect_set("place.tp").alias("tps")), "lines-wanted")
    n = wanted.count()
    turns = min(TURNS, max(1, math.ceil(TURNS * n / max(1, n_docs))))
    texts = _held(docs.select("doc_id", "text"), wanted, n).select("doc_id", "text", F.hash("text").alias("th"))
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))
    parts = []
    for turn in range(turns):  # a share of the documents' texts is on disk at a time
        now = F.pmod(F.xxhash64("doc_id", "th"), F.lit(turns)) == turn if turns > 1 else F.lit(True)
        found = texts.filter(now).alias("d").join(wanted.filter(now).alias("w"), same).select("d.doc_id", "d.text", "w.tps")
        part = (_lines_of(found).filter(F.array_contains("tps", F.col("tp")))
                .select(F.struct("doc_id", "tp").alias("place"), _hashes(F.col("line")).alias("words")))
        parts.append(tables.write(part, "lines-words"))
        tables.drop()
    tables.drop(wanted)
    lines = functools.reduce(DataFrame.union, parts)
    left, right = (lines.groupBy("place").agg(F.first("words").alias("words")).select(F.col("place").alias(k), F.col("words").alias(f"w{k}")) for k in "xy")
    common = F.size(F.array_intersect("wx", "wy"))
    near = common >= (F.size("wx") + F.size("wy") - common) * F.lit(t) - 1e-9
    found = tables.write(pairs.join(left, "x").join(right, "y").filter(near).select("x").distinct(), "lines-gone")
    tables.drop(*parts)
    return found


def _lines_of(found: DataFrame) -> DataFrame:
    head = F.shiftleft(F.hash("text").cast("long"), 32)
    return (found.select("doc_id", "tps", head.alias("head"), F.split("text", "\n").alias("lines")).select("doc_id", "tps", "head", F.posexplode("lines").alias("pos", "line"))
            .select("doc_id", (F.col("head") + F.col("pos").cast("long")).alias("tp"), "tps", "line"))


def kept_lines(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """doc_id, th, kept: the numbers of the lines with words that stay, per document that keeps any."""
    slim, tables = docs.select("doc_id", "text"), Tables(docs.sparkSession)
    ranks, n_docs = word_ranks(slim), slim.count()
    sets = tables.write_bucketed(_sets(slim, ranks, t), "lines-sets", "a", "b")
    tables.drop()
    tries = tables.write(_tries(sets, t), "lines-tries")
    tables.drop()
    settled = _verified(tables, tries, slim, n_docs, t)
    tables.drop(tries)
    marked = tables.write(_marked(sets, settled), "lines-marked")
    tables.drop(sets)
    found = []
    for turn in range(TURNS):
        found.append(tables.write(_candidates(marked, turn, t), "lines-pairs"))
        tables.drop()
    pairs = tables.write(functools.reduce(DataFrame.union, found).distinct(), "lines-pairs")
    tables.drop(*found)
    later = _verified(tables, pairs, slim, n_docs, t)
    tables.drop(pairs)
    gone = settled.union(later)
    stay = marked.select("place").join(gone.select(F.col("x").alias("place")), "place", "left_anti")
    number = F.expr("cast(place.tp - shiftleft(shiftright(place.tp, 32), 32) as int)")
    kept = stay.groupBy("place.doc_id", F.expr("cast(shiftright(place.tp, 32) as int)").alias("th")).agg(F.collect_set(number).alias("kept"))
    kept = Tables(docs.sparkSession).write(kept, "lines-kept")  # read by the caller's plan
    tables.drop_all()
    return kept


def removed_lines(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the numbers (from 0) of the removed lines."""
    lines = F.split("text", "\n")
    worded = F.filter(F.transform(lines, lambda x, i: F.when(F.length(F.btrim(x, F.lit(BLANKS))) > 0, i)), lambda i: i.isNotNull())
    slim = docs.select("doc_id", "text")
    kept = kept_lines(slim, t).withColumnsRenamed({"doc_id": "__line_doc", "th": "__line_th", "kept": "__line_kept"})
    facts = slim.select("doc_id", F.hash("text").alias("th"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(worded, F.array().cast("array<int>")).alias("worded"))
    out = facts.join(kept, F.col("doc_id").eqNullSafe(F.col("__line_doc")) & (F.col("th") == F.col("__line_th")), "left")
    removed = F.sort_array(F.array_except("worded", F.coalesce("__line_kept", F.array().cast("array<int>"))))
    return out.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """The documents with later matching lines taken out of their texts; all other columns as they are."""
    columns = docs.columns
    kept = kept_lines(docs, t).withColumnsRenamed({"doc_id": "__line_doc", "th": "__line_th", "kept": "__line_kept"})
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__line_doc")) & (F.hash("text") == F.col("__line_th")), "left")
    stays = lambda x, i: (F.length(F.btrim(x, F.lit(BLANKS))) == 0) | F.array_contains("__line_kept", i)
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(stays(x, i), F.lit(False))), "\n")
    return joined.withColumn("text", text).select(*columns)
