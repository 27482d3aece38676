"""Ranked lexical search: MaxScore with bounds of term pairs.

The score of a document for an item sums integer impacts of the terms they share:
``w * ((10^9 tf) div (1000 tf + 8 m))`` with the weight w and the length factor m of
``weight`` and ``length_factor``. The k best documents of every item are found exactly.

1. One pass over the texts makes shards: the postings (document, frequency) of the
   items' terms in a block of documents, and how many terms each document has. Counts
   of documents and terms over all shards give weights and impacts.
2. Each item orders its terms by weight, and neighbours in that order are its pairs. The
   index stores, per shard, a term's largest impact and for each pair the joint maximum:
   the largest sum of both impacts over the documents in both lists, with the head of
   the intersection list, its documents of the highest joint impact.
3. Scoring the heads' documents gives each item k real scores and so a threshold.
4. A shard is searched for an item from bounds of the prefixes of its terms:
   B(i) = min(B(i-1) + max(i), B(i-2) + pair(i-1, i)), with pair(a, b) the largest of the
   joint maximum and the two terms' own maxima. That combines the pair bounds in the best
   way and never exceeds the sum of independent maxima. A shard whose B is below the threshold is
   skipped; else the lists of the prefix whose B is below it are optional: documents in
   none of the other lists are skipped, and a document leaves when its partial score
   with the bound of the terms to come falls below the threshold, which rises with every
   shard that a task has searched.

Scale: texts are read once and not shuffled; a shard is bounded by ``BLOCK_CHARS`` and
``BLOCK_DOCS`` (a longer text is a shard by itself). Distinct item texts are searched in
blocks of about ``QUESTION_CHARS`` characters, the only items a driver or task holds. A task sends on at most
k documents an item. However frequent a term, its list is cut by shards. Terms are compared by 64-bit hashes.

Defined results: null texts have no terms and count in no statistic; a null doc_id is
returned and follows all others on ties; rows with one doc_id are documents of their own; every row
of items has its own result, equal ones too; an item without a match has no row; empty tables give
no rows; texts of any length are read whole (products of lengths and counts must fit 64
bits); other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightjar.llm.minhash import mix
from nightjar.llm.pieces import blocks, run_hashes
from nightjar.operators.lineage import materialize

K = 10
BLOCK_CHARS, BLOCK_DOCS = 8_000_000, 8192
#: Characters of item texts that are searched at a time.
QUESTION_CHARS = 4_000_000

#: A term's bytes: digits, letters and all of non-ASCII characters; A-Z become a-z, any other byte 0.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

SHARD = "ids binary, absent binary, lengths binary, terms binary, counts binary, docs binary, tf binary"
INDEX = "ids binary, absent binary, terms binary, counts binary, docs binary, impacts binary, most binary, pairs binary, joint binary, heads binary, head_sizes binary"
FOUND = "ask int, doc_id bigint, score bigint"


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of the texts, in order, and the text that it stands in."""
    data = FOLDED[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = data != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    heads = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return (mix(run_hashes(data, starts, ends, 0)) if len(starts) else np.zeros(0, np.uint64)), np.searchsorted(heads, starts, "right") - 1


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 90 + (90 * length * n_docs) // max(1, n_terms)


def _shards(vocabulary: np.ndarray):
    def run(batches):
        for batch in blocks(batches, BLOCK_CHARS, BLOCK_DOCS):
            ids = batch.column("doc_id")
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            h, doc = term_hashes(texts)
            lengths = np.bincount(doc, minlength=len(texts))
            term = np.searchsorted(vocabulary, h)
            known = np.flatnonzero(vocabulary[np.minimum(term, len(vocabulary) - 1)] == h)
            key, tf = np.unique(term[known] * len(texts) + doc[known], return_counts=True)
            terms, counts = np.unique(key // len(texts), return_counts=True)
            columns = [pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8"), pc.is_null(ids).to_numpy(zero_copy_only=False), lengths.astype("<i8"),
                       terms.astype("<i4"), counts.astype("<i4"), (key % len(texts)).astype("<i4"), tf.astype("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [c.split()[0] for c in SHARD.split(", ")])

    return run


@dataclass
class Shard:
    """Postings of a block of documents, by term."""

    n_docs: int
    place: dict[int, int]
    ends: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    scratch: np.ndarray

    @staticmethod
    def of(n_docs: int, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> Shard:
        return Shard(n_docs, {t: i for i, t in enumerate(terms.tolist())}, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), docs, impacts, np.zeros(n_docs, np.int64))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.place.get(term)
        if at is None:
            return self.docs[:0], self.impacts[:0]
        own = slice(self.ends[at], self.ends[at + 1])
        return self.docs[own], self.impacts[own]

    def joint(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in the lists of both terms and the sums of their impacts."""
        docs, impacts = self.postings(a)
        others, more = self.postings(b)
        self.scratch[docs] = impacts + 1
        both = self.scratch[others]
        self.scratch[docs] = 0
        met = both > 0
        return others[met], both[met] - 1 + more[met]

    def add(self, term: int, docs: np.ndarray, scores: np.ndarray) -> None:
        """Adds the term's impacts to the scores of some documents (numbers in ascending order)."""
        own, impacts = self.postings(term)
        if len(own):
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            scores += np.where(own[at] == docs, impacts[at], 0)


def _counts(batches):
    """term, number of documents; -1: documents with a term; -2: all terms."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], "<i8")
            terms = np.concatenate([np.frombuffer(row["terms"], "<i4"), [-1, -2]])
            counts = np.concatenate([np.frombuffer(row["counts"], "<i4"), [(lengths > 0).sum(), lengths.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["term", "n"])


@dataclass
class Questions:
    """The distinct texts of a block of items: their terms from least to greatest weight, and all pairs of neighbours."""

    terms: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int

    def __post_init__(self):
        self.terms = [t[np.lexsort((t, self.weights[t]))] for t in self.terms]
        pairs = np.unique(np.concatenate([np.column_stack([t[:-1], t[1:]]) for t in self.terms] or [np.zeros((0, 2), np.int64)]), axis=0)
        self.pairs = [tuple(p) for p in pairs.tolist()]
        self.number = {p: i for i, p in enumerate(self.pairs)}

    def chain(self, ask: int) -> list[int]:
        t = self.terms[ask].tolist()
        return [self.number[p] for p in zip(t, t[1:])]


def _index(asks: Questions, k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i8")
                terms, counts, docs = (np.frombuffer(row[c], "<i4") for c in ("terms", "counts", "docs"))
                tf = np.frombuffer(row["tf"], "<i8")
                m = length_factor(lengths, asks.n_docs, asks.n_terms)
                impacts = np.repeat(asks.weights[terms], counts) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
                shard = Shard.of(len(lengths), terms, counts, docs, impacts)
                most = np.maximum.reduceat(impacts, shard.ends[:-1]) if len(terms) else impacts
                pairs, joint, heads, sizes = [], [], [], []
                for number, (a, b) in enumerate(asks.pairs):
                    if a in shard.place and b in shard.place:
                        both, sums = shard.joint(a, b)
                        if len(both):
                            head = both[np.argpartition(-sums, k - 1)[:k]] if len(both) > k else both
                            pairs.append(number)
                            joint.append(int(sums.max()))
                            heads.append(head)
                            sizes.append(len(head))
                columns = [row["ids"], row["absent"], row["terms"], row["counts"], row["docs"], impacts.astype("<i8").tobytes(), most.astype("<i8").tobytes(), np.array(pairs, "<i4").tobytes(),
                           np.array(joint, "<i8").tobytes(), np.concatenate(heads or [docs[:0]]).astype("<i4").tobytes(), np.array(sizes, "<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], [c.split()[0] for c in INDEX.split(", ")])

    return run


class Best:
    """The k best documents of an item so far: highest score, then null ids last, then smallest id."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, threshold
        self.rows = np.zeros((0, 3), np.int64)  # -score, absent, id

    def add(self, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.column_stack([-scores, absent, ids])])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))][:self.k]
        if len(self.rows) == self.k:
            self.threshold = max(self.threshold, -int(self.rows[-1, 0]))


def prefix_bounds(most: list[int], pair: list[int]) -> list[int]:
    """Bounds of the sums of impacts of the first 0, 1, ... terms; ``pair[i]`` is the joint maximum of terms i and i + 1."""
    bounds = [0]
    for i, own in enumerate(most):
        bound = bounds[i] + own
        if i:
            bound = min(bound, bounds[i - 1] + max(pair[i - 1], most[i - 1], own))
        bounds.append(bound)
    return bounds


def search_shard(shard: Shard, terms: list[int], bounds: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents whose score is above 0 and not below the threshold, and their scores."""
    if bounds[-1] < max(1, threshold):
        return shard.docs[:0], shard.impacts[:0]
    optional = sum(b < threshold for b in bounds[1:])
    total = np.zeros(shard.n_docs, np.int64)
    for t in terms[optional:]:
        docs, impacts = shard.postings(t)
        total[docs] += impacts
    docs = np.flatnonzero((total > 0) & (total + bounds[optional] >= threshold))
    scores = total[docs]
    for i in range(optional - 1, -1, -1):
        shard.add(terms[i], docs, scores)
        stay = scores + bounds[i] >= threshold
        docs, scores = docs[stay], scores[stay]
        if not len(docs):
            break
    return docs, scores


def _walk(asks: Questions, k: int, thresholds: list[int], heads_only: bool):
    """The k best documents of a task's shards for each item: of all documents or, for first thresholds, of the heads of the pair lists."""
    terms_of = [t.tolist() for t in asks.terms]
    chains = [asks.chain(i) for i in range(len(asks.terms))]

    def run(batches):
        best = [Best(k, t) for t in thresholds]
        for batch in batches:
            for row in batch.to_pylist():
                ids, absent = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["absent"], bool)
                terms, counts, docs = (np.frombuffer(row[c], "<i4") for c in ("terms", "counts", "docs"))
                shard = Shard.of(len(ids), terms, counts, docs, np.frombuffer(row["impacts"], "<i8"))
                most = dict(zip(terms.tolist(), np.frombuffer(row["most"], "<i8").tolist()))
                pairs = np.frombuffer(row["pairs"], "<i4").tolist()
                joint = dict(zip(pairs, np.frombuffer(row["joint"], "<i8").tolist()))
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["head_sizes"], "<i4"), dtype=np.int64)])
                head_of = dict(zip(pairs, zip(ends.tolist(), ends[1:].tolist())))
                heads = np.frombuffer(row["heads"], "<i4")
                for own, chain, found in zip(terms_of, chains, best):
                    bounds = prefix_bounds([most.get(t, 0) for t in own], [joint.get(p, 0) for p in chain])
                    if bounds[-1] < max(1, found.threshold):
                        continue
                    if heads_only:
                        lists = [heads[slice(*head_of[p])] for p in chain if p in head_of]
                        met, times = np.unique(np.concatenate(lists), return_counts=True) if lists else (docs[:0], None)
                        chosen = np.sort(met[np.argsort(-times, kind="stable")[:2 * k]]).astype(np.int64) if lists else met
                        scores = np.zeros(len(chosen), np.int64)
                        for t in own:
                            shard.add(t, chosen, scores)
                        chosen, scores = chosen[scores > 0], scores[scores > 0]
                    else:
                        chosen, scores = search_shard(shard, own, bounds, found.threshold)
                    if len(chosen):
                        found.add(scores, absent[chosen], ids[chosen])
        for ask, found in enumerate(best):
            if len(found.rows):
                missing = found.rows[:, 1].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.rows), ask), pa.int32()), pa.array(found.rows[:, 2], pa.int64(), mask=missing), pa.array(-found.rows[:, 0], pa.int64())],
                                                 [c.split()[0] for c in FOUND.split(", ")])

    return run


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def rank(docs: DataFrame, items: DataFrame, k: int = K, doc_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """item, rank, document, score: the k best documents of each row of items."""
    asked = items.select(F.col(item_col).alias("__item"), F.monotonically_increasing_id().alias("__row"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    asked = materialize(asked.select("__item", "__row", "text", _digest(F.col("text")).alias("digest")), "lex-items")
    distinct = asked.groupBy("digest").agg(F.first("text").alias("text"))
    n_blocks = max(1, math.ceil((distinct.agg(F.sum(F.length("text"))).first()[0] or 0) / QUESTION_CHARS))
    slim = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    results = None
    for b in range(n_blocks):
        block = distinct.filter(F.pmod(F.xxhash64("digest"), F.lit(n_blocks)) == b).orderBy("digest").toArrow()
        found = _search(slim, block.column("text").to_pylist(), k)
        if found is None:
            continue
        digests = items.sparkSession.createDataFrame(pa.table({"ask": pa.array(range(block.num_rows), pa.int32()), "digest": block.column("digest").cast(pa.string())}))
        one = found.join(digests, "ask").select("digest", "rank", "doc_id", "score")
        results = one if results is None else results.unionByName(one)
    if results is None:
        empty = asked.filter("false")
        return empty.select(F.col("__item").alias(item_col), F.lit(0).alias("rank"), F.lit(None).cast("long").alias(doc_col), F.lit(None).cast("long").alias("score"))
    return asked.join(results, "digest").select(F.col("__item").alias(item_col), "rank", F.col("doc_id").alias(doc_col), "score")


def _search(docs: DataFrame, texts: list[str], k: int) -> DataFrame | None:
    """ask (number of the text), rank, doc_id, score; None if the texts have no term."""
    h, of = term_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    vocabulary = np.unique(h)
    if not len(vocabulary):
        return None
    number = np.searchsorted(vocabulary, h)
    terms = [np.unique(number[a:b]) for a, b in zip(np.searchsorted(of, range(len(texts))), np.searchsorted(of, range(len(texts)), "right"))]
    shards = materialize(docs.mapInArrow(_shards(vocabulary), SHARD), "lex-shards")
    counted = shards.select("lengths", "terms", "counts").mapInArrow(_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist()))  # a number a term of the block of items
    n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
    asks = Questions(terms, np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64), n_docs, n_terms)
    index = materialize(shards.mapInArrow(_index(asks, k), INDEX), "lex-index")
    along = W.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def best(thresholds: list[int], heads_only: bool) -> DataFrame:
        found = index.mapInArrow(_walk(asks, k, thresholds, heads_only), FOUND)
        return found.withColumn("rank", F.row_number().over(along).cast("int")).filter(F.col("rank") <= k)

    thresholds = [0] * len(texts)
    for row in best(thresholds, True).filter(F.col("rank") == k).collect():  # a number an item of the block
        thresholds[row["ask"]] = row["score"]
    return best(thresholds, False).select("ask", "rank", "doc_id", "score")


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents
), i as (
  select row_number() over () as q, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark
), total as (
  select count(*) filter (len(t) > 0) as n_docs, cast(sum(len(t)) as bigint) as n_terms from d
), asked as (
  select q, item_id, unnest(t) as term from i
), posting as (
  select r, doc_id, n, term, count(*) as tf
  from (select r, doc_id, len(t) as n, unnest(t) as term from d)
  where term in (select term from asked)
  group by r, doc_id, n, term
), term as (
  select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w
  from posting, total group by term, n_docs
), scored as (
  select q, item_id, r, doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) as bigint) as score
  from asked join posting using (term) join term using (term), total
  group by q, item_id, r, doc_id
), ranked as (
  select item_id, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as int) as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
