"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A text is a bag of five-word shingles (lower-case words). A shingle weighs its
frequency in the text times 1 + IDF_SHARE * ln(N / df) / ln(N), df counted over
all documents. Two texts are linked if their weighted Jaccard similarity is at
least ``THRESHOLD``; classes are the connected components of links, equal texts
always being in one class.

1. The scan gathers, per block of documents, each shingle with the block's
   distinct texts that hold it, and deals the shingles to buckets by their hash.
2. Each bucket counts document frequencies and sends back, per block, the
   shingles that more than one document has. A text shares all the weight it has
   in common with another through such shingles, so a text with less than
   ``THRESHOLD`` of its weight in them has no partner and leaves, exactly.
3. Every text left gets ``BANDS * ROWS`` samples (ICWS: equal for two texts with
   probability their weighted Jaccard similarity), hashed in bands of ``ROWS``.
   Similarity 0.8 meets in some band with probability 0.9998. Shingles that no
   other text has are sampled as stand-ins of the same weight, which changes
   nothing, as they can't agree with another text.
4. The texts of a band are ordered by the share of their weight that no other text
   has: the original of near copies comes first. A text first meets one text, the
   first of the first texts of its bands; then, while a band holds texts of
   different components, these meet the band's first text, random texts of the
   band in a few rounds, and last each other. Pairs that can't reach the threshold for the weight
   that either holds alone are left out; the others are verified on their whole
   weighted shingle sets. No candidate pair across components stays untested, while a
   group of near copies costs a pair a text.

Skew and memory: copies in a block are one text with a count; a shingle in one
document of sixteen of a block is hot: only its count goes to its bucket, its
documents go straight to the block. Buckets number four to a shuffle partition.
Shingles are compared by 48 bits and the bucket's number while counting and by
40 bits within a pair of texts.

Defined results: a null text is empty; texts of fewer than five words have one
shingle of all their words, texts without words none (they are only like equal
texts); class_id is the smallest doc_id of a class, null if it has no id; rows
with one id and different texts are different documents; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightjar.operators.lineage import materialize
from nightjar.session import bound_batches

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 16, 4
IDF_SHARE = 0.5
#: Rounds in which the texts of a split band meet a random text of it.
RANDOM_LEADS = 3
#: Edges that one task takes without a shuffle, at most; their number never grows in a round.
FEW_EDGES = 1 << 14
BLOCK_CHARS = 3_000_000
BLOCK_DOCS = 4096
HOT_SHARE = 1 / 16
BUCKETS_PER_PARTITION = 4
#: Cells (elements x samples) that are drawn at once; about ten numbers of 8 bytes are held for each.
CELLS = 1 << 17
SEED = 11

KEPT_BITS = 40
#: Steps of the document-frequency scale: eight to a doubling.
DF_STEPS = 8

U = np.uint64
ROW = pa.schema([("kind", pa.int64()), ("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
#: Kinds of rows between the stages. A block's texts (digests, shingles per text) and its hot shingles (hash, units, texts) wait for the counts.
TEXTS, HOT_TEXTS = 0, 1
#: A bucket's shingles of a block (hash, units and frequency, texts); its hot ones (hash, frequency).
PLAIN, HOT = 2, 3
#: The same, counted: hash, units and frequency step, texts; hash and frequency step.
PLAIN_COUNTED, HOT_COUNTED = 4, 5


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the text of each."""
    from nightjar.llm.pieces import run_hashes

    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    blank = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    words = mix(run_hashes(data, starts, ends, 0))
    heads = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    text = np.searchsorted(heads, starts, "right") - 1
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < width))
    total = np.zeros(max(0, len(words) - width + 1), U)
    for j in range(width):
        total = mix(total * U(0x9E3779B97F4A7C15) + words[j:len(words) - width + 1 + j]) if len(total) else total
    whole = text[:len(total)] == text[width - 1:]
    extra = []
    for i in short.tolist():
        h = np.full(1, n[i], U)
        for w in words[first[i]:first[i] + n[i]]:
            h = mix(h * U(0x9E3779B97F4A7C15) + w)
        extra.append(h[0])
    return np.concatenate([total[whole], np.array(extra, U)]), np.concatenate([text[:len(total)][whole], short])


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences in as few bytes each as the largest needs."""
    gaps = np.diff(values, prepend=U(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :data[0]] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=U)


def _gather(buckets: int):
    def run(batches):
        from pyspark import TaskContext

        from nightjar.llm.pieces import blocks

        seq = 0
        for batch in blocks(batches, BLOCK_CHARS, BLOCK_DOCS):
            block = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            number: dict[str, int] = {}
            copies = np.bincount([number.setdefault(t, len(number)) for t in batch.column("text").to_pylist()])
            texts = list(number)
            h, text = shingles(texts)
            order = np.lexsort((text, h))
            h, text = h[order], text[order].astype("<u2")
            bucket, value = h % U(buckets), (h // U(buckets)) & U((1 << 48) - 1)
            order = np.lexsort((text, value, bucket))
            bucket, value, text = bucket[order].astype(np.int64), value[order], text[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
            first = np.flatnonzero(new)
            units = np.diff(np.append(first, len(value)))
            again = new.copy()
            again[1:] |= text[1:] != text[:-1]
            df = np.add.reduceat(np.where(again, copies[text], 0), first) if len(first) else np.zeros(0, np.int64)
            hot = df >= max(64, batch.num_rows * HOT_SHARE)
            own_texts = np.bincount(text, minlength=len(texts))
            digests = b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts)
            bucket, value = bucket[first], value[first]
            unit_hot = np.repeat(hot, units)
            full = (value[hot] * U(buckets) + bucket[hot].astype(U))
            at = np.argsort(full)
            hot_texts = np.split(text[unit_hot], np.cumsum(units[hot])[:-1]) if hot.any() else []
            rows = [(TEXTS, block % buckets, block, digests, own_texts.astype("<u4").tobytes(), b""),
                    (HOT_TEXTS, block % buckets, block, pack(full[at]), units[hot][at].astype("<u4").tobytes(), b"".join(hot_texts[i].tobytes() for i in at.tolist()))]
            for kind in (PLAIN, HOT):
                mine = np.flatnonzero(hot == (kind == HOT))
                cuts = np.flatnonzero(np.diff(bucket[mine])) + 1
                for part in np.split(mine, cuts) if len(mine) else []:
                    counts = np.column_stack([units[part], df[part]]).astype("<u4")
                    a, b = first[part[0]], first[part[-1]] + units[part[-1]]
                    held = b"" if kind == HOT else text[a:b][~unit_hot[a:b]].tobytes()
                    rows.append((kind, int(bucket[part[0]]), block, pack(value[part]), _counts(counts), held))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROW.types)], schema=ROW)

    return run


def _counts(counts: np.ndarray) -> bytes:
    """Pairs (units, df): a byte each where they fit, which is nearly always."""
    if len(counts) and (counts == 1).all():
        return b"1"
    return b"s" + counts.astype(np.uint8).tobytes() if not len(counts) or counts.max() < 256 else b"l" + counts.astype("<u4").tobytes()


def _uncounted(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b"1":
        return np.ones((n, 2), np.int64)
    return np.frombuffer(data, np.uint8 if data[:1] == b"s" else "<u4", offset=1).astype(np.int64).reshape(-1, 2)


def _frequencies(group: pa.Table, buckets: int) -> pa.Table:
    rows = group.to_pylist()
    out = [r for r in rows if r["kind"] in (TEXTS, HOT_TEXTS)]
    parts = [r for r in rows if r["kind"] in (PLAIN, HOT)]
    if parts:
        values = [unpack(r["hashes"]) for r in parts]
        counts = [_uncounted(r["counts"], len(v)) for r, v in zip(parts, values)]
        _, of = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(of, np.concatenate([c[:, 1] for c in counts])).astype(np.int64)
        at = 0
        for r, v, c in zip(parts, values, counts):
            df = total[of[at:at + len(v)]]
            at += len(v)
            more = df >= 2
            if more.any():
                step = np.minimum(255, np.round(np.log2(df[more]) * DF_STEPS)).astype(np.int64)
                hot = r["kind"] == HOT
                texts = b"" if hot else np.frombuffer(r["texts"], "<u2")[np.repeat(more, c[:, 0])].tobytes()
                out.append({"kind": HOT_COUNTED if hot else PLAIN_COUNTED, "bucket": -1, "block": r["block"], "hashes": pack(v[more] * U(buckets) + U(r["bucket"])),
                            "counts": _counts(np.column_stack([c[more, 0], step])), "texts": texts})
    return pa.Table.from_pylist(out, schema=ROW)


def idf(step: np.ndarray, n_docs: int) -> np.ndarray:
    top = max(np.log(2), np.log(max(2, n_docs)))
    return 1 + IDF_SHARE * np.maximum(0, top - step * (np.log(2) / DF_STEPS)) / top


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """ICWS samples (texts x n, hashed) of weighted sets given as runs of elements."""
    out = np.zeros((len(starts), n), U)
    ends = np.append(starts[1:], len(h))
    keys = mix(np.arange(n, dtype=U) + U(SEED * 1000))
    part = lambda v, s: (((v >> U(s)) & U(0x1FFFFF)).astype(np.float64) + 0.5) / (1 << 21)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + CELLS // n, "right"))
        j = max(i + 1, min(j, len(starts)))
        a, b = starts[i], ends[j - 1]
        x, log_w = h[a:b, None], np.log(weight[a:b])[:, None]
        owner = np.repeat(np.arange(j - i), ends[i:j] - starts[i:j])
        width = max(1, min(n, CELLS // max(1, b - a)))  # a text with many elements takes its samples in turns
        for c in range(0, n, width):
            k = keys[None, c:c + width]
            one, two = mix(x ^ k), mix(x + k * U(0x9E3779B97F4A7C15))
            r = -np.log(part(one, 0) * part(one, 21))
            beta = part(one, 42)
            t = np.floor(log_w / r + beta)
            a_log = np.log(-np.log(part(two, 0) * part(two, 21))) - r * (t - beta + 1)
            least = np.minimum.reduceat(a_log, starts[i:j] - a, axis=0)
            row, col = np.nonzero(a_log == least[owner])
            out[i + owner[row], c + col] = mix(h[a:b][row] + mix(t[row, col].astype(np.int64).astype(U)))
        i = j
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U)[None, :] + U(1)
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + sample[:, r::ROWS])
    return key.view(np.int64)


SKETCH = "digest binary, total double, alone double, bands array<bigint>, shared binary, steps binary"


def _sketch(n_docs: int, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        home, hot = (next(r for r in rows if r["kind"] == k) for k in (TEXTS, HOT_TEXTS))
        own = np.frombuffer(home["counts"], "<u4").astype(np.int64)
        hot_h, hot_units = unpack(hot["hashes"]), np.frombuffer(hot["counts"], "<u4")
        hot_texts = np.split(np.frombuffer(hot["texts"], "<u2"), np.cumsum(hot_units)[:-1]) if len(hot_h) else []
        h, text, step = [], [], []
        for r in (r for r in rows if r["kind"] in (PLAIN_COUNTED, HOT_COUNTED)):
            values = unpack(r["hashes"])
            units, steps = _uncounted(r["counts"], len(values)).T
            if r["kind"] == HOT_COUNTED:
                of = [hot_texts[i] for i in np.searchsorted(hot_h, values).tolist()]
                units = np.array([len(x) for x in of])
                text += of
            else:
                text.append(np.frombuffer(r["texts"], "<u2"))
            h.append(np.repeat(values, units))
            step.append(np.repeat(steps.astype(np.uint8), units))
        empty = {"digest": [], "total": [], "alone": [], "bands": [], "shared": [], "steps": []}
        schema = pa.schema([("digest", pa.binary()), ("total", pa.float64()), ("alone", pa.float64()), ("bands", pa.list_(pa.int64())), ("shared", pa.binary()), ("steps", pa.binary())])
        if not h:
            return pa.table(empty, schema=schema)
        h, text, step = mix(np.concatenate(h)) & U((1 << KEPT_BITS) - 1), np.concatenate(text).astype(np.int64), np.concatenate(step)
        weight = idf(step, n_docs)
        rest = own - np.bincount(text, minlength=len(own))
        shared = np.bincount(text, weight, len(own))
        lone = float(idf(np.zeros(1), n_docs)[0])
        total = shared + rest * lone
        stay = (shared >= threshold * total * (1 - 1e-9)) & (own > 0)
        keep = stay[text]
        h, text, step, weight = h[keep], text[keep], step[keep], weight[keep]
        order = np.lexsort((h, text))
        h, text, step, weight = h[order], text[order], step[order], weight[order]
        which = np.flatnonzero(stay)
        if not len(which):
            return pa.table(empty, schema=schema)
        edges = np.searchsorted(text, np.append(which, len(own)))
        digests = [home["hashes"][16 * i:16 * i + 16] for i in which.tolist()]
        # Elements to sample: distinct shared shingles with their whole weight, and stand-ins for the others.
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        summed = np.add.reduceat(weight, first)
        salt = np.array([int.from_bytes(d[:8], "little") for d in digests], U)
        n_rest = rest[which]
        index = np.arange(int(n_rest.sum())) - np.repeat(np.cumsum(n_rest) - n_rest, n_rest)
        stand = mix(np.repeat(salt, n_rest) + index.astype(U)) | U(1 << 63)
        el_h, el_w = np.concatenate([h[first], stand]), np.concatenate([summed, np.full(len(stand), lone)])
        el_t = np.concatenate([np.searchsorted(which, text[first]), np.repeat(np.arange(len(which)), n_rest)])
        order = np.argsort(el_t, kind="stable")
        keys = bands(samples(el_h[order], el_w[order], np.searchsorted(el_t[order], np.arange(len(which)))))
        wide = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BITS // 8]
        return pa.table({"digest": pa.array(digests, pa.binary()), "total": total[which], "alone": (rest * lone)[which], "bands": pa.array(list(keys), pa.list_(pa.int64())),
                         "shared": pa.array([wide[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                         "steps": pa.array([step[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())}, schema=schema)

    return run


def _multiset(shared: bytes) -> np.ndarray:
    """Sorted shingle numbers, each further occurrence told apart from the first."""
    raw = np.zeros((len(shared) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(shared, np.uint8).reshape(-1, 5)
    h = raw.view("<u8").ravel()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return (h << U(20)) + (np.arange(len(h)) - start).astype(U)


def weighted_jaccard(a: dict, b: dict, n_docs: int) -> float:
    x, y = _multiset(a["shared"]), _multiset(b["shared"])
    _, at, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = idf(np.frombuffer(a["steps"], np.uint8)[at], n_docs).sum()
    return float(common / (a["total"] + b["total"] - common))


def _linked(n_docs: int, threshold: float):
    def run(batches):
        for batch in batches:
            keep = [weighted_jaccard({"shared": r["sx"], "steps": r["px"], "total": r["tx"]}, {"shared": r["sy"], "steps": r["py"], "total": r["ty"]}, n_docs) >= threshold - 1e-9
                    for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))], ["x", "y"])

    return run


def _verify(pairs: DataFrame, sketches: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    sides = [sketches.select(F.col("digest").alias(k), F.col("total").alias(f"t{k}"), F.col("shared").alias(f"s{k}"), F.col("steps").alias(f"p{k}")) for k in "xy"]
    both = pairs.join(sides[0], "x").join(sides[1], "y")
    return materialize(both.mapInArrow(_linked(n_docs, threshold), "x binary, y binary"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph given as rows (x, y): alternating large and small stars."""
    edges = materialize(links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "near-edges")
    few = edges.count() <= FEW_EDGES
    together = lambda df: df.coalesce(1) if few else df
    while True:
        both = together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = together(materialize(large, "near-large"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(together(small.filter("u <> v")).distinct(), "near-small")
        # Done when every node has one smaller neighbour, which has none, so that each component is a star around its smallest node.
        ends = together(edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1))))
        chained = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0")
        if not chained.agg(F.count(F.lit(1))).first()[0]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8")))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """digest, component: the class of every text that is linked to a different text."""
    bound_batches(docs.sparkSession)
    n_docs = docs.count()
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = slim.mapInArrow(_gather(buckets), ddl(ROW)).groupBy("bucket").applyInArrow(lambda group: _frequencies(group, buckets), ddl(ROW))
    sketched = counted.groupBy("block").applyInArrow(_sketch(n_docs, threshold), SKETCH)
    sketches = materialize(sketched.dropDuplicates(["digest"]), "near-sketches")
    members = sketches.select("digest", "total", "alone", F.posexplode("bands").alias("band", "key"))
    # The text with the least of its weight alone is the likeliest original of a group of near copies.
    members = members.withColumn("rank", F.struct((F.col("alone") / F.col("total")).alias("share"), "digest"))
    along = W.partitionBy("band", "key").orderBy("rank")
    # First each text meets one text: the first of the first texts of its bands.
    firsts = members.withColumn("first", F.first("rank").over(along)).groupBy("digest").agg(F.min("first").alias("first"))
    tested = materialize(firsts.select(F.col("digest").alias("x"), F.col("first.digest").alias("y")).filter("x <> y"), "near-star")

    def may_match(x: str, y: str) -> Column:
        """What only x or only y of all texts holds is in the union and not in the intersection."""
        col = lambda side, name: F.col(f"{side}.{name}")
        most = F.least(col(x, "total") - col(x, "alone"), col(y, "total") - col(y, "alone"))
        return most >= F.greatest(col(x, "total") + col(y, "alone"), col(y, "total") + col(x, "alone")) * F.lit(threshold * (1 - 1e-9))

    found = components(_verify(tested, sketches, n_docs, threshold))
    for step in ("first", *range(1, RANDOM_LEADS + 1), "all"):
        placed = members.join(found, F.col("digest") == F.col("node"), "left").select("band", "key", "digest", "rank", "total", "alone", F.coalesce("component", "digest").alias("component"))
        # Only bands whose texts are in several components go on: against a lead text of the band, last against all that are still apart.
        order = F.col("rank") if step in ("first", "all") else F.xxhash64("digest", "band", F.lit(step))
        split = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(order, "digest", "component", "total", "alone")).alias("lead")).filter("lo <> hi")
        apart = materialize(placed.join(split.select("band", "key", "lead"), ["band", "key"]), "near-open")
        if apart.isEmpty():
            break
        members = apart.select(*members.columns)  # no other band can be split later, as components only grow
        if step != "all":
            pairs = apart.alias("x").filter((F.col("component") != F.col("lead.component")) & may_match("x", "lead")).select(F.col("digest").alias("x"), F.col("lead.digest").alias("y"))
        else:
            # A pair is made in the first band that it shares, which is split like all that it shares.
            apart = apart.join(sketches.select("digest", "bands"), "digest")
            x, y = apart.alias("x"), apart.alias("y")
            earlier = F.expr("x.band > 0 and exists(sequence(0, greatest(x.band - 1, 0)), j -> x.bands[j] = y.bands[j])")
            pairs = x.join(y, ~earlier & (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.digest") > F.col("y.digest"))
                           & (F.col("x.component") != F.col("y.component")) & may_match("x", "y")).select(F.col("x.digest").alias("x"), F.col("y.digest").alias("y"))
        pairs = materialize(pairs.distinct().join(tested, ["x", "y"], "left_anti"), "near-across")
        if pairs.isEmpty():
            continue
        tested, more = tested.union(pairs), _verify(pairs, sketches, n_docs, threshold)
        if not more.isEmpty():
            # The stars found so far stand for their links.
            found = components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).union(more))
    return found.withColumnRenamed("node", "digest")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), class_size, kept (one document of each class)."""
    classes = materialize(text_classes(docs, threshold), "near-classes")
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
    placed = materialize(rows.join(classes, "digest", "left").select("doc_id", F.coalesce("component", "digest").alias("component"), "digest"), "near-placed")
    per = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
                                          F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    return placed.join(per, "component").select("doc_id", "class_id", "class_size", same.alias("kept"), "digest")
