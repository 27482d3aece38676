"""Token counts without ids: pieces per distinct pre-token times its frequency in each document.

The scan cuts texts into pre-tokens (see ``pieces``) and gathers, per block of
documents, each distinct pre-token once with its frequencies: the documents that
hold it once, and (document, count) pairs. The pre-tokens of a block are dealt
to buckets by their hash, one row for all of a bucket. One shuffle by bucket
brings all frequencies of a pre-token to one task, where its pieces are counted
once and joined to them; the sums go to per-document totals, and a second, small
shuffle by block adds these up. No ids are ever kept.

Skew and memory: a pre-token in at least one document of sixteen of a block goes
to the block's own bucket, so its frequencies spread over all buckets. There are
four buckets to a shuffle partition, so they grow in number with the session's
setting. Workers hold one block, a bounded memory of counted pre-tokens and at
most ``OPEN_BLOCKS`` sums.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
and repeated or null ids each get their own row; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
BLOCK_CHARS = 6_000_000
BLOCK_DOCS = 4096
OPEN_BLOCKS = 2000
#: A pre-token in this share of a block's documents is spread over the buckets.
HOT_SHARE = 1 / 16
BUCKETS_PER_PARTITION = 4

PAIR = np.dtype([("doc", "<u2"), ("n", "<u4")])
#: Per pre-token: its bytes, the documents that hold it once, the documents that hold it more often.
SIZES = np.dtype([("bytes", "<u4"), ("once", "<u2"), ("more", "<u2")])
LISTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("sizes", pa.binary()), ("once", pa.binary()), ("more", pa.binary()),
                   ("doc_ids", pa.binary()), ("n_bytes", pa.binary())])
SUMS = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("doc_ids", pa.binary()), ("n_bytes", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)


def _ids(column: pa.Array) -> bytes:
    """Values and null marks of an id column."""
    marks = np.asarray(column.is_null().to_numpy(zero_copy_only=False), np.uint8)
    return column.fill_null(0).to_numpy().astype("<i8").tobytes() + marks.tobytes()


def _frequencies(model, texts: list[str], block: int, buckets: int):
    """(bucket, tokens, sizes, once, more) for the buckets that the block's pre-tokens fall into."""
    tokens, of, doc, keys = model.cut_hashed(texts)
    if not tokens:
        return
    n_docs = len(texts)
    key, count = np.unique(of * n_docs + doc, return_counts=True)
    token, doc = key // n_docs, (key % n_docs).astype("<u2")
    held = np.bincount(token, minlength=len(tokens))
    spread = held >= max(64, n_docs * HOT_SHARE)
    bucket = np.where(spread, (block * 0x9E3779B1 >> 16) % buckets, (keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(tokens), np.int64)
    place[order] = np.arange(len(tokens))
    by = np.argsort(place[token], kind="stable")
    token, doc, count = place[token][by], doc[by], count[by]
    data = [tokens[i].encode() for i in order.tolist()]
    sizes = np.zeros(len(tokens), SIZES)
    sizes["bytes"] = np.fromiter(map(len, data), np.int64, len(data))
    one = count == 1
    sizes["once"], sizes["more"] = np.bincount(token[one], minlength=len(data)), np.bincount(token[~one], minlength=len(data))
    more = np.zeros(int((~one).sum()), PAIR)
    more["doc"], more["n"] = doc[~one], count[~one]
    once = doc[one]
    ends = {c: np.concatenate([[0], np.cumsum(sizes[c].astype(np.int64))]) for c in SIZES.names}
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(data)]):
        cut = {c: slice(e[a], e[b]) for c, e in ends.items()}
        yield int(bucket[order[a]]), b"".join(data[a:b]), sizes[a:b].tobytes(), once[cut["once"]].tobytes(), more[cut["more"]].tobytes()


def _gather(path: str, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        from nightjar.llm.pieces import blocks, pieces

        model, seq = pieces(path), 0
        for batch in blocks(batches, BLOCK_CHARS, BLOCK_DOCS):
            block = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            texts = [model.normaliser.text(t or "") for t in batch.column("text").to_pylist()]
            rows = [(block % buckets, block, b"", b"", b"", b"", _ids(batch.column("doc_id")), _ids(batch.column("n_bytes")))]
            rows += [(bucket, block, *packed, None, None) for bucket, *packed in _frequencies(model, texts, block, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), LISTS.types)], schema=LISTS)

    return run


def _count(path: str):
    def flush(held: dict) -> pa.RecordBatch:
        packed = []
        for sums in held.values():
            pairs = np.zeros(np.count_nonzero(sums), PAIR)
            pairs["doc"] = np.flatnonzero(sums)
            pairs["n"] = sums[pairs["doc"]]
            packed.append(pairs.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(held), pa.binary()), pa.nulls(len(held), pa.binary())], schema=SUMS)

    def run(batches):
        from nightjar.llm.pieces import pieces

        model, held = pieces(path), {}
        for batch in batches:
            head = pc.is_valid(batch.column("doc_ids"))
            heads = batch.filter(head)
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([heads.column("block"), heads.column("tokens"), heads.column("doc_ids"), heads.column("n_bytes")], schema=SUMS)
            for row in batch.filter(pc.invert(head)).select(LISTS.names[1:6]).to_pylist():
                sizes = np.frombuffer(row["sizes"], SIZES)
                ends = np.cumsum(sizes["bytes"].astype(np.int64)).tolist()
                tokens = [row["tokens"][a:b].decode() for a, b in zip([0, *ends], ends)]
                n = np.fromiter(map(len, model.ids(tokens)), np.int64, len(tokens)) // 4
                once, more = np.frombuffer(row["once"], "<u2"), np.frombuffer(row["more"], PAIR)
                if row["block"] not in held:
                    if len(held) >= OPEN_BLOCKS:
                        yield flush(held)
                        held.clear()
                    held[row["block"]] = np.zeros(BLOCK_DOCS, np.int64)
                add = np.bincount(once, np.repeat(n, sizes["once"]), BLOCK_DOCS) + np.bincount(more["doc"], np.repeat(n, sizes["more"]) * more["n"], BLOCK_DOCS)
                held[row["block"]] += add.astype(np.int64)
        if held:
            yield flush(held)

    return run


def _add_up(group: pa.Table) -> pa.Table:
    head = group.filter(pc.is_valid(group.column("doc_ids")))
    columns = []
    for name in ("doc_ids", "n_bytes"):
        data = head.column(name)[0].as_py()
        n = len(data) // 9
        columns.append(pa.array(np.frombuffer(data, "<i8", n), pa.int64(), mask=np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)))
    total = np.zeros(BLOCK_DOCS, np.int64)
    for packed in group.column("sums").to_pylist():
        pairs = np.frombuffer(packed, PAIR)
        total += np.bincount(pairs["doc"], pairs["n"], BLOCK_DOCS).astype(np.int64)
    return pa.table({"doc_id": columns[0], "n_bytes": columns[1], "n_tokens": total[:len(columns[0])]})


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = slim.mapInArrow(_gather(model_path, buckets), ddl(LISTS))
    sums = lists.repartition("bucket").mapInArrow(_count(model_path), ddl(SUMS))
    counted = sums.groupBy("block").applyInArrow(_add_up, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
