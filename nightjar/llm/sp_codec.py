"""SentencePiece encoding with byte spans of the original, and decoding.

Texts are normalised with their alignment (longest-prefix replacement through
the model's compiled character map, see ``pieces``), cut into pre-tokens and
encoded; a worker encodes each distinct pre-token once and remembers a bounded
number. Pieces cover the normalised bytes one after another, so running sums
of their lengths looked up in the alignment give each piece's bytes in the
original: ``starts[i]`` to ``ends[i]``. Pieces made by the normaliser (the word
mark put before a text, the end id) have empty spans; byte pieces span their own
byte. Everything is row-local: no shuffle, blocks of bounded size.

Defined results: a null text is encoded as empty (the end id alone); texts of any
length are whole; repeated rows and null ids stay as they are; an empty table
gives no rows; other columns ride along only if named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.session import bound_batches

BLOCK_CHARS = 1_000_000
BLOCK_DOCS = 2048


def encode_block(model, texts: list[str], spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts (each with the end id), ids per text, and span starts and ends (empty without ``spans``)."""
    aligned = [model.normaliser.aligned(t) for t in texts] if spans else None
    tokens, of, doc = model.cut([a[0] for a in aligned] if spans else [model.normaliser.text(t) for t in texts])
    coded = model.ids(tokens)
    flat = np.frombuffer(b"".join(coded), "<i4")
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    first = np.cumsum(size) - size
    n = size[of]
    at = np.cumsum(n) - n
    total = int(n.sum())
    ids = flat[np.repeat(first[of] - at, n) + np.arange(total)] if total else np.zeros(0, np.int32)
    per = np.bincount(doc, n, len(texts)).astype(np.int64) if total else np.zeros(len(texts), np.int64)
    ends_at = np.cumsum(per)
    whole = np.insert(ids, ends_at, model.end)
    if not spans:
        return whole, per + 1, np.zeros(0, np.int64), np.zeros(0, np.int64)
    origin = np.concatenate([a[1] for a in aligned])
    base = np.cumsum([0] + [len(a[1]) for a in aligned])[:-1]
    cover = model.covers[whole]
    stop = np.cumsum(cover)
    before = np.concatenate([[0], stop])[np.cumsum(per + 1) - (per + 1)]
    shift = np.repeat(base - before, per + 1)
    return whole, per + 1, origin[stop - cover + shift], origin[stop + shift]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """Kept columns, ids, (starts, ends: byte spans in the original,) and the decoded text, for every row."""
    def run(batches):
        from nightjar.llm.pieces import blocks, pieces

        model = pieces(model_path)
        for batch in blocks(batches, BLOCK_CHARS, BLOCK_DOCS):
            texts = batch.column("text").to_pylist()
            ids, sizes, starts, ends = encode_block(model, texts, spans)
            lists = [_lists(ids, sizes)] + ([_lists(starts, sizes), _lists(ends, sizes)] if spans else [])
            edges = np.cumsum(sizes).tolist()
            decoded = [model.library.decode(ids[a:b].tolist()) for a, b in zip([0] + edges, edges)]
            yield pa.RecordBatch.from_arrays([batch.column(f"k{i}") for i in range(len(keep))] + lists + [pa.array(decoded, pa.string())],
                                             [*(f"k{i}" for i in range(len(keep))), "ids", *(["starts", "ends"] if spans else []), "decoded"])

    bound_batches(docs.sparkSession)
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = ", ".join(f"k{i} {slim.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    lists = "ids array<int>" + (", starts array<int>, ends array<int>" if spans else "")
    out = slim.mapInArrow(run, f"{kinds}, {lists}, decoded string")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (decimal, joined by blanks) and of the decoded text, and how many bytes of the original the pieces' spans hold."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                          (F.aggregate("ends", F.lit(0).cast("long"), lambda a, x: a + x) - F.aggregate("starts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("spanned_bytes"))
