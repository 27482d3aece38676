"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all of docs, the documents
that the stage before it kept. All but the last return the columns of documents;
``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm import line_dedup, minhash, mixing, sp_codec, toxicity
from nightjar.llm.catalog import PIECE_MODEL
from nightjar.llm.common import DOCUMENT_COLUMNS
from nightjar.operators.lineage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic. The chain trains on the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*DOCUMENT_COLUMNS)
    return toxicity.toxicity(docs, labels).filter(~F.col("is_toxic")).select(*DOCUMENT_COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line."""
    kept = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; of rows equal in id and text, one."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    kept = minhash.near_duplicates(docs).filter("kept").select(F.struct("doc_id", "digest").alias("key")).distinct()
    keyed = docs.withColumn("key", F.struct("doc_id", minhash.text_digest(F.col("text")).alias("digest")))
    return keyed.dropDuplicates(["key"]).join(kept, "key").select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, each a row of its document; a document taken repeatedly has a row for each time."""
    pieces = mixing.mix_pieces(docs.select(*DOCUMENT_COLUMNS), keep=("lang",))
    return pieces.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with byte spans and the decoded text of every piece."""
    coded = sp_codec.encode(docs, PIECE_MODEL, keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("minhash_near_dedup", drop_near_duplicates),
          ("mixing", mix_sources), ("sentencepiece", encode)]

#: Models, hashed samples and sampled blocks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
