"""The corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents with all their columns, the last one packed pieces.
Columns other than ``doc_id``, ``text`` and ``n_chars`` pass through whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelode.llm import exact_dedup as exact
from filelode.llm import packing, simhash, substring_dedup
from filelode.llm import toxicity as tox
from filelode.llm.common import checkpoint, drop_path, ensure_checkpoint_dir, keep_documents, table
from filelode.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels that aren't held out, rejects go.

    Scores stand beside the rows they are of, so rows that share an id are judged each by its own text.
    """
    model = tox.train(docs, table(spark, sf_dir, "labels").where(~tox.is_held_out()))
    return tox.keep_clean(docs, model)


def _unclear(docs: DataFrame) -> bool:
    """Whether an id is null or on several rows."""
    return not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, one row of it; without any id, one row."""
    index = exact.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        kept = checkpoint(exact.exact_dedup(docs, index).where("kept").select("doc_id", "text_sha256"))
    finally:
        index.drop()
    if not _unclear(docs):
        return keep_documents(docs, kept.select("doc_id"))
    rows = docs.withColumn("__digest", exact.text_digest(F.col("text")))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["__digest"] == kept["text_sha256"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows without an id are left alone."""
    if not _unclear(docs):
        return keep_documents(docs, checkpoint(simhash.simhash_dedup(docs).where("doc_id = component_id").select("doc_id")))
    # rows that share an id are judged each by its own text: they are numbered in the order of their ids
    named = docs.where("doc_id IS NOT NULL").withColumn("__digest", exact.text_digest(F.col("text")))
    rows = checkpoint(named.orderBy("doc_id", "__digest").drop("__digest").withColumn("__row", F.monotonically_increasing_id()))
    kept = checkpoint(simhash.simhash_dedup(rows, id_col="__row").where("__row = component_id").select("__row"))
    return keep_documents(rows, kept, "__row").drop("__row").unionByName(docs.where("doc_id IS NULL"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from later ones; documents that nothing is left of go."""
    return substring_dedup.remove_passages(docs, checkpoint(substring_dedup.passages(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), remembered=200_000)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near-dedup", simhash_dedup),
    ("substring dedup", drop_passages),
    ("packing", best_fit_packing),
]

#: A trained model, fingerprints and chains aren't SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them documents are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{n}")
        docs = spark.read.parquet(f"{place}/{n}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_path(spark, place)  # the packing has its pieces checkpointed and reads no documents any more
    return packed
