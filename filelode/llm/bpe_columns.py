"""Encoding and decoding of a text column.

Defined cases: a null or empty text has no ids and decodes to the empty text. Repeated rows are encoded alike. Only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm import bpe


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``ids`` (array of int)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            ids = [x.astype("int32") for x in model.encode_batch(t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(encoded, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and ``text``; null ids decode to the empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    narrow = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(decoded, "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: ``n_tokens`` and the SHA-256 of the ids (decimal, one space between) and the text."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        decimals = model.names.copy()
        decimals[:] = [str(i) for i in range(len(decimals))]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in model.encode_batch(t.as_py() for t in batch.column(1)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(decimals[ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids).encode("utf-8", "replace")).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
