"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest. A batch is hashed once, grouped by digest with map-side partial
aggregates, sort-merge anti-joined with the index, and what is new is appended to the index in the same layout, so the
index side of that join is neither shuffled nor sorted when it is read. The number of buckets is kept with the index, so
a session with other settings reads it as it was written.

A batch that is run again, after a failure say, gets the answers of its first run: the index already names its rows as
those that stay, and nothing is appended twice. (Rows without an id are the exception: they are known then.)

Defined cases: a null text counts as empty. Rows of equal text and equal id are one document: they get the same answer.
A null id never becomes ``keep_id`` while a row of equal text has an id. An empty batch gives an empty result and leaves
the index as it is. Only the id and text columns are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelode.llm.common import SPACE, attach_groups, checkpoint, file_names, make_file


def text_digest(text: Column) -> Column:
    """SHA-256 in hex of the text with each run of ASCII white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


class DigestIndex:
    """A saved table ``(digest, keep_id)`` bucketed and sorted by ``digest``.

    ``path`` puts the table in a shared folder, from which a later session opens it again under any name; without it the
    warehouse holds it. ``buckets`` is for a new index; one that exists keeps its own number.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name = spark, name
        kept = self._kept_buckets(path)
        self.buckets = kept or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if path and not kept:
            make_file(spark, f"{path}/_buckets-{self.buckets}")
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {where}"
        )

    def _kept_buckets(self, path: str | None) -> int | None:
        """The number of buckets of an index that exists, by the catalog or by the marker in its folder."""
        if self.spark.catalog.tableExists(self.name):
            about = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            return int(about["Num Buckets"])
        names = file_names(self.spark, path) if path else []
        marks = [n for n in names if n.startswith("_buckets-")]
        if names and not marks:
            raise ValueError(f"{path} is not empty and not a digest index: it doesn't tell its number of buckets")
        return int(marks[0].removeprefix("_buckets-")) if marks else None

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        (
            fresh.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size`` (in ``docs``), ``kept``, ``text_sha256``.

    ``keep_id`` is the id that the index holds for the text: the smallest of the batch that brought the text first.
    Rows whose text an earlier batch brought are not kept. New digests are in ``index`` afterwards. ``batches`` deals
    ``docs`` out by id, smaller ids first and those without an id last, and appends one batch after the other.
    """
    rows = checkpoint(docs.select(F.col(id_col).cast("long").alias("__id"), text_digest(F.col(text_col)).alias("digest")))
    ends = rows.agg(F.percentile_approx("__id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    batch = F.lit(batches - 1)
    for k, end in reversed(list(enumerate(ends or []))):
        batch = F.when(F.col("__id") <= end, k).otherwise(batch)
    # computed before the anti-join, which would else be pushed below the aggregate and shuffle every row of a hot digest
    groups = checkpoint(rows.groupBy("digest", batch.alias("batch")).agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    brought = []
    for k in range(batches):
        known = index.read().select("digest").hint("merge")
        fresh = checkpoint(groups.where(F.col("batch") == k).join(known, "digest", "left_anti"))
        index.append(fresh.select("digest", F.col("first_id").alias("keep_id")))
        brought.append(fresh.select("digest", F.lit(True).alias("fresh")))
    new = brought[0]
    for more in brought[1:]:
        new = new.unionByName(more)
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    decided = checkpoint(sizes.join(index.read().hint("merge"), "digest").join(new, "digest", "left"))
    stays = (F.col("__id") == F.col("keep_id")) | (F.col("__id").isNull() & F.col("keep_id").isNull() & F.col("fresh").isNotNull())
    return attach_groups(rows, decided, "digest", "group_size", rows.count()).select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(stays, F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
