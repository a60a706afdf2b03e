"""Set operations by content hash, lookups, pages and stable orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_by_hash(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both collections with one file per hash: it stands where its hash came first, and is the last that had it.

    One partial aggregate a hash; ``ordinal`` is the place in the union, left files before right ones.
    """
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))
    place = F.struct("__side", "ordinal")
    payload = F.struct(*(F.col(c) for c in left.columns if c not in ("hash", "ordinal")))
    found = both.groupBy("hash").agg(F.min(place).alias("p"), F.max_by(payload, place).alias("f"))
    return found.select("hash", F.col("p.__side").alias("side"), F.col("p.ordinal").alias("ordinal"), "f.*")


def difference_by_hash(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of the left whose hash the right doesn't have; repeats in the left stay."""
    return left.join(right.select("hash"), "hash", "left_anti")


def first_of_hash(files: DataFrame) -> DataFrame:
    """Each file with its part in a deduplicating scan: the first of its hash is "processed", the others are "duplicate".

    The first is found by an aggregate and joined back, so a hash of very many files is never gathered or sorted.
    """
    first = files.groupBy("hash").agg(F.min("ordinal").alias("__first"))
    status = F.when(F.col("ordinal") == F.col("__first"), "processed").otherwise("duplicate")
    return files.join(first, "hash").withColumn("status", status).drop("__first")


def collection_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: hashes added, removed and unchanged between two collections."""
    sides = old.select("hash").withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).unionByName(new.select("hash").withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))
    by = sides.groupBy("hash").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return by.agg(
        F.count_if(F.expr("o = 0")).alias("added"), F.count_if(F.expr("n = 0")).alias("removed"), F.count_if(F.expr("o = 1 AND n = 1")).alias("unchanged")
    )


def is_indexed(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """Each hash with whether the index has it."""
    known = index.select("hash").distinct().withColumn("__known", F.lit(True))
    return hashes.join(known, "hash", "left").withColumn("indexed", F.coalesce("__known", F.lit(False))).drop("__known")


def identify(files: DataFrame, records: DataFrame) -> DataFrame:
    """The record of each file by its quick hash if just one record has that, else by its full hash.

    ``files`` has ``ordinal``, ``quick_hash`` and ``hash``; ``records`` has ``record_id``, ``quick_hash`` and ``hash``.
    """
    quick = records.where("quick_hash IS NOT NULL").groupBy("quick_hash").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("__quick")).where("n = 1").drop("n")
    full = records.groupBy("hash").agg(F.min("record_id").alias("__full"))
    method = F.when(F.col("__quick").isNotNull(), "QUICK").when(F.col("__full").isNotNull(), "SHA-256")
    return files.join(quick, "quick_hash", "left").join(full, "hash", "left").select("ordinal", F.coalesce("__quick", "__full").alias("record_id"), method.alias("method"))


def fresh(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with what the cache holds for exactly their path and time: ``hash`` null and ``source`` "disk" where nothing."""
    held = cache.select("path", "modified", F.col("hash").alias("__hash"))
    found = files.join(held, ["path", "modified"], "left")
    return found.select(*files.columns, F.col("__hash").alias("cached_hash"), F.when(F.col("__hash").isNotNull(), "cache").otherwise("disk").alias("origin"))


def arrivals(rows: DataFrame) -> DataFrame:
    """``rows`` (``path``, ``batch``, ``modified``), a file's state in each batch that it was seen in, with its ``status``
    there: new, changed, or same. ``streaming.ingest.freshness`` tells this as the batches arrive."""
    before = F.lag("modified").over(Window.partitionBy("path").orderBy("batch"))
    status = F.when(F.col("__before").isNull(), "new").when(F.col("modified") > F.col("__before"), "changed").otherwise("same")
    return rows.withColumn("__before", before).withColumn("status", status).drop("__before")


def page(rows: DataFrame, number: int, per_page: int, order: list[Column]) -> DataFrame:
    """The rows of a page, pages counted from 1; a page out of range raises ValueError."""
    if number < 1 or per_page < 1:
        raise ValueError("pages and their length count from 1")
    out = rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)
    if number > 1 and out.isEmpty():
        raise ValueError(f"there is no page {number}")
    return out


def pagination(total: int, number: int, per_page: int) -> dict[str, int | bool | None]:
    pages = max(1, -(-total // per_page))
    return {
        "current_page": number, "record_count": total, "page_count": pages, "per_page": per_page, "has_next": number < pages, "has_prev": number > 1,
        "start_index": (number - 1) * per_page + 1 if total else 0, "end_index": min(number * per_page, total),
    }


def scan_order(files: DataFrame, key: str, descending: bool = False, limit: int = 20) -> DataFrame:
    """The first files by name (letter case aside), size, media type or time; equal keys stay in scan order either way."""
    by = F.lower("name") if key == "name" else F.col(key)
    return files.orderBy(by.desc() if descending else by.asc(), "ordinal").limit(limit)
