"""Catalog tables: collections and their members, bulk tags, cached results, batches that are pushed somewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.operators.sets import page
from filelode.sources.shared import checkpointed

PUSH_BATCH = 1000


def list_collections(collections: DataFrame, members: DataFrame, files: DataFrame, number: int = 1, per_page: int = 50) -> DataFrame:
    """A page of collections, newest first, with the files and bytes they hold."""
    sizes = members.join(files.select("hash", "size").dropDuplicates(["hash"]), "hash").groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_size_bytes")
    )
    zero = F.lit(0).cast("long")
    some = page(collections, number, per_page, [F.desc("date_modified"), F.col("collection_id")])
    return some.join(sizes, "collection_id", "left").withColumns(
        {"total_files": F.coalesce("total_files", zero), "total_size_bytes": F.coalesce("total_size_bytes", zero)}
    )


def set_privacy(collections: DataFrame, ids: Sequence[object], private: bool) -> DataFrame:
    return collections.withColumn("is_private", F.when(F.col("collection_id").isin(list(ids)), F.lit(private)).otherwise(F.col("is_private")))


def delete_collections(collections: DataFrame, members: DataFrame, ids: Sequence[object]) -> tuple[DataFrame, DataFrame]:
    kept = ~F.col("collection_id").isin(list(ids))
    return collections.where(kept), members.where(kept)


def sync(members: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members as ``wanted`` has them (``collection_id``, ``hash``) for the collections it names, and counts of the change."""
    keys = ["collection_id", "hash"]
    named = wanted.select("collection_id").distinct()
    others = members.join(named, "collection_id", "left_anti").select(*keys)
    target = wanted.select(*keys).distinct()
    sides = (
        members.join(named, "collection_id", "left_semi").select(*keys).distinct().select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(target.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    )
    by = sides.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    counts = by.groupBy("collection_id").agg(
        F.count_if(F.expr("o = 0")).alias("added"), F.count_if(F.expr("n = 0")).alias("removed"), F.count_if(F.expr("o = 1 AND n = 1")).alias("unchanged")
    )
    return others.unionByName(target), counts


def tag_all(files: DataFrame, tags: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Each tag (name, value, private) for each file; the tags are arguments, so they travel in the plan."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit(p).alias("private")) for n, v, p in tags))
    return files.select("hash", F.explode(rows).alias("t")).select("hash", "t.*")


def cached_or_computed(files: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], skip: bool = False) -> DataFrame:
    """``path``, ``modified``, ``hash``, ``origin``: from the cache where path and time are equal, else from ``compute``.

    ``compute`` gets only the files that the cache lacks, and returns ``path``, ``modified``, ``hash`` of them.
    """
    keys = ["path", "modified"]
    held = cache.limit(0) if skip else cache
    hits = files.select(*keys).join(held.select(*keys, "hash"), keys).where("hash IS NOT NULL")
    misses = files.join(hits.select(*keys), keys, "left_anti")
    made = compute(misses).select(*keys, "hash")
    return hits.select(*keys, "hash", F.lit("cache").alias("origin")).unionByName(made.withColumn("origin", F.lit("disk")))


def cached_scan(files: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], skip: bool = False, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``cached_or_computed`` gives, and the cache afterwards (``path``, ``modified``, ``hash``).

    With ``skip`` the cache is not looked at, and not written either unless ``overwrite``.
    """
    found = cached_or_computed(files, cache, compute, skip)
    if skip and not overwrite:
        return found, cache
    made = found.where("origin = 'disk'").select("path", "modified", "hash")
    return found, cache.select("path", "modified", "hash").join(made.select("path"), "path", "left_anti").unionByName(made)


def push(records: DataFrame, send: Callable[[list[dict]], None], per_batch: int = PUSH_BATCH, batch_by: str | None = None) -> DataFrame:
    """Send records in batches from the tasks that have them: one row per batch with its size and, if it failed, why.

    With ``batch_by`` rows of one value are sent together (at most ``per_batch`` at a time), and each outcome tells the
    value. A batch that fails doesn't stop the others. A task that is run again sends its batches again, so ``send`` must bear
    that; ``sources.push`` sends nothing twice.
    """
    names = [batch_by] * bool(batch_by) + ["records", "error"]
    kinds = ([records.schema[batch_by].dataType.simpleString()] if batch_by else []) + ["long", "string"]

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []
        outcomes: list[tuple] = []

        def flush() -> None:
            try:
                send(waiting)
                error = None
            except Exception as fault:  # reported as data
                error = str(fault)
            outcomes.append((*([waiting[0][batch_by]] if batch_by else []), len(waiting), error))
            waiting.clear()

        def told() -> pd.DataFrame:
            out = pd.DataFrame(outcomes, columns=names)
            outcomes.clear()
            return out

        for frame in frames:
            for row in frame.to_dict("records"):
                if waiting and (len(waiting) >= per_batch or (batch_by and row[batch_by] != waiting[0][batch_by])):
                    flush()
                waiting.append(row)
            yield told()
        if waiting:
            flush()
        yield told()

    dealt = records.repartitionByRange(batch_by).sortWithinPartitions(*records.columns) if batch_by else records
    return dealt.mapInPandas(sent, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def lineage(source: dict) -> list[str]:
    """The different places that a collection comes from, in order, through merges of merges."""
    if source.get("type") != "merged":
        return [source["path"]] if source.get("path") else []
    return list(dict.fromkeys(p for part in source.get("sources", []) for p in lineage(part)))


def lineages(edges: DataFrame, paths: DataFrame, most_steps: int = 10_000) -> DataFrame:
    """(``collection``, ``path``) of every place that a collection comes from, however deep its merges are nested.

    ``edges``: (``collection``, ``part``), a row for each part of a merge; ``paths``: (``collection``, ``path``) of those that
    come from a place. Each step follows the edges of the pairs that the step before found and keeps what was not there, so
    parts that merges share are followed once and a cycle ends; a step is a checkpoint.
    """
    steps = edges.select("collection", "part").where("collection IS NOT NULL AND part IS NOT NULL").distinct()
    steps = checkpointed(steps)
    reach = fresh = steps
    for _ in range(most_steps):
        further = fresh.select("collection", F.col("part").alias("__via")).join(steps.select(F.col("collection").alias("__via"), "part"), "__via").select("collection", "part")
        fresh = checkpointed(further.distinct().join(reach, ["collection", "part"], "left_anti"))
        if fresh.isEmpty():
            break
        reach = reach.unionByName(fresh)
    own = paths.select("collection", F.col("collection").alias("part")).distinct()
    both = reach.unionByName(own).distinct()
    return both.join(paths.select(F.col("collection").alias("part"), "path"), "part").select("collection", "path").distinct()
