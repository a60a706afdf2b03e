"""What the corpus operators share: checkpoints, table readers, joins that survive a hot key."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the corpus contracts define it.
SPACE = r"[\x20\x09-\x0D]+"

#: A key is hot when it holds more than this share of the rows; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is not None:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="filelode-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows, through Hadoop's file system, wherever it is."""
    system, where = _folder(spark, path)
    system.delete(where, True)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, wherever it is; none if there is no such folder."""
    system, where = _folder(spark, path)
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def make_file(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it."""
    system, where = _folder(spark, path)
    system.createNewFile(where)


def give_back() -> None:
    """At the end of a task that held much: freed memory goes back to the system, as the Python worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a key, ``size_col`` = rows of that key) that a hot key can't stall.

    Keys with more than ``total * HOT_SHARE`` rows number fewer than ``1 / HOT_SHARE`` whatever the data, so exactly
    those are broadcast and their rows never shuffle; every other key joins by an ordinary shuffle.
    """
    least = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size_col) > least))
    few = groups.where(F.col(size_col) <= least)
    return (
        rows.join(hot, key)
        .unionByName(rows.join(hot.select(key), key, "left_anti").join(few, key))
    )


def keep_documents(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one column ``id_col``), with all their columns."""
    wanted = ids.select(F.col(id_col).alias("__wanted_id"))
    return docs.join(wanted, docs[id_col] == wanted["__wanted_id"], "left_semi")
