"""Incremental ingest as a stream. The file toolkit defines no streams: this is an extension.

Files that arrive in a folder become base records once each: Spark's file source remembers what it has read, and a
record whose hash came within the watermark is dropped as a duplicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from filelode.sources.files import base_records

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, late: str = "1 day", per_batch: int = 1000) -> DataFrame:
    """Base records of files as they arrive, one per hash within ``late``."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_batch).load(folder)
    return base_records(found).withWatermark("date_modified", late).dropDuplicatesWithinWatermark(["hash"])


def keep(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append records to a Parquet table, each batch once, until all that is there is read."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts(records: DataFrame, every: str = "1 hour") -> DataFrame:
    """Files and bytes by media type and time window."""
    return records.groupBy(F.window("date_modified", every), "media_type").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"))


#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, status string, modified timestamp, hash string, seen timestamp"


class _Freshness(StatefulProcessor):
    """What is known of a file: when it was modified, its hash, when it was seen last. A timer tells when it wasn't seen for long."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "modified long, hash string, seen long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["seen", "modified"], kind="stable")  # of one file, within one batch
        modified, hash_, seen, timer = self.known.get() if self.known.exists() else (None, None, None, None)
        out = []
        for row in arrived.itertuples():
            at, now = row.modified.value // 1000, row.seen.value // 1000
            status = "new" if modified is None else "changed" if at > modified else "same"
            if status != "same":
                modified, hash_ = at, row.hash
            seen = max(now, seen or 0)
            out.append((key[0], status, row.modified, row.hash, row.seen))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = seen // 1000 + self.keep_ms
        self.handle.registerTimer(timer)
        self.known.update((modified, hash_, seen, timer))
        yield pd.DataFrame(out, columns=["path", "status", "modified", "hash", "seen"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        modified, hash_, seen, _ = self.known.get()
        self.known.clear()
        yield pd.DataFrame({"path": [key[0]], "status": ["gone"], "modified": [pd.Timestamp(modified * 1000)], "hash": [hash_], "seen": [pd.Timestamp(seen * 1000)]})

    def close(self) -> None:
        pass


def freshness(found: DataFrame, keep: str = "7 days", late: str = "0 seconds") -> DataFrame:
    """Changes of files as listings arrive: ``found`` is a stream of (``path``, ``modified``, ``hash``, ``seen``).

    A row out for each row in, with the status new, changed (modified later than what is known) or same; and one, gone, of a
    file that no listing had for ``keep`` of the stream's time, which is then forgotten, so the state holds the files there
    are. Needs the session's ``spark.sql.streaming.stateStore.providerClass`` to be ``STATE_STORE``.
    """
    rows = found.select(F.col("path").cast("string"), F.col("modified").cast("timestamp"), F.col("hash").cast("string"), F.col("seen").cast("timestamp")).withWatermark("seen", late)
    processor = _Freshness(int(pd.Timedelta(keep).total_seconds() * 1000))
    return rows.groupBy("path").transformWithStateInPandas(processor, CHANGES, outputMode="Append", timeMode="EventTime")
