"""Records pushed out of Spark in batches, by a data source writer: ``df.write.format("record_push")``.

A task sends batches of ``per_batch`` rows. Each has a key that follows from what is in it, so the receiver can tell a batch
that it has; a ledger in a shared folder holds the keys that were sent, so a task that runs again doesn't send them twice.
What happened to each batch goes to the driver in the task's commit message (a number and at most one text a batch) and
is written beside the ledger when the job commits; when it aborts, the ledger stays, so the next try sends what is left.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PUSH_BATCH = 1000
OUTCOME = "batch string, records long, error string"


@dataclass
class Sent(WriterCommitMessage):
    """(key, records, error) of each batch of a task."""

    batches: list[tuple[str, int, str | None]]


class Ledger:
    """Keys of batches that were sent: an empty file each, in a folder that driver and executors share."""

    def __init__(self, path: str):
        self.system, self.path = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.system.create_dir(self.path)

    def has(self, key: str) -> bool:
        return self.system.get_file_info(f"{self.path}/{key}").type != fs.FileType.NotFound

    def put(self, name: str, data: bytes = b"") -> None:
        with self.system.open_output_stream(f"{self.path}/{name}") as f:
            f.write(data)


def batch_key(job: str, rows: list[dict]) -> str:
    return hashlib.sha256(json.dumps([job, rows], sort_keys=True, default=str).encode()).hexdigest()


def _function(name: str) -> Callable[[str, str, list[dict]], None]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _PushWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.job = options["job"]
        self.target, self.to, self.ledger = options["send"], options["to"], options["ledger"]
        self.per_batch, self.by = int(options.get("per_batch", PUSH_BATCH)), options.get("batch_by") or None

    def _batches(self, rows: Iterator) -> Iterator[list[dict]]:
        waiting: list[dict] = []
        for row in rows:
            row = row.asDict(recursive=True)
            if waiting and (len(waiting) >= self.per_batch or (self.by and row[self.by] != waiting[0][self.by])):
                yield waiting
                waiting = []
            waiting.append(row)
        if waiting:
            yield waiting

    def write(self, iterator: Iterator) -> Sent:
        """Send a task's rows. A batch that the receiver refuses (``ValueError``) is reported; any other fault stops the task."""
        send, ledger, out = _function(self.target), Ledger(self.ledger), []
        for rows in self._batches(iterator):
            key, error = batch_key(self.job, rows), None
            if not ledger.has(key):
                try:
                    send(self.to, key, rows)
                    ledger.put(key)
                except ValueError as fault:
                    error = str(fault)
            out.append((key, len(rows), error))
        return Sent(out)

    def commit(self, messages: list) -> None:
        lines = [json.dumps(dict(zip(("batch", "records", "error"), x))) for m in messages if m is not None for x in m.batches]
        Ledger(self.ledger).put(f"outcome-{self.job}.json", "\n".join(lines).encode())

    def abort(self, messages: list) -> None:
        """Nothing is taken back: what was sent is in the ledger and isn't sent again."""


class RecordPush(DataSource):
    """Options: ``send`` ("module:function" of address, key and rows), ``to`` (the address), ``ledger`` (a shared folder), ``job``, ``per_batch``, ``batch_by``."""

    @classmethod
    def name(cls) -> str:
        return "record_push"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PushWriter(dict(self.options))


def push(records: DataFrame, send: str, to: str, ledger: str, order: list[str], per_batch: int = PUSH_BATCH, batch_by: str | None = None, job: str | None = None) -> DataFrame:
    """Push records, and tell of each batch how many records it has and why it failed, if it did.

    Rows are sorted by ``order`` over the partitions, which tells rows apart, so a task that runs again makes the same
    batches. With ``batch_by`` (its first column) a batch ends where that changes, and at ``per_batch`` rows anyway. Pushed
    again as the same ``job``, batches that were sent are left out.
    """
    spark: SparkSession = records.sparkSession
    spark.dataSource.register(RecordPush)
    job = job or uuid.uuid4().hex
    sorted_rows = records.repartitionByRange(*([batch_by] if batch_by else order)).sortWithinPartitions(*order)
    options = {"send": send, "to": to, "ledger": ledger, "job": job, "per_batch": str(per_batch), "batch_by": batch_by or ""}
    sorted_rows.write.format("record_push").mode("append").options(**options).save()
    return spark.read.schema(OUTCOME).json(f"{ledger}/outcome-{job}.json")
