"""Pushes that send nothing twice, freshness over a stream, lineage through cycles."""

import datetime
import json
import os
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from filelode.operators import catalog, sets
from filelode.sources import push
from filelode.streaming import ingest


def receive(folder, key, rows):
    """A receiver that writes what it gets to a folder, refuses some rows, and fails once if told to."""
    if any(r["n"] == -1 for r in rows):
        raise ValueError("refused")
    if os.path.exists(f"{folder}/break") and len([f for f in os.listdir(folder) if f != "break"]) >= 3:
        os.remove(f"{folder}/break")
        raise RuntimeError("the line is down")
    with open(f"{folder}/{key}-{os.urandom(4).hex()}", "w") as f:
        json.dump([r["n"] for r in rows], f)


@pytest.fixture
def inbox(tmp_path):
    os.mkdir(folder := f"{tmp_path}/inbox")
    return folder


def received(folder):
    return Counter(n for f in os.listdir(folder) if f != "break" for n in json.load(open(f"{folder}/{f}")))


def test_a_task_that_fails_half_way_sends_nothing_twice(inbox, tmp_path):
    writer = push._PushWriter({"job": "j", "send": f"{__name__}:receive", "to": inbox, "ledger": f"{tmp_path}/ledger", "per_batch": "10"})
    rows = [Row(n=n) for n in range(95)]
    open(f"{inbox}/break", "w").close()
    with pytest.raises(RuntimeError):
        writer.write(iter(rows))
    assert sum(received(inbox).values()) == 30
    writer.abort([])
    message = writer.write(iter(rows))
    assert received(inbox) == Counter(range(95)) and [n for _, n, _ in message.batches] == [10] * 9 + [5]
    assert len({k for k, _, _ in message.batches}) == 10


def test_push_from_tasks(spark, inbox, tmp_path):
    rows = spark.range(0, 250).select(F.col("id").alias("n"), F.expr("id div 40").alias("b")).unionByName(spark.createDataFrame([(-1, 99)], "n long, b long"))
    out = push.push(rows, f"{__name__}:receive", inbox, f"{tmp_path}/ledger", ["b", "n"], per_batch=30, batch_by="b", job="one").collect()
    assert received(inbox) == Counter(range(250))
    assert sorted(r.records for r in out if not r.error) == sorted([30, 10] * 6 + [10]) and [(r.records, r.error) for r in out if r.error] == [(1, "refused")]
    again = push.push(rows, f"{__name__}:receive", inbox, f"{tmp_path}/ledger", ["b", "n"], per_batch=30, batch_by="b", job="one").collect()
    assert received(inbox) == Counter(range(250)) and len(again) == len(out)


def test_catalog_push_in_batches(spark):
    def send(batch):
        if batch[0]["b"] == 2:
            raise ValueError("no")

    rows = spark.range(0, 100).select(F.expr("id div 30").alias("b"), "id")
    got = sorted(tuple(r) for r in catalog.push(rows, send, per_batch=20, batch_by="b").collect())
    assert got == [(0, 10, None), (0, 20, None), (1, 10, None), (1, 20, None), (2, 10, "no"), (2, 20, "no"), (3, 10, None)]
    assert sum(r.records for r in catalog.push(rows, send, per_batch=7).collect()) == 100


def test_stream_in_three_batches_is_the_batch_query(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    seen = {
        0: [("/a", 1, "h1"), ("/b", 1, "h2"), ("/c", 5, "h3")],
        1: [("/a", 1, "h1"), ("/b", 3, "h4"), ("/d", 2, "h5")],
        2: [("/a", 9, "h6"), ("/d", 1, "h7"), ("/b", 3, "h4")],
    }
    rows = [(p, day(m), h, day(20 + 5 * batch), batch) for batch, files in seen.items() for p, m, h in files]
    schema = "path string, modified timestamp, hash string, seen timestamp, batch int"
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_STORE)
    try:
        for batch in [*seen, 9]:
            part = [r for r in rows if r[-1] == batch] or [("/z", day(1), "h", day(60), 9)]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{batch}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            query = ingest.freshness(stream, keep="8 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    want = sets.arrivals(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.path, r.seen, r.status) for r in out if r.status != "gone" and r.path != "/z") == sorted((r.path, r.seen, r.status) for r in want)
    assert {(r.path, r.hash) for r in out if r.status == "gone"} >= {("/c", "h3")}


def test_lineage_through_shared_parts_and_cycles(spark):
    edges = [(n, n - 1) for n in range(1, 21)] + [(n, n - 2) for n in range(2, 21)] + [(100, 101), (101, 100), (None, 1)]
    paths = [(0, "/zero"), (1, "/one"), (100, "/c"), (101, "/d")]
    found = catalog.lineages(spark.createDataFrame(edges, "collection int, part int"), spark.createDataFrame(paths, "collection int, path string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.collection, set()).add(r.path)
    assert got == {0: {"/zero"}, 1: {"/zero", "/one"}, **{n: {"/zero", "/one"} for n in range(2, 21)}, 100: {"/c", "/d"}, 101: {"/c", "/d"}}
