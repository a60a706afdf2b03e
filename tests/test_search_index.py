"""Searches by the index give what a scan gives; pages by the layout what a sort gives; one path a result."""

import random
import re

import pytest

from filelode.operators import collections as C
from filelode.operators import filters, search_index
from filelode.operators.search_index import SearchIndex

QUERIES = ["report", "re", "repo 2024", "report extension:pdf", "tag:blue", "tag:blue report", "type:text", "type:text/plain size:>500", "size:<100", "zzz", "report zzz", '"annual report"', "extension:PDF", "Éa.p"]


@pytest.fixture(scope="module")
def files(spark):
    rnd = random.Random(4)
    rows = []
    for n in range(600):
        name = rnd.choice(["Report", "annual report", "x", "Éa", "notes", "repo", ""]) + rnd.choice(["2024", "", "_b"]) + rnd.choice([".pdf", ".txt"])
        tags = rnd.choice([None, [], [("blue", "1")], [("red", "2"), ("blue", "3")]])
        rows.append((n, f"h{n % 200}", None if n % 50 == 0 else name, rnd.choice([".pdf", ".txt", None]), n * 7, rnd.choice(["text/plain", "application/pdf", None]), tags))
    return spark.createDataFrame(rows, "ordinal long, hash string, name string, extension string, size long, media_type string, tags array<struct<name: string, value: string>>")


@pytest.mark.parametrize("listed", [2000, 0])
def test_as_a_scan(spark, files, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(search_index, "LISTED", listed)
    index = SearchIndex.build(files, f"{tmp_path}/index")
    for query in QUERIES:
        for match_any in (False, True):
            for once in (False, True):
                want = sorted(r.ordinal for r in filters.search(files, query, match_any, once).collect())
                assert sorted(r.ordinal for r in index.search(query, match_any, once).collect()) == want, (query, match_any, once)


def test_only_the_buckets_asked_for_are_read(spark, files, tmp_path):
    index = SearchIndex.build(files, f"{tmp_path}/index")
    keys = search_index.keys_of("", "report")
    plan = index._rows_of("keys", keys)._jdf.queryExecution().executedPlan().toString()
    asked = {search_index.bucket_of(k) for k in keys}
    assert "PartitionFilters" in plan and "bucket" in plan
    read = {re.search(r"bucket=(\d+)", f)[1] for f in index._rows_of("keys", keys).select("key", "ordinal").inputFiles()}
    assert {r.bucket for r in index._rows_of("keys", keys).select("bucket").distinct().collect()} <= asked and len(asked) < len(read)


def test_pages(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(c, f"{rnd.randrange(10**6):06}") for c in (1, 2, 3) for _ in range(20 if c == 1 else 900)] * 2
    members = spark.createDataFrame(rows, "collection_id int, hash string")
    layout = C.PageLayout.write(members, f"{tmp_path}/pages", per_part=200)
    for collection in (1, 2, 3, 9):
        mine = sorted({h for c, h in rows if c == collection})
        for number in (1, 2, 7, 30):
            page, about = layout.page(collection, number, 40)
            assert [r.hash for r in page.collect()] == mine[(number - 1) * 40 : number * 40]
            assert about == C.pagination(len(mine), number, 40)
        for after in (None, *(mine[k] for k in (0, 19, 300, 700) if k < len(mine)), "5"):
            want = [h for h in mine if after is None or h > after][:40]
            assert [r.hash for r in layout.after(collection, after, 40).collect()] == want
    files_read = lambda n: len(layout.page(2, n, 40)[0].inputFiles())
    chosen = [len({p.part for p in layout.parts(2)})]
    assert chosen[0] >= 3 and files_read(1)
    plans = [layout.page(2, n, 40)[0]._jdf.queryExecution().executedPlan().toString() for n in (1, 20)]
    assert all("PartitionFilters: [" in p and "part" in p for p in plans)


def test_one_path_a_result(spark):
    results = spark.createDataFrame([("hot", n) for n in range(2000)] + [("a", 1), (None, 2), ("none", 3)], "hash string, n int")
    files = spark.createDataFrame([("hot", f"/{n}", 5000 - n) for n in range(2000)] + [("a", "/b", 2), ("a", "/c", 1)], "hash string, path string, ordinal long")
    got = C.local_paths(results, files).collect()
    assert len(got) == 2003
    assert {(r.hash, r.path) for r in got} == {("hot", "/1999"), ("a", "/c"), (None, None), ("none", None)}
    assert {r.path for r in C.local_paths(results, files.drop("ordinal")).collect() if r.hash == "a"} == {"/b"}
