import hashlib
import json

import pytest
from pyspark.sql import functions as F

from filelode.operators import builders, catalog, collections, records, schemas
from filelode.operators import pipeline as P
from filelode.plans.catalogue import queries


def test_pagination():
    assert collections.pagination(0, 1, 10) == {
        "current_page": 1, "record_count": 0, "page_count": 1, "per_page": 10, "has_next": False, "has_prev": False, "start_index": 0, "end_index": 0,
    }
    last = collections.pagination(25, 3, 10)
    assert (last["start_index"], last["end_index"], last["has_next"], last["page_count"]) == (21, 25, False, 3)
    for number, per_page in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            collections.pagination(5, number, per_page)


def test_populate_wants_an_export_for_many_files(spark):
    members = spark.range(10_002).selectExpr("1 AS collection_id", "CAST(id AS string) AS hash")
    held = members.select("hash", F.lit("r").alias("record"))
    with pytest.raises(ValueError):
        collections.populate(members, held, 1)
    assert collections.populate(members, held, 1, use_export=True).count() == 10_002
    assert collections.populate(members, held, 2).count() == 0


def test_export_is_compressed_lines(spark, tmp_path):
    members = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "collection_id int, hash string")
    held = spark.createDataFrame([("a", "x"), ("b", "y")], "hash string, record string")
    collections.export_collection(members, held, 1, str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*.json.gz"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("hash", "record").collect()] == [("a", "x")]


def test_search_page_refuses_what_makes_no_page(spark):
    rows = spark.createDataFrame([(1, "h", "n", 1, False)], "ordinal long, hash string, name string, owner int, private boolean")
    for wrong in ({"query": " "}, {"query": "n", "per_page": 51}, {"query": "n", "number": 0}, {"query": "n", "sort_by": "color"}, {"query": "n", "scope": "all"}):
        with pytest.raises(ValueError):
            collections.search_page(rows, **wrong)


def test_records_with_too_many_fields_fail(spark):
    many = F.map_from_arrays(F.array(*(F.lit(f"k{i}") for i in range(129))), F.array(*(F.lit(i) for i in range(129))))
    with pytest.raises(Exception, match="more than 128"):
        spark.range(1).select(builders.generic_record(many)).collect()
    with pytest.raises(Exception, match="more than 100"):
        spark.range(1).select(builders.location_record(F.lit(1.0), F.lit(2.0), properties=many)).collect()
    row = spark.range(1).select(builders.regression_record(F.array(builders.regression_point(F.lit(1.5), attributes=F.create_map(F.lit("a"), F.lit(True)))), unit=F.lit("kg"))).first()[0]
    assert json.loads(row) == {"points": [{"value": 1.5, "attributes": {"a": True}}], "unit": "kg"}


def test_scrub_of_nulls_and_lists(spark):
    rows = spark.createDataFrame([("{}",), (None,), ('{"people":[{"name":"A","age":3},null]}',)], "record string")
    got = [r.record for r in records.scrub_nested(rows, ["name"], "people array<struct<name: string, age: int>>").collect()]
    assert got == ['{"people":null}', None, '{"people":[{"name":null,"age":3},null]}']


def test_missing_parts_are_told(spark):
    rows = spark.createDataFrame([(1, "a b " * 4000, 10), (2, "short", 10), (3, "", 10)], "id long, text string, skeleton int")
    parts = records.wrapped(rows, most=8192, reserve=1024)
    whole = {r.id: r for r in records.unwrapped(parts).collect()}
    assert whole[1].text == "a b " * 4000 and whole[1].complete and whole[2].text == "short" and whole[3].text == ""
    less = parts.where("group IS NULL OR group.index <> 1")
    assert not {r.id: r for r in records.unwrapped(less).collect()}[1].complete


def test_chunks_stream_whatever_the_partitions(spark):
    items = spark.range(4000).selectExpr("id % 3 AS k", "id AS n", "CAST(10 + id * 7 % 50 AS long) AS size")
    got = records.number_chunks(items, "k", ["n"], most=500, first=20, later=5).collect()
    for key in range(3):
        mine = sorted((r.n, r.size, r.place, r.chunk) for r in got if r.k == key)
        assert [m[3] for m in mine] == records.chunk_numbers([m[1] for m in mine], 20, 5, 500) and [m[2] for m in mine] == list(range(1, len(mine) + 1))
    with pytest.raises(Exception, match="an item takes"):
        records.number_chunks(items, "k", ["n"], most=40).collect()


def test_schema_faults():
    good = {"type": "object", "properties": {"a": {"type": "string", "pattern": "^x"}}, "required": ["a"]}
    assert schemas.faults(good) == []
    bad = {"type": "thing", "properties": {"a": {"type": "string", "pattern": "(", "maxLength": -1}}, "required": "a", "kind": 1}
    assert schemas.faults(bad) == ["$ has unknown keyword kind", "$.type 'thing' is no type", "$.required is not a list", "$.properties.a.maxLength is not a count", "$.properties.a.pattern is no pattern"]
    with pytest.raises(ValueError):
        schemas.checked(bad)


def base_model(files):
    return F.to_json(F.struct("name"))


def test_registered_steps(spark):
    place = f"{__name__}:base_model"
    steps = P.registered([{"name": "base", "schema": "file/base", "model": place}, {"name": "more", "schema": "open/generic", "model": place, "active": False}])
    rows = spark.createDataFrame([("h", "n")], "hash string, name string")
    assert [tuple(r)[1:] for r in steps.run(rows).collect()] == [(0, "file/base", '{"name":"n"}', None)]
    assert steps.run_one("more", rows).first().record == '{"name":"n"}'
    with pytest.raises(AttributeError):
        P.registered([{"name": "base", "schema": "file/base", "model": f"{__name__}:gone"}])


def test_cached_scan_flags(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, modified int")
    cache = spark.createDataFrame([("a", 1, "old"), ("c", 1, "x")], "path string, modified int, hash string")
    made = lambda rows: rows.withColumn("hash", F.lit("new"))
    cases = {(False, False): ({"old", "new"}, {"a": "old", "b": "new", "c": "x"}), (True, False): ({"new"}, {"a": "old", "c": "x"}), (True, True): ({"new"}, {"a": "new", "b": "new", "c": "x"})}
    for (skip, overwrite), (hashes, after) in cases.items():
        found, held = catalog.cached_scan(files, cache, made, skip, overwrite)
        assert {r.hash for r in found.collect()} == hashes and {r.path: r.hash for r in held.collect()} == after


def test_r3_index_records_indexes_every_file(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "web") for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["hash"]: r["status"] for r in queries()["r3_index_records"](spark, str(tmp_path)).collect()}
    digests = [hashlib.sha256(f"text {k}".encode()).hexdigest() for k in range(30)]
    assert found == {digests[k][1:] if k % 10 == 4 else digests[k]: "invalid" if k % 10 == 4 else "inserted" if k % 3 else "updated" for k in range(30)}
