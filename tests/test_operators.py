import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filelode.operators import aggregates as A
from filelode.operators import filters, sets
from filelode.operators import records as R

FILES = "ordinal long, name string, hash string, size long, media_type string, source string, date_modified timestamp, extension string"


def table(spark, rows):
    base = {"hash": "h", "media_type": "a/b", "source": "disk", "date_modified": datetime(2024, 1, 1), "extension": ".x"}
    return spark.createDataFrame([{"ordinal": i, "name": f"f{i}", **base, **r} for i, r in enumerate(rows)], FILES)


def test_overall_takes_the_first_of_ties(spark):
    df = table(spark, [{"size": 5}, {"size": 9}, {"size": 9}, {"size": 5}])
    r = A.overall(df).first()
    assert (r.total_files, r.total_size, r.avg_size, r.largest, r.smallest, r.newest, r.oldest) == (4, 28, 7.0, "f1", "f0", "f0", "f0")
    r = A.overall(df.limit(0)).first()
    assert (r.total_files, r.total_size, r.avg_size, r.largest) == (0, 0, 0.0, None)


def test_share_by_orders_ties_by_scan_and_names_unknown(spark):
    df = table(spark, [{"size": 1, "media_type": None}, {"size": 1, "media_type": "x/y"}, {"size": 3, "media_type": "z/z"}, {"size": 0, "media_type": ""}])
    rows = A.share_by(df, "media_type").collect()
    assert [(r.media_type, r.files, r.percentage) for r in rows] == [("z/z", 1, 60.0), ("unknown", 2, 20.0), ("x/y", 1, 20.0)]
    assert A.share_by(df.limit(0), "media_type").collect() == []


def test_duplicates_and_their_bounds(spark):
    df = table(spark, [{"hash": "d", "size": 150}, {"hash": "u", "size": 200}, {"hash": "d", "size": 150}, {"hash": "e", "size": 40}, {"hash": "e", "size": 40}])
    sets_ = A.duplicate_sets(df)
    assert [(r.hash, r.copies, r.wasted, r.first_name) for r in sets_.collect()] == [("d", 2, 150, "f0"), ("e", 2, 40, "f3")]
    assert A.duplicate_totals(sets_).first().wasted_text == "190 B"
    assert [r.hash for r in A.duplicate_sets(df, min_size=40).collect()] == ["d"]
    assert [r.hash for r in A.staged_duplicates(df, 40).collect()] == ["d", "e"]
    assert sorted(r.ordinal for r in A.duplicate_members(df, sets_).collect()) == [0, 2, 3, 4]
    assert A.duplicate_totals(A.duplicate_sets(df.limit(0))).first().total_sets == 0


def test_histogram_quartiles_are_exclusive(spark):
    rng = random.Random(1)
    for n in (2, 3, 7, 40, 101):
        values = [rng.randrange(1, 10**6) for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in values], "size long")
        q = statistics.quantiles(values, n=4)
        near = rows.agg(F.percentile_approx("size", list(A.BRACKETS), A.SKETCH)).first()[0]
        assert A._quartiles(rows, n, min(values), max(values), near) == (q[0], q[2])
        assert A.values_at(rows, "size", {(min(values), max(values)): [1, n]}, n, min(values), max(values), parts=3) == {1: min(values), n: max(values)}
    few = table(spark, [{"size": 5}, {"size": 5}, {"size": 9}, {"size": 0}])
    assert [(r.bin, r.lower, r["count"]) for r in A.size_histogram(few).orderBy("bin").collect()] == [(0, 5.0, 2), (1, 9.0, 1)]
    many = table(spark, [{"size": rng.randrange(1, 10**9)} for _ in range(200)])
    assert sum(r["count"] for r in A.size_histogram(many).collect()) == 200
    assert A.size_histogram(many.limit(0)).collect() == []


def test_filter_semantics(spark):
    df = table(spark, [{"size": 5, "source": None}, {"size": 9, "source": "disk"}])
    ids = lambda **k: [r.ordinal for r in filters.matching(df, **k).collect()]
    assert ids(source=None) == [0]
    assert ids(size__gt=5) == [1] and ids(size__gte=5, size__lt=9) == [0]
    assert ids(source__contains="is") == [1] and ids(missing__attribute=1) == [] and ids(size__gt="5") == []
    assert ids(size__in=[5, 7]) == [0] and ids(size__in=[]) == []


def test_media_type_rules(spark):
    df = spark.createDataFrame([("image/svg+xml",), ("image/svg",), ("text/x",), (None,)], "m string")
    rule = lambda **k: [r[0] for r in df.select(filters.media_type_allows(F.col("m"), **k)).collect()]
    assert rule(exclude=["image/svg"]) == [True, False, True, True]
    assert rule(include=["image"], exclude_pattern="image/svg$") == [True, False, False, False]
    assert rule(include_pattern="tex") == [False, False, True, False]


def test_search(spark):
    df = table(spark, [{"size": 2_000_000, "name": "Report one", "extension": ".PDF"}, {"size": 10, "name": "report", "extension": ".txt", "hash": "i"}])
    find = lambda q, **k: [r.ordinal for r in filters.search(df, q, **k).collect()]
    assert find("report size:>1MB") == [0] and find("extension:pdf extension:txt", match_any=True) == [0, 1]
    assert find('"report one"') == [0] and find("") == [0, 1]


def test_union_keeps_left_places_and_right_files(spark):
    left = table(spark, [{"hash": "a", "size": 1}, {"hash": "b", "size": 2}, {"hash": "a", "size": 3}])
    right = table(spark, [{"hash": "c", "size": 4}, {"hash": "a", "size": 5}])
    got = sets.union_by_hash(left, right).orderBy("side", "ordinal").collect()
    assert [(r.hash, r.size) for r in got] == [("a", 5), ("b", 2), ("c", 4)]
    assert [r.ordinal for r in sets.difference_by_hash(left, right).collect()] == [1]
    d = sets.collection_diff(left, right).first()
    assert (d.added, d.removed, d.unchanged) == (1, 1, 1)


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in sets.page(df, 2, 4, [F.col("id")]).collect()] == [4, 5, 6, 7]
    for bad in (0, 4):
        with pytest.raises(ValueError):
            sets.page(df, bad, 4, [F.col("id")])
    assert sets.pagination(10, 3, 4)["has_next"] is False and sets.pagination(0, 1, 4)["page_count"] == 1


def test_chunks_of_lists_and_texts():
    assert R.chunk_numbers([10, 10, 10], 5, 2, 26) == [0, 0, 1]
    with pytest.raises(ValueError):
        R.chunk_numbers([30], 5, 2, 26)
    text = "é\n" * 4000
    parts = R.split_text(text, 100, 8192, 1024)
    assert "".join(parts) == text and len(parts) > 1
    with pytest.raises(ValueError):
        R.split_text("x", 8000, 8192, 1024)


def test_upsert_conflicts(spark):
    kind = "hash string, schema string, source_id string, version string, variant string, record string"
    old = spark.createDataFrame([("h", "core", "a", "1", None, "old"), ("h", "open", "a", "1", None, "old")], kind)
    new = spark.createDataFrame([("h", "core", "b", "2", None, "new"), ("h", "open", "a", "1", None, "new"), ("h", "open", "b", "1", None, "new")], kind)
    rows = {(r.schema, r.source_id): r.record for r in R.upsert_annotations(old, new, ["core"]).collect()}
    assert rows == {("core", "b"): "new", ("open", "a"): "new", ("open", "b"): "new"}
    kept = {(r.schema, r.source_id): (r.record, r.conflict) for r in R.upsert_annotations(old, new, ["core"], overwrite=False).collect()}
    assert kept == {("core", "a"): ("old", True), ("open", "a"): ("old", True), ("open", "b"): ("new", False)}


def test_flat_columns(spark):
    rows = spark.createDataFrame([("h", "a/b", '{"x": 1, "y": [1], "z": {"q": 1}}'), ("g", "a/b", '{"w": null}')], "hash string, schema string, record string")
    assert R.flat_columns(rows) == [("a/b", "w"), ("a/b", "x")]
    wide = R.flatten(spark.createDataFrame([("h",), ("g",)], "hash string"), rows, [("a/b", "x")])
    assert {r.hash: r.a_b__x for r in wide.collect()} == {"h": "1", "g": None}


def test_share_by_sums_beyond_a_long(spark):
    df = table(spark, [{"size": 2**62, "media_type": m} for m in ("a/a", "b/b", "c/c", "d/d")])
    assert [(r.media_type, r.total_size, r.percentage) for r in A.share_by(df, "media_type").collect()] == [(m, 2**62, 25.0) for m in ("a/a", "b/b", "c/c", "d/d")]


def test_panels_by_bytes_beyond_a_long(spark):
    df = table(spark, [{"size": 2**62 + 3, "extension": f".{i:02}"} for i in range(20)] + [{"size": 2**62, "extension": ""}])
    rows = A.panel_by(df, "extension", "total_size").collect()
    assert [(r.extension, int(r.total_size)) for r in rows] == [(f".{i:02}", 2**62 + 3) for i in range(14)] + [("Other", 6 * (2**62 + 3))]
    one = table(spark, [{"size": 2**62, "extension": ".x"} for _ in range(3)])
    assert [(r.extension, int(r.total_size)) for r in A.panel_by(one, "extension", "total_size").collect()] == [(".x", 3 * 2**62)]
    small = A.panel_by(df.where("ordinal < 2"), "extension", "total_size")
    assert dict(small.dtypes)["total_size"] == "bigint" and [r.total_size for r in small.collect()] == [2**62 + 3] * 2
    assert A.panel_by(df.limit(0), "extension", "total_size").collect() == []


def test_largest_files_beyond_a_long(spark):
    df = table(spark, [{"size": 2**62 + i} for i in range(20)])
    rows = A.largest_files(df).collect()
    assert [(r.name, int(r["size"])) for r in rows] == [(f"f{i}", 2**62 + i) for i in range(19, 5, -1)] + [("Other", sum(2**62 + i for i in range(6)))]
    few = A.largest_files(df.where("ordinal < 15"))
    assert dict(few.dtypes)["size"] == "bigint" and few.collect()[-1].asDict() == {"name": "Other", "size": 2**62}
    assert A.largest_files(df.limit(0)).collect() == []
