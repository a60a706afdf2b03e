import hashlib
import re
import uuid

import pytest

from filelode.llm.exact_dedup import DigestIndex, exact_dedup


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min([j for j in ids if j is not None], default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_one_batch_and_a_second(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (3, None), (4, ""), (6, "a b "), (7, "É\x0b\n x"), (8, "É x"), (9, "long " * 5000), (1, " "), (None, "a b")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, digest string, keep_id int")
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    got = exact_dedup(df, index)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    later = spark.createDataFrame([(20, "a b"), (21, "new"), (22, "new")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(later, index).collect()) == [
        (20, 2, 1, False), (21, 21, 2, True), (22, 21, 2, False),
    ]
    assert exact_dedup(later.limit(0), index).collect() == []
    again = DigestIndex(spark, index.name)
    assert again.read().count() == len({r[4] for r in brute(rows)}) + 1
    plan = again.read().select("digest").hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()


def test_an_index_in_a_folder_is_opened_again(spark, tmp_path):
    where = str(tmp_path / "index")
    first = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4, path=where)
    exact_dedup(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), first).collect()
    first.drop()  # the table's entry; its folder stays
    again = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4, path=where)
    got = exact_dedup(spark.createDataFrame([(5, "b"), (6, "c")], "doc_id long, text string"), again).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(5, 2, False), (6, 6, True)]
    again.drop()


def test_an_index_keeps_its_number_of_buckets(spark, tmp_path):
    """Opened under other settings, by its folder and by its name, an index answers as it was written."""
    rows = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    where = str(tmp_path / "index")
    first = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=8, path=where)
    exact_dedup(rows, first).collect()
    for buckets in (4, 16):
        again = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=buckets, path=where)
        assert again.buckets == 8
        later = exact_dedup(rows.selectExpr("doc_id + 5000 AS doc_id", "text"), again).collect()
        assert not any(r.kept for r in later) and again.read().count() == 1000
        again.drop()
    assert DigestIndex(spark, first.name, buckets=3).buckets == 8
    first.drop()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "part-0.parquet").write_bytes(b"x")
    with pytest.raises(ValueError):
        DigestIndex(spark, f"t_{uuid.uuid4().hex}", path=str(tmp_path / "other"))


def test_a_batch_run_again_gets_the_same_answers(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (3, "c"), (9, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    once, twice = (sorted(map(tuple, exact_dedup(df, index).collect())) for _ in range(2))
    assert once == twice and index.read().count() == 3
    index.drop()


def test_batches_of_one_table_give_the_answers_of_one_batch(spark):
    rows = [(k, f"t{k % 7}  x") for k in range(40)] + [(None, "t3 x"), (None, "alone"), (None, None), (99, ""), (5, "t6 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 2, 3):
        index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
        got = sorted((tuple(r) for r in exact_dedup(df, index, batches=batches).collect()), key=str)
        want = [r if r[1] is not None else (*r[:3], True, r[4]) for r in brute(rows)]
        assert got == sorted(want, key=str)
        index.drop()
