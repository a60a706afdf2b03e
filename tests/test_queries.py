"""Every registered query that has SQL gives the same rows as DuckDB, on the smallest tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    found = oracle.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted("|".join(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["media_type", "files", "total_size", "percentage"]


def test_only_the_entry_guards_the_corpus_operators():
    top = Path(__spark_entry__.__file__).parent
    for path in (top / "filelode").rglob("*.py"):
        if "llm" not in path.parts:
            assert "filelode.llm" not in path.read_text(), path


def test_f16_gathers_only_what_is_outside_the_vocabulary(spark, tmp_path):
    rows = [(1, k, "click") for k in range(500)] + [(1, 600, "buy"), (1, 550, "cart"), (1, 601, None), (2, 1, "view")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = __spark_entry__.queries()["f16_vocabulary_linter"](spark, str(tmp_path))
    assert {r.user_id: r.missing for r in found.collect()} == {1: ["cart", "buy"], 2: []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(CASE WHEN" in plan or "collect_list(if" in plan


def test_s1_takes_the_remainder_of_products_that_are_no_long(spark, tmp_path):
    rows = [(k, k % 7) for k in (0, 5, 479_999, 900_000, 9_000_000, 3 * 10**9, 10**15)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.o_orderkey: r.size for r in __spark_entry__.queries()["s1_human_size"](spark, str(tmp_path)).collect()}
    assert found == {k: (k + 3) * (k + 1) * (1 + c % 5 * 10000003) % 900719925474099 for k, c in rows}


def test_a7_media_types_by_size_beyond_a_long(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(8 * k + i, 1, k % 8, 7, 1.0, 1.05e10, "AN"[k // 8], "O", datetime.datetime(2024, 1, 1)) for k in range(16) for i in range(8)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = __spark_entry__.queries()["a7_media_types_by_size"](spark, str(tmp_path)).collect()
    each = 8 * 1_050_000_000_000 * 10**6
    assert [int(r.total_size) for r in found] == [each] * 14 + [2 * each] and found[-1].media_type == "Other"
    assert each < 2**63 < 2 * each


def test_a12_takes_the_first_row_of_equal_track_numbers(spark, tmp_path):
    rows = [(1, 2, 7, "R"), (1, 2, 7, "A"), (2, 1, 5, "A"), (2, 1, 5, "R"), (3, 1, 3, None), (3, 2, 3, "N"), (4, 2, 9, "N"), (4, 1, 9, "R"), (4, 1, 9, "A"), (5, 6, 1, "A")]
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string"
    spark.createDataFrame(rows, line).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, n, p, "B") for k, n, p, f in rows if f], line).coalesce(1).write.parquet(f"{tmp_path}/later")
    later = next((tmp_path / "later").glob("*.parquet"))
    later.rename(tmp_path / "lineitem.parquet" / f"z{later.name}")  # the table's last file
    found = {r.file: r.general_format for r in __spark_entry__.queries()["a12_tracks"](spark, str(tmp_path)).collect()}
    assert found == {1: "R", 2: "A", 3: "N", 4: "R", 5: None}
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert {r[0]: r[1] for r in con.execute(__spark_entry__.oracle_sql()["a12_tracks"]).fetchall()} == found


def test_r8_does_not_find_tags_of_another_kind_in_tables_of_over_a_million_parts(spark, tmp_path):
    rows = [(k, "n", "b", size) for k, size in ((7, 1), (1_000_007, 3), (8, 1), (1_000_008, 2), (9, 2), (1_000_009, 1))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = __spark_entry__.queries()["r8_delete_tags"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted((r.hash, r.tag_id, r.status) for r in found) == sorted(con.execute(__spark_entry__.oracle_sql()["r8_delete_tags"]).fetchall())
