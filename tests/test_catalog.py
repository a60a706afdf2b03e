from filelode import config
from filelode.operators import catalog


def test_push_reports_failing_batches(spark):
    def send(batch):
        if any(r["id"] == 7 for r in batch):
            raise ValueError("no sevens")

    rows = catalog.push(spark.range(0, 25, 1, 2), send, per_batch=5).collect()
    assert sum(r.records for r in rows) == 25 and [r.error for r in rows if r.error] == ["no sevens"]


def test_sync_and_delete(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "collection_id int, hash string")
    wanted = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c")], "collection_id int, hash string")
    after, counts = catalog.sync(members, wanted)
    assert sorted(map(tuple, after.collect())) == [(1, "b"), (1, "c"), (2, "a")]
    assert tuple(counts.first()) == (1, 1, 1, 1)
    assert [r.collection_id for r in catalog.delete_collections(members, members, [1])[1].collect()] == [2]


def test_lineage():
    merged = {"type": "merged", "sources": [{"type": "local", "path": "/a"}, {"type": "merged", "sources": [{"type": "local", "path": "/b"}, {"type": "local", "path": "/a"}]}]}
    assert catalog.lineage(merged) == ["/a", "/b"] and catalog.lineage({"type": "remote"}) == []


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "p.toml").write_text("[scan]\nlimit = 5\nkinds = ['a']\n")
    (tmp_path / "u.toml").write_text("[scan]\nlimit = 9\nkinds = ['b', 'c']\ndeep = true\n")
    held = config.load(tmp_path / "p.toml", tmp_path / "u.toml", {"theme": "x"})
    assert held == {"theme": "x", "scan": {"limit": 5, "kinds": ["a"], "deep": True}}
    assert config.setting("scan.limit", settings=held) == 5 and config.setting("scan.none", settings=held, default=1) == 1
    monkeypatch.setenv("FILELODE_SCAN_LIMIT", "7")
    assert config.setting("scan.limit", settings=held) == "7" and config.setting("scan.limit", 3, held) == 3
    assert config.truthy(" Yes ") and not config.truthy(None)
