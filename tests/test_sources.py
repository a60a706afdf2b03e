import hashlib
import io
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from filelode.operators.pipeline import Pipeline, Step
from filelode.sources import documents, files, sinks
from filelode.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a copy.TXT").write_text("hello")
    os.chmod(tmp_path / "p.pdf", 0o400)
    return tmp_path


def test_listing_and_stat(spark, folder):
    assert {r.name for r in files.listing(spark, str(folder)).collect()} == {"a.txt", "empty", ".hidden", "p.pdf"}
    rows = {r.name: r for r in files.listing(spark, str(folder), recursive=True).collect()}
    assert rows["sub"].is_dir and rows["a copy.TXT"].size == 5 and rows["p.pdf"].mode == 0o400


def test_base_records_and_hashes(spark, folder):
    found = files.contents(spark, str(folder), recursive=True)
    rows = {r.name: r for r in files.base_records(found).collect()}
    assert rows["a.txt"].hash == hashlib.sha256(b"hello").hexdigest() == rows["a copy.TXT"].hash
    assert rows["p.pdf"].media_type == "application/pdf" and rows["a copy.TXT"].extension == ".txt" and rows["a copy.TXT"].media_type == "text/plain"
    paths = spark.createDataFrame([(str(folder / "a.txt"),), (str(folder / "gone"),)], "path string")
    got = {os.path.basename(r.path): r for r in files.hashed(paths).collect()}
    assert got["a.txt"].hashes["sha256"] == rows["a.txt"].hash and got["gone"].hashes is None and got["gone"].error


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_and_ebook_metadata(spark):
    core = '<c xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator><keywords>x; y,</keywords></c>'
    xlsx = archive(
        {
            "docProps/core.xml": core,
            "xl/workbook.xml": '<w xmlns:r="r"><sheets xmlns="m"><sheet name="S" r:id="r1"/></sheets></w>',
            "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/sheet1.xml"/></R>',
            "xl/worksheets/sheet1.xml": '<w xmlns="m"><dimension ref="A1:C7"/></w>',
            "xl/vbaProject.bin": "",
        }
    )
    pptx = archive({"ppt/presentation.xml": '<p xmlns="m"><sldIdLst><sldId/><sldId/></sldIdLst></p>'})
    epub = archive(
        {
            "META-INF/container.xml": '<c xmlns="m"><rootfile full-path="o.opf"/></c>',
            "o.opf": '<p xmlns:dc="d" xmlns:opf="o"><dc:title>B</dc:title><dc:identifier>urn:isbn:9780306406157</dc:identifier><dc:contributor opf:role="bkp">calibre (7)</dc:contributor><dc:contributor opf:role="edt">Ann Editor</dc:contributor></p>',
        }
    )
    rows = [("/a.xlsx", xlsx), ("/b.pptx", pptx), ("/c.epub", epub), ("/d.docx", b"locked"), ("/e.txt", b"")]
    got = {r.path: r for r in documents.document_metadata(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {"/a.xlsx", "/b.pptx", "/c.epub", "/d.docx"}
    a = got["/a.xlsx"]
    assert (a.title, a.author, a.keywords, a.has_macros) == ("T", "A", ["x", "y"], True) and tuple(a.sheets[0]) == ("S", 7, 3)
    assert got["/b.pptx"].slides == 2 and got["/c.epub"].identifier == "9780306406157" and got["/d.docx"].is_protected


def test_headers_and_active_sheet(spark):
    sheet = '<w xmlns="m"><dimension ref="A1:B3"/><sheetData><row r="1"><c t="s"><v>1</v></c><c t="inlineStr"><is><t>two</t></is></c><c><v>7</v></c></row></sheetData></w>'
    book = '<w xmlns="m" xmlns:r="r"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="S" r:id="r1"/><sheet name="T" r:id="r2"/></sheets></w>'
    links = '<R><x Id="r1" Target="worksheets/sheet1.xml"/><x Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>'
    xlsx = archive({
        "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": sheet.replace('r="1"', 'r="2"'),
        "xl/sharedStrings.xml": '<s xmlns="m"><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></s>',
    })
    row = documents.document_metadata(spark.createDataFrame([("/a.xlsx", xlsx)], "path string, content binary")).first()
    assert row.active_sheet == "T" and row.headers == [["one", "two", "7"], []] and tuple(row.sheets[1]) == ("T", 3, 2)
    found = spark.createDataFrame([("/a.docx", archive({"word/document.xml": "x" * 3_000_000})), ("/b.docx", archive({"other": ""})), ("/c.epub", archive({"mimetype": "application/epub+zip"}))], "path string, content binary")
    kinds = {r.path: r.k for r in found.select("path", files.media_type(F.col("content"), F.col("path")).alias("k")).collect()}
    assert kinds["/a.docx"].endswith("document") and kinds["/b.docx"] == "application/zip" and kinds["/c.epub"] == "application/epub+zip"


def test_a_deep_and_wide_tree_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "OPENED", 8)
    for i in range(20):
        (tmp_path / f"d{i}" / "x" / "y").mkdir(parents=True)
        (tmp_path / f"d{i}" / "x" / "y" / "f").write_text("1")
        (tmp_path / f"d{i}" / f"g{i}").write_text("22")
    rows = files.listing(spark, str(tmp_path), recursive=True).collect()
    assert sum(not r.is_dir for r in rows) == 40 and sum(r.is_dir for r in rows) == 60
    assert len({r.ordinal for r in rows}) == len(rows) == len({r.path for r in rows})
    assert len(files._StatReader(str(tmp_path), True).partitions()) >= 20
    some = files.with_local_attributes(spark.createDataFrame([(str(tmp_path / "d1" / "g1"),), ("/gone",)], "path string"), files.listing(spark, str(tmp_path / "d1")))
    got = {os.path.basename(r.path): r.local_attributes for r in some.collect()}
    assert got["g1"].links == 1 and got["g1"].inode and got["gone"] is None
    hashes = files.hashed(spark.createDataFrame([(str(tmp_path / "d1" / "g1"),)], "path string"), ("sha256", "blake3")).first().hashes
    assert hashes["sha256"] == hashlib.sha256(b"22").hexdigest() and len(hashes["blake3"]) == 64


def test_scan_limit_and_errors(spark, folder):
    found = files.contents(spark, str(folder), recursive=True)
    assert {r.error for r in files.scan(found, limit=3).collect()} == {None}
    with pytest.raises(ValueError):
        files.scan(found, limit=2)


def test_pipeline_steps(spark):
    df = spark.createDataFrame([("h1", "text/a", "x"), ("h2", "img/b", None)], "hash string, media_type string, body string")
    steps = Pipeline((Step("base", "file/base", lambda d: F.to_json(F.struct("media_type"))),))
    steps = steps.upsert(Step("text", "open/generic", lambda d: F.to_json(F.struct("body")), lambda d: F.col("media_type").startswith("text")))
    rows = {(r.hash, r.schema): (r.record, r.error) for r in steps.run(df).collect()}
    assert rows["h1", "open/generic"] == ('{"body":"x"}', None) and rows["h2", "open/generic"][1].startswith("Skipped")
    assert {r.schema for r in steps.activate("text", False).run(df).collect()} == {"file/base"}
    for change in (lambda: steps.remove(0), lambda: steps.activate(0, False)):
        with pytest.raises(ValueError):
            change()
    loud = steps.upsert(Step("text", "open/generic", lambda d: F.lit("r"), lambda d: F.lit(False), silent=False))
    with pytest.raises(Exception, match="dependency not met"):
        loud.run(df).collect()


def test_sinks(spark, tmp_path):
    rows = [(i, f"f{i}", "h", 10 * i, "a/b", "disk", None, ".x") for i in range(5)]
    df = spark.createDataFrame(rows, "ordinal long, name string, hash string, size long, media_type string, source string, date_modified timestamp, extension string")
    sinks.to_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    sinks.to_csv(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    sinks.to_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/scan_metadata")).first().overall.total_files == 5
    flat = df.select("name", F.col("size").alias("file-size"))
    assert [sinks.to_sqlite(flat, str(tmp_path / "d.db"), "t") for _ in range(2)] == [5, 5]
    page = sinks.html_report(df, "A & B")
    assert "A &amp; B" in page and "f4" in page
    parts = [p for p in (tmp_path / "d.db").iterdir()]
    rows = [r for p in parts for r in sqlite3.connect(p).execute("SELECT name, file_size FROM t")]
    assert sorted(rows) == sorted([(f"f{i}", str(10 * i)) for i in range(5)] * 2)
    sinks.to_json(df, str(tmp_path / "less"), exclude=("hash",), aliases={"size": "bytes"}, nulls=True)
    kept = spark.read.json(str(tmp_path / "less/results"))
    assert "bytes" in kept.columns and "hash" not in kept.columns and "date_modified" in kept.columns
    (tmp_path / "own.html").write_text("<b>{title}</b>{body}")
    own = sinks.template("own", [str(tmp_path / "none"), str(tmp_path)])
    assert sinks.html_report(df, "T", {"Only": lambda d: d.select("name").limit(1)}, own).startswith("<b>T</b><h2>Only</h2>") and sinks.template("none") == sinks.PAGE
    record = '{"hash":"h","annotations":{"file/base":{"record":{"name":"n<","size":1}},"open/generic":[{"record":{"data":{"k":1}}}]}}'
    assert "n&lt;" in sinks.file_report(record) and "open/generic" in sinks.file_report(record)


def test_streaming_ingest_drops_repeats(spark, folder, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(x)) for x in ("out", "state"))
    (folder / "b.txt").write_text("hello")
    query = ingest.keep(ingest.arriving(spark, str(folder)), out, state)
    query.awaitTermination(60)
    assert sorted(r.size for r in spark.read.parquet(out).collect()) == [5, 9]  # the reader leaves out empty and hidden files
