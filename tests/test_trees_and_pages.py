"""Listings of odd trees, text by page, quartiles by brackets."""

import io
import os
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from filelode.operators import aggregates as A
from filelode.sources import documents, files


def walked(top):
    return sorted(os.path.join(d, n) for d, folders, names in os.walk(top) for n in [*folders, *names])


@pytest.mark.parametrize("budget", [5, 50_000])
def test_tree_of_any_shape(spark, tmp_path, budget):
    rnd = random.Random(1)
    folders = [str(tmp_path)]
    for n in range(30):
        folders.append(f"{rnd.choice(folders)}/d{n}")
        os.makedirs(folders[-1])
    for n in range(150):
        with open(f"{rnd.choice(folders)}/.f{n}", "w") as f:
            f.write("x" * n)
    os.symlink("/nowhere", f"{tmp_path}/gone")
    os.symlink(str(tmp_path), f"{tmp_path}/loop")
    rows = files.tree(spark, str(tmp_path), budget).orderBy("ordinal").collect()
    assert [r.path for r in rows] == walked(str(tmp_path))
    assert {r.name: r.size for r in rows if r.name.startswith(".f")} == {f".f{n}": n for n in range(150)}
    assert {r.path for r in rows if r.is_dir} == set(folders[1:])


def test_a_long_chain_and_a_wide_folder(spark, tmp_path):
    chain = tmp_path / "c"
    at, fd = 0, os.open(str(tmp_path), os.O_RDONLY)
    for at in range(300):  # by handles, as the path grows long
        os.mkdir("c", dir_fd=fd)
        then = os.open("c", os.O_RDONLY, dir_fd=fd)
        os.close(fd)
        fd = then
    os.close(fd)
    os.mkdir(tmp_path / "wide")
    for n in range(5000):
        (tmp_path / "wide" / str(n)).touch()
    found = files.tree(spark, str(tmp_path))
    assert found.count() == 300 + 1 + 5000
    assert found.rdd.getNumPartitions() >= 4 and min(len(p) for p in found.select("path").rdd.glom().collect()) > 100
    assert str(chain) in {r.path for r in found.where("name = 'c'").collect()}


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_text_by_page(spark, monkeypatch):
    p = lambda *runs: "<w:p>" + "".join(runs) + "</w:p>"
    t, tab, line, page = "<w:r><w:t>{}</w:t></w:r>".format, "<w:r><w:tab/></w:r>", "<w:r><w:br/></w:r>", '<w:r><w:br w:type="page"/></w:r>'
    cases = {
        "/a.docx": (docx(p(t("One"), tab, t("two")) + p(t("Three"), line, t("four")) + p(t("Page one ends"), page, t("Page two")) + p() + p(t("last"))), ["One\ttwo\nThree\nfour\nPage one ends", "Page two\n\nlast"]),
        "/b.docx": (docx(p(page) + p(page, t("x"))), ["", "", "x"]),
        "/c.docx": (docx(""), []),
        "/d.docx": (docx(p(t("end"), page)), ["end"]),
        "/e.docx": (docx(p(t("word " * 3000)) + p(t("after"))), ["word " * 3000 + "\nafter"]),
    }
    found = spark.createDataFrame([(k, c) for k, (c, _) in cases.items()] + [("/bad.docx", b"no"), ("/none.docx", None), ("/x.txt", b"")], "path string, content binary")
    pieces = documents.text_pieces(found)
    got = {}
    for r in documents.text_by_page(pieces).orderBy("path", "page").collect():
        got.setdefault(r.path, []).append(r.text)
    assert {k: got.get(k, []) for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert {r.path for r in pieces.where("error IS NOT NULL").collect()} == {"/bad.docx", "/none.docx"}


def test_quartiles_in_one_pass_after_the_sketch(spark, monkeypatch):
    rnd = random.Random(7)
    for values in ([rnd.randrange(1, 10**12) for _ in range(3000)], [rnd.choice([5, 6, 10**9]) for _ in range(3000)], list(range(1, 400))):
        rows = spark.createDataFrame([(v,) for v in values], "size long")
        q = statistics.quantiles(values, n=4)
        n, lo, hi = len(values), min(values), max(values)
        near = rows.agg(F.percentile_approx("size", list(A.BRACKETS), A.SKETCH)).first()[0]
        for limit in (100_000, 100, 0):  # all values; brackets and single values; brackets and parts
            monkeypatch.setattr(A, "ONE_BY_ONE", limit)
            assert A._quartiles(rows, n, lo, hi, near) == (q[0], q[2])
            assert A._quartiles(rows, n, lo, hi, [lo, lo, hi, hi]) == (q[0], q[2])  # a sketch that is far off
