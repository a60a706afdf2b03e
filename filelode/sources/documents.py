"""Metadata of office files and e-books: zip archives of XML, read in tasks with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

FIELDS = (
    "path string, kind string, title string, author string, subject string, keywords array<string>, language string, publisher string, identifier string, "
    "created string, modified string, sheets array<struct<name: string, rows: int, cols: int>>, slides int, has_macros boolean, is_protected boolean, error string, "
    "active_sheet string, headers array<array<string>>"
)
#: What a contributor is to a book, by the relator codes of the package format: its producer, which is a program as a rule.
PRODUCER = "bkp"


def book_number(text: str) -> str | None:
    """The ISBN of an identifier: ten or thirteen digits, the tenth may be X, perhaps behind a name and with hyphens."""
    tail = text.rpartition(":")[2].upper().removeprefix("ISBN").replace("-", "").strip()
    digits = tail[:-1] if tail.endswith("X") and len(tail) == 10 else tail
    return tail if digits.isdigit() and digits.isascii() and len(tail) in (10, 13) else None


def _texts(root: ElementTree.Element) -> dict[str, list[str]]:
    """Texts of all elements by local name."""
    out: dict[str, list[str]] = {}
    for e in root.iter():
        if e.text and e.text.strip():
            out.setdefault(e.tag.rpartition("}")[2], []).append(e.text.strip())
    return out


def _cell(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref.rpartition(":")[2])
    if m is None:
        return 0, 0
    cols = 0
    for c in m[1]:
        cols = cols * 26 + ord(c) - 64
    return int(m[2]), cols


def _parse(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError):
        return None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _header(sheet: ElementTree.Element, shared: list[str]) -> list[str]:
    """Texts of the cells of a sheet's first row; of a row numbered otherwise none."""
    row = next((e for e in sheet.iter() if _local(e) == "row"), None)
    if row is None or row.get("r", "1") != "1":
        return []
    out = []
    for cell in row:
        value = "".join(t.text or "" for t in cell.iter() if _local(t) in ("v", "t"))
        if cell.get("t") == "s" and value.isdigit() and int(value) < len(shared):
            value = shared[int(value)]
        out.append(value)
    return out


def _office(archive: zipfile.ZipFile, kind: str) -> dict:
    out: dict = {"kind": kind}
    core = _parse(archive, "docProps/core.xml")
    if core is not None:
        t = _texts(core)
        first = lambda k: (t.get(k) or [None])[0]
        out |= {"title": first("title"), "author": first("creator"), "subject": first("subject"), "language": first("language"), "created": first("created"), "modified": first("modified")}
        out["keywords"] = [k.strip() for k in re.split("[;,]", first("keywords") or "") if k.strip()]
    names = set(archive.namelist())
    out["has_macros"] = any(n.endswith("vbaProject.bin") for n in names)
    if kind == "xlsx":
        book, links = _parse(archive, "xl/workbook.xml"), _parse(archive, "xl/_rels/workbook.xml.rels")
        target = {e.get("Id"): e.get("Target") for e in links} if links is not None else {}
        strings = _parse(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in e.iter() if _local(t) == "t") for e in strings if _local(e) == "si"] if strings is not None else []
        view = next((e for e in book.iter() if _local(e) == "workbookView"), None) if book is not None else None
        sheets, headers = [], []
        for e in book.iter() if book is not None else ():
            if e.tag.rpartition("}")[2] == "sheet":
                rid = next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
                sheet = _parse(archive, "xl/" + (target.get(rid) or "").lstrip("/").removeprefix("xl/"))
                ref = next((d.get("ref") for d in sheet.iter() if d.tag.endswith("}dimension")), None) if sheet is not None else None
                rows, cols = _cell(ref or "")
                sheets.append({"name": e.get("name"), "rows": rows, "cols": cols})
                headers.append(_header(sheet, shared) if sheet is not None else [])
        active = int(view.get("activeTab", "0")) if view is not None else 0
        out |= {"sheets": sheets, "headers": headers, "active_sheet": sheets[active]["name"] if active < len(sheets) else None}
    if kind == "pptx":
        show = _parse(archive, "ppt/presentation.xml")
        out["slides"] = None if show is None else sum(e.tag.endswith("}sldId") for e in show.iter())
    return out


def _epub(archive: zipfile.ZipFile) -> dict:
    container = _parse(archive, "META-INF/container.xml")
    place = next((e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile")), None) if container is not None else None
    package = _parse(archive, place) if place else None
    if package is None:
        return {"kind": "epub", "error": "no package document"}
    t = _texts(package)
    first = lambda k: (t.get(k) or [None])[0]
    isbn = next(filter(None, map(book_number, t.get("identifier", []))), None)
    makers = [e.text.strip() for e in package.iter() if _local(e) == "contributor" and e.text and PRODUCER in (v for k, v in e.attrib.items() if k.endswith("role"))]
    return {
        "kind": "epub", "title": first("title"), "author": "; ".join(t.get("creator", [])) or None, "language": first("language"), "publisher": first("publisher"),
        "subject": first("subject"), "identifier": isbn or first("identifier"), "created": first("date"), "keywords": makers,
    }


def document_metadata(found: DataFrame) -> DataFrame:
    """A row of metadata for each ``(path, content)`` by its extension; what can't be read says so in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.sub(r"<[^ ]*?struct<[^>]*>>|<[^>]*>", "", FIELDS).split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = path.lower().rpartition(".")[2]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        row = _epub(archive) if kind == "epub" else _office(archive, kind)
                except zipfile.BadZipFile:
                    row = {"kind": kind, "is_protected": True, "error": "not an archive"}
                rows.append({"path": path} | row)
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    some = found.where("lower(path) RLIKE '[.](docx|xlsx|pptx|epub)$'").select("path", "content")
    return some.mapInPandas(run, FIELDS)


#: Letters of a paragraph in one row at most, about.
PIECE = 1 << 16


@udtf(returnType="page int, piece int, starts boolean, text string, error string")
class WordText:
    """The text of a word-processor document as rows, as it is read: its pieces in order, each with the page that it is on.

    A page ends at an explicit page break. A piece is a paragraph, or a part of one that a page break or its length cuts;
    ``starts`` says whether a paragraph begins with it. The document is never held as one text. What can't be read ends
    with a row whose ``error`` says why.
    """

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as source:
                yield from self._pieces(source)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as fault:
            yield None, None, None, None, str(fault) or "not a document"

    def _pieces(self, source: io.BufferedIOBase) -> Iterator[tuple]:
        page, piece, starts, begun = 1, 0, False, False
        held: list[str] = []
        for event, e in ElementTree.iterparse(source, ("start", "end")):
            kind = _local(e)
            broken = event == "end" and kind == "br" and any(k.endswith("}type") and v == "page" for k, v in e.attrib.items())
            new = event == "start" and kind == "p"
            if (new or broken) and (held or starts or (broken and not begun)):
                yield page, piece, starts, "".join(held), None
                piece, starts, begun = piece + 1, False, True
                held.clear()
            if new:
                starts = True
            elif broken:
                page, begun = page + 1, False
            elif event == "end" and kind in ("t", "tab", "br"):
                held.append((e.text or "") if kind == "t" else "\t" if kind == "tab" else "\n")
                if sum(map(len, held[-2:])) > PIECE or len(held) > 1000:
                    yield page, piece, starts, "".join(held), None
                    piece, starts, begun = piece + 1, False, True
                    held.clear()
            if event == "end" and kind == "p":
                e.clear()
        if held or starts:
            yield page, piece, starts, "".join(held), None


def text_pieces(found: DataFrame) -> DataFrame:
    """``(path, page, piece, starts, text, error)`` of each ``(path, content)`` that is a word-processor document by its name."""
    some = found.where("lower(path) LIKE '%.docx'").select("path", "content")
    return some.lateralJoin(WordText(F.col("content").outer())).drop("content")


def text_by_page(pieces: DataFrame) -> DataFrame:
    """``(path, page, text)``: each page's pieces together, a line break where a paragraph starts, white space around it dropped."""
    line = F.struct("piece", F.concat(F.when(F.col("starts"), "\n").otherwise(""), "text").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "")
    return pieces.where("error IS NULL").groupBy("path", "page").agg(F.regexp_replace(joined, r"^\s+|\s+\z", "").alias("text"))
