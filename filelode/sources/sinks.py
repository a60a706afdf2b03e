"""Ways out: CSV, JSON with its summary, SQLite, HTML reports."""

from __future__ import annotations

import html
import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.operators import aggregates as A
from filelode.operators.records import dump, export_rows


def to_csv(flat: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header each; nothing for an empty table."""
    if not flat.isEmpty():
        flat.write.mode("overwrite").option("header", True).csv(path)


def to_json(files: DataFrame, path: str, exclude: tuple[str, ...] = (), aliases: dict[str, str] | None = None, nulls: bool = False) -> None:
    """A folder of JSON lines, one a file, and beside it the summary of the collection.

    Null fields are left out unless ``nulls``; ``exclude`` and ``aliases`` are as in ``records.dump``.
    """
    files.select(dump(files, files.columns, exclude=exclude, aliases=aliases, nulls=nulls).alias("value")).write.mode("overwrite").text(f"{path}/results")
    summary = A.overall(files).select(F.struct("*").alias("overall"))
    for key in ("media_type", "source"):
        rows = A.share_by(files, key).agg(F.collect_list(F.struct(key, "files", "total_size", "percentage")).alias(f"by_{key}"))  # a row a type
        summary = summary.crossJoin(F.broadcast(rows))
    summary.write.mode("overwrite").json(f"{path}/scan_metadata")


def export_cache(cache: DataFrame, path: str, with_records: bool = True, compressed: bool = True) -> None:
    """A cache as a folder of JSON lines."""
    export_rows(cache, with_records).write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def to_sqlite(flat: DataFrame, folder: str, table: str) -> int:
    """A folder of SQLite databases, one for each part of the rows, each with ``table`` of texts. Returns the rows written.

    Every task fills a database of its own on its disk and moves it into ``folder``, which all must reach by that path, so
    no row passes the driver. Writing again adds parts; a task that runs again replaces its own.
    """
    names = [c.replace("-", "_") for c in flat.columns]
    quoted = ", ".join(f'"{n}"' for n in names)
    run = uuid.uuid4().hex

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows, place = 0, None
        with tempfile.TemporaryDirectory() as own:
            place = os.path.join(own, "part.db")
            with sqlite3.connect(place) as connection:
                connection.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{n}{chr(34)} TEXT" for n in names)})')
                for frame in frames:
                    frame = frame.astype(object).where(frame.notna(), None)
                    connection.executemany(f'INSERT INTO "{table}" ({quoted}) VALUES ({", ".join("?" * len(names))})', frame.itertuples(index=False, name=None))
                    rows += len(frame)
            connection.close()
            if rows:
                os.makedirs(folder, exist_ok=True)
                name = f"part-{TaskContext.get().partitionId():05d}-{run}.db"
                shutil.copyfile(place, os.path.join(folder, f".{name}"))
                os.replace(os.path.join(folder, f".{name}"), os.path.join(folder, name))
        yield pd.DataFrame({"rows": [rows]})

    texts = flat.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(flat.columns)))
    return texts.mapInPandas(written, "rows long").agg(F.sum("rows")).first()[0] or 0


#: Panels of a report, by name; each makes a table of bounded size.
PANELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Overview": A.overall,
    "Media types by size": lambda files: A.panel_by(files, "media_type", "total_size"),
    "Media types by count": lambda files: A.panel_by(files, "media_type", "count"),
    "Extensions by size": lambda files: A.panel_by(files, "extension", "total_size"),
    "Extensions by count": lambda files: A.panel_by(files, "extension", "count"),
    "Largest files": A.largest_files,
    "Most recent file": A.most_recent,
    "Sizes": lambda files: A.size_histogram(files).orderBy("bin"),
}
PAGE = "<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{body}</body></html>"


def template(name: str, folders: Sequence[str] = (), explicit: str | None = None) -> str:
    """The text of a page template: an explicit file, else ``name`` in the first of ``folders`` that has it, else ``PAGE``.

    It has ``{title}`` and ``{body}``.
    """
    for place in [explicit] if explicit else [os.path.join(f, f"{name}.html") for f in folders]:
        if explicit or os.path.isfile(place):
            with open(place, encoding="utf-8") as f:
                return f.read()
    return PAGE


def _filled(page: str, title: str, body: str) -> str:
    return page.replace("{title}", html.escape(title)).replace("{body}", body)


def html_report(files: DataFrame, title: str = "Collection", panels: Mapping[str, Callable[[DataFrame], DataFrame]] = PANELS, page: str = PAGE) -> str:
    """A page with the panels of a collection; only summaries of bounded size reach the driver."""

    def rows(df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        return f"<table><tr>{head}</tr>{body}</table>"

    return _filled(page, title, "".join(f"<h2>{html.escape(name)}</h2>{rows(panel(files))}" for name, panel in panels.items()))


def file_report(record: str, title: str | None = None, page: str = PAGE) -> str:
    """A page for one file record (JSON): its own fields, then a section for each annotation."""
    held = json.loads(record)

    def table(fields: Mapping[str, object]) -> str:
        return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(v if isinstance(v, str) else json.dumps(v))}</td></tr>" for k, v in fields.items()) + "</table>"

    notes = held.get("annotations") or {}
    base = (notes.get("file/base") or {}).get("record") or {}
    own = {k: v for k, v in held.items() if k != "annotations"} | {k: v for k, v in base.items() if k != "all_hashes"}
    sections = "".join(
        f"<h2>{html.escape(schema)}</h2>" + "".join(table(n.get("record") or {}) for n in (found if isinstance(found, list) else [found]))
        for schema, found in notes.items()
        if schema != "file/base" and found
    )
    return _filled(page, title or str(base.get("name") or held.get("hash")), table(own) + sections)
