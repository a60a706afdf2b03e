"""Files as rows: listings, stat rows, content hashes, media types and the base record of each file.

``listing`` walks a tree in tasks: the driver only opens folders from the top down until there are some hundred to deal
out. ``hashed`` reads files of a listing where the rows are, a chunk at a time, so a file of any size costs a task one
chunk of memory. ``contents`` and what works on it (``media_type``, ``base_records``) hold a file's content as one value:
they are for small files, from any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filelode.sources.hashes import Blake3
from filelode.sources.shared import checkpointed

CHUNK = 1 << 20
#: Folders that the driver opens at most to find some to deal out.
OPENED = 256
#: Bytes at the end of an archive in which its directory is looked for.
TAIL = 1 << 20

STAT = (
    "path string, name string, size long, modified double, created double, mode int, is_dir boolean, ordinal long, inode long, links int, accessed double"
)


class _Part(InputPartition):
    def __init__(self, number: int, folder: str, deep: bool):
        self.number, self.folder, self.deep = number, folder, deep


class _StatReader(DataSourceReader):
    """A partition is a folder: its own entries, or the whole tree below it."""

    def __init__(self, top: str, recursive: bool):
        self.top, self.recursive = top, recursive

    def partitions(self) -> list[InputPartition]:
        if not self.recursive:
            return [_Part(0, self.top, False)]
        opened, waiting = [], [self.top]
        while waiting and len(opened) < OPENED and len(waiting) < OPENED:
            folder = waiting.pop(0)
            opened.append(folder)
            try:
                with os.scandir(folder) as entries:
                    waiting += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
            except OSError:
                continue
        return [_Part(i, f, deep) for i, (f, deep) in enumerate([*((f, False) for f in opened), *((f, True) for f in waiting)])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ordinal, folders = partition.number << 33, [partition.folder]
        while folders:
            try:
                names = sorted(os.listdir(folder := folders.pop()))
            except OSError:
                continue
            below = []
            for name in names:
                path = os.path.join(folder, name)
                try:
                    s = os.lstat(path)
                    is_dir = stat.S_ISDIR(s.st_mode)
                    if not self.recursive and not os.path.isfile(path):
                        continue
                    yield path, name, s.st_size, s.st_mtime, s.st_ctime, stat.S_IMODE(s.st_mode), is_dir, ordinal, s.st_ino, s.st_nlink, s.st_atime
                except OSError:  # counted as a file that could not be read
                    is_dir = False
                    yield path, name, None, None, None, None, False, ordinal, None, None, None
                ordinal += 1
                if is_dir:
                    below.append(path)
            if partition.deep:
                folders += reversed(below)


class FileStat(DataSource):
    """``spark.read.format("file_stat").option("recursive", "true").load(dir)``: a stat row for each file under a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_stat"

    def schema(self) -> str:
        return STAT

    def reader(self, schema) -> DataSourceReader:
        return _StatReader(self.options["path"], str(self.options.get("recursive", "false")).lower() == "true")


#: Entries that a task of a round of ``tree`` lists before it hands back the folders that are left.
BUDGET = 50_000


def tree(spark: SparkSession, folder: str, budget: int = BUDGET) -> DataFrame:
    """A stat row for everything below a folder, with ``ordinal`` in the order of paths, however the tree is shaped.

    Folders are rows. In each round the open ones are dealt to all tasks; a task lists what is below its own, deepest first,
    until it has seen ``budget`` entries, and hands back the folders that it didn't get to. So a deep chain takes few rounds,
    and a wide tree is dealt anew after each. Names alone are listed then; the stat calls, which take the time, are made by all
    tasks over the sorted paths, so one folder of many files is dealt as well.
    """
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(paths: list[str], folders: list[bool], is_open: bool) -> pa.RecordBatch:
            columns = [pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array([is_open] * len(paths), pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["path", "is_dir", "open"])

        seen, left = 0, []
        for batch in batches:
            left += batch.column(0).to_pylist()
        while left and seen < budget:
            try:
                with os.scandir(left.pop()) as entries:
                    rows = [(e.path, e.is_dir(follow_symlinks=False)) for e in entries]
            except OSError:
                continue
            seen += len(rows)
            left += [path for path, is_dir in rows if is_dir]
            for k in range(0, len(rows), 10_000):
                part = rows[k : k + 10_000]
                yield told([path for path, _ in part], [is_dir for _, is_dir in part], False)
        yield told(left, [True] * len(left), True)

    frontier = spark.createDataFrame([(folder.rstrip("/") or "/",)], "path string")
    found = None
    while True:
        more = checkpointed(frontier.mapInArrow(listed, "path string, is_dir boolean, open boolean"))
        found = more if found is None else found.unionByName(more)
        frontier = more.where("open").select("path")
        waiting = frontier.count()
        if not waiting:
            break
        frontier = frontier.repartition(min(parts, waiting))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ordinal in zip(batch["path"], batch["ordinal"]):
                try:
                    s = os.lstat(path)
                    rows.append((path, os.path.basename(path), s.st_size, s.st_mtime, s.st_ctime, stat.S_IMODE(s.st_mode), stat.S_ISDIR(s.st_mode), ordinal, s.st_ino, s.st_nlink, s.st_atime))
                except OSError:  # counted as a file that could not be read
                    rows.append((path, os.path.basename(path), None, None, None, None, False, ordinal, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STAT.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    names = found.where("NOT open").select("path").repartitionByRange(parts, "path").sortWithinPartitions("path")
    return checkpointed(names.withColumn("ordinal", F.monotonically_increasing_id())).mapInPandas(measured, STAT)


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    spark.dataSource.register(FileStat)
    return spark.read.format("file_stat").option("recursive", str(recursive)).load(folder)


def contents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Paths, times, lengths and contents of small files, by Spark's own reader and so from any store.

    That reader leaves out empty files and those whose name starts with a dot or underscore; ``listing`` has them.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def hashed(files: DataFrame, functions: tuple[str, ...] = ("sha256", "blake2b")) -> DataFrame:
    """``files`` (``path``) with ``hashes``, a map, from one pass over each file, and ``error`` where it can't be read."""

    place = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, faults = [], []
            for path in batch.column(place).to_pylist():
                try:
                    states = {f: Blake3() if f == "blake3" else hashlib.new(f) for f in functions}
                    with open(path, "rb") as f:
                        while chunk := f.read(CHUNK):
                            for state in states.values():
                                state.update(chunk)
                    maps.append([(k, s.hexdigest()) for k, s in states.items()])
                    faults.append(None)
                except OSError as fault:
                    maps.append(None)
                    faults.append(str(fault))
            more = [pa.array(maps, pa.map_(pa.string(), pa.string())), pa.array(faults, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "hashes", "error"])

    schema = T.StructType([*files.schema, T.StructField("hashes", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])
    return files.mapInArrow(run, schema)


# First bytes of a format and its media type; offsets where they aren't at the start.
SIGNATURES = (
    ("25504446", 0, "application/pdf"),
    ("89504E470D0A1A0A", 0, "image/png"),
    ("FFD8FF", 0, "image/jpeg"),
    ("474946383761", 0, "image/gif"),
    ("474946383961", 0, "image/gif"),
    ("1F8B", 0, "application/gzip"),
    ("377ABCAF271C", 0, "application/x-7z-compressed"),
    ("526172211A07", 0, "application/vnd.rar"),
    ("664C6143", 0, "audio/flac"),
    ("494433", 0, "audio/mpeg"),
    ("4F676753", 0, "audio/ogg"),
    ("1A45DFA3", 0, "video/matroska"),
    ("66747970", 4, "video/mp4"),
    ("57454250", 8, "image/webp"),
    ("57415645", 8, "audio/wav"),
    ("4D5A", 0, "application/vnd.microsoft.portable-executable"),
    ("7F454C46", 0, "application/x-elf"),
    ("4344303031", 32769, "application/vnd.efi.iso"),
    ("504B0304", 0, "application/zip"),
    ("3C3F786D6C", 0, "application/xml"),
    ("7B5C727466", 0, "application/rtf"),
)
BY_EXTENSION = {
    ".iso": "application/vnd.efi.iso", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".json": "application/json",
    ".css": "text/css", ".js": "text/javascript", ".xml": "application/xml", ".svg": "image/svg+xml", ".py": "text/x-python",
}
OFFICE = {
    ".docx": ("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".xlsx": ("xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ".pptx": ("ppt/presentation.xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ".epub": ("mimetypeapplication/epub+zip", "application/epub+zip"),
}


def extension(name: Column) -> Column:
    """The last suffix in lower case; null for none, for a lone dot and for a name that only starts with one."""
    found = F.lower(F.regexp_extract(name, r"[^/.]+(\.[^./]+)\z", 1))
    return F.when(found != "", found)


def media_type(content: Column, name: Column) -> Column:
    """From the first bytes, office containers by a member's name in the archive, then from the extension.

    Members are looked for at an archive's beginning and in the directory at its end, byte by byte, nothing between.
    """
    ext, raw = extension(name), F.hex(F.substring(content, 1, 4))
    out = F.when(F.octet_length(content) == 0, "application/x-empty")
    ends = F.concat(F.substring(content, 1, 256), F.substring(content, -TAIL, TAIL))
    for e, (member, kind) in OFFICE.items():
        out = out.when((raw == "504B0304") & (ext == e) & F.contains(ends, F.lit(member.encode())), kind)
    for magic, at, kind in SIGNATURES:
        out = out.when(F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic, kind)
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    text = ~F.substring(content, 1, 512).cast("string").rlike(r"[\x00-\x08\x0E-\x1F]")
    return out.otherwise(F.coalesce(F.try_element_at(table, ext), F.when(text, "text/plain"), F.lit("application/octet-stream")))


def with_local_attributes(results: DataFrame, stats: DataFrame) -> DataFrame:
    """``results`` (``path``) with what the file system says of each file (a row of ``listing``) in ``local_attributes``."""
    about = F.struct(F.col("path").alias("file_path"), "mode", "inode", "links", "modified", "created", "accessed")
    return results.join(stats.select("path", about.alias("local_attributes")), "path", "left")


def scan(found: DataFrame, limit: int | None = None) -> DataFrame:
    """The base record of each row of ``contents``, and ``error``, a text, where there is none; a scan never stops at a file.

    More files than ``limit`` are an error before anything is read.
    """
    if limit is not None and (n := found.select("path").limit(limit + 1).count()) > limit:
        raise ValueError(f"more than {limit} files ({n} counted)")
    records = base_records(found)
    return records.withColumn("error", F.when(F.col("hash").isNull(), F.concat(F.lit("could not read "), F.col("path"))))


def base_records(found: DataFrame) -> DataFrame:
    """The base record of each row of ``contents``: hash, name, extension, size, media type and its head."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = media_type(F.col("content"), name)
    return found.select(
        "path", F.sha2("content", 256).alias("hash"), F.substring(name, 1, 255).alias("name"), extension(name).alias("extension"),
        F.col("length").alias("size"), kind.alias("media_type"), F.split_part(kind, F.lit("/"), F.lit(1)).alias("media_type_prefix"), F.col("modificationTime").alias("date_modified"),
    )
