"""Annotations of file records in a long table (``hash``, ``schema``, ``source_id``, ``version``, ``variant``, ``record``)
and what is done with them: lookup, upsert, flattening, privacy, oversized records, caches and collections."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelode.functions.scalars import json_size
from filelode.operators import chunking
from filelode.operators.filters import hash_faults

#: Bytes of a record, and where oversized records of a schema are cut: list field, fields of the first part.
MOST_BYTES = 1 << 20
SHARDED = {
    "document-extraction": ("blocks", ()),
    "object-detection": ("objects", ()),
    "entity-extraction": ("entities", ()),
    "classification": ("labels", ()),
    "audio-transcription": ("segments", ("text",)),
    "regression": ("points", ()),
    "llm-output": ("response_data", ("prompt", "generation_params")),
}
TEXT_RESERVE = 4096


def annotations_of(annotations: DataFrame, schema: str, source_id: str | None = None) -> DataFrame:
    found = annotations.where(F.col("schema") == schema)
    return found if source_id is None else found.where(F.col("source_id") == source_id)


def upsert_annotations(old: DataFrame, new: DataFrame, core: list[str], overwrite: bool = True) -> DataFrame:
    """One annotation per file and core schema, else per file, schema, source id, version and variant; the newest stays.

    Without ``overwrite`` the older stays and ``conflict`` marks the newer ones that lost.
    """
    keys = ["hash", "schema", "k_source", "k_version", "k_variant"]
    is_core = F.col("schema").isin(core)
    part = lambda c: F.when(~is_core, F.col(c)).alias(f"k_{c.split('_')[0]}")
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    keyed = both.select("*", part("source_id"), part("version"), part("variant"))
    payload = F.struct("source_id", "version", "variant", "record", "age")
    pick = F.max_by(payload, "age") if overwrite else F.min_by(payload, "age")
    by = keyed.groupBy(*keys).agg(pick.alias("p"), (F.count(F.lit(1)) > 1).alias("conflict"))  # null keys are equal here
    return by.select("hash", "schema", "p.source_id", "p.version", "p.variant", "p.record", (F.col("conflict") & F.lit(not overwrite)).alias("conflict"))


def remove_annotations(annotations: DataFrame, schema: str, source_id: str | None = None) -> DataFrame:
    gone = F.col("schema") == schema
    if source_id is not None:
        gone = gone & (F.col("source_id") == source_id)
    return annotations.where(~F.coalesce(gone, F.lit(False)))


def flatten(files: DataFrame, annotations: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per file with a column ``schema__field`` for each of ``columns``, from annotations with scalar fields.

    The columns are given, as a header that is found from data costs a pass; see ``flat_columns`` for that.
    """
    value = lambda s, f: F.max(F.when(F.col("schema") == s, F.get_json_object("record", f"$.{f}")))
    wide = annotations.groupBy("hash").agg(*(value(s, f).alias(f"{s.replace('/', '_').replace('-', '_')}__{f}") for s, f in columns))
    return files.join(wide, "hash", "left")


def flat_columns(annotations: DataFrame) -> list[tuple[str, str]]:
    """Schemas and their scalar fields, sorted; as many as the schemas have, whatever the rows."""
    entries = annotations.select("schema", F.explode(F.from_json("record", "map<string,variant>")).alias("field", "value"))
    scalar = ~F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    return sorted((r[0], r[1]) for r in entries.where(scalar).select("schema", "field").distinct().collect())


def scrub(records: DataFrame, personal: list[str], json_col: str = "record") -> DataFrame:
    """Records without the values of personal fields: null instead, other fields as they are."""
    fields = F.from_json(json_col, "map<string,variant>")
    none = F.parse_json(F.lit("null"))
    cleaned = F.transform_values(fields, lambda k, v: F.when(k.isin(personal), none).otherwise(v))
    return records.withColumn(json_col, F.to_json(cleaned))


def without_personal(value: Column, kind: T.DataType, personal: frozenset[str]) -> Column:
    """A value of any type without what its personal fields hold, however deep: null instead, of arrays an empty one."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_personal(x, kind.elementType, personal))
    if not isinstance(kind, T.StructType):
        return value
    fields = []
    for f in kind:
        if f.name in personal:
            kept = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)
        else:
            kept = without_personal(value[f.name], f.dataType, personal)
        fields.append(kept.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def scrub_nested(records: DataFrame, personal: list[str], schema: str, json_col: str = "record") -> DataFrame:
    """Like ``scrub`` for records of a known shape (``schema``, as DDL): objects and lists in them are scrubbed too."""
    shape = T.StructType.fromDDL(schema)
    cleaned = without_personal(F.from_json(json_col, shape), shape, frozenset(personal))
    return records.withColumn(json_col, F.to_json(cleaned, {"ignoreNullFields": "false"}))


def aware(value: Column, kind: T.DataType, zone: str = "UTC") -> Column:
    """A value of any type whose times without a zone, however deep, are taken as times of ``zone``."""
    if isinstance(kind, T.TimestampNTZType):
        return F.convert_timezone(F.lit(zone), F.current_timezone(), value).cast("timestamp")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: aware(x, kind.elementType, zone))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: aware(v, kind.valueType, zone))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(aware(value[f.name], f.dataType, zone).alias(f.name) for f in kind)))
    return value


def with_aware_times(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    return rows.select(*(aware(F.col(f"`{f.name}`"), f.dataType, zone).alias(f.name) for f in rows.schema))


# Extracted records that stand beside the base one.
EXTRACTED = ("pdf", "ebook", "office", "mediainfo")


def attributes(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with what a file record (JSON) says of its file: hashes, name, extension, size (0 if unknown), media type,
    all hashes, and of each extracted kind its record and source as JSON. What is absent is null."""
    v = F.try_parse_json(json_col)
    top = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    base = lambda name, kind: F.try_variant_get(v, f"$.annotations['file/base'].record.{name}", kind)
    part = lambda name, what: F.to_json(F.try_variant_get(v, f"$.annotations['file/{name}'].{what}", "variant"))
    return records.select(
        "*", top("hash"), top("quick_hash"), top("validation_hash"), base("name", "string").alias("name"), base("extension", "string").alias("extension"),
        F.coalesce(base("size", "long"), F.lit(0).cast("long")).alias("size"), base("media_type", "string").alias("media_type"),
        base("all_hashes", "array<struct<id: string, value: string>>").alias("all_hashes"),
        *(c for k in EXTRACTED for c in (part(k, "record").alias(k), part(k, "source").alias(f"{k}_source"))),
    )


def read_records(texts: DataFrame, json_col: str = "record", path_col: str = "path") -> DataFrame:
    """File records from JSON texts: their ``attributes``, the path they were made from (else that of the text), and
    ``faults``: what keeps a record from being a strict one. ``spark.read.text(folder, wholetext=True)`` gives the texts."""
    v = F.try_parse_json(json_col)
    known = attributes(texts, json_col)
    other = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    rules = [
        (v.isNull(), "not JSON"),
        (v.isNotNull() & ~F.coalesce(F.col("hash").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "no SHA-256"),
        (v.isNotNull() & F.try_variant_get(v, "$.annotations['file/base'].record", "variant").isNull(), "no base record"),
        (F.col("size") < 0, "negative size"),
        (v.isNotNull() & F.col("media_type").isNull(), "no media type"),
    ]
    plain = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules)), lambda x: x.isNotNull())
    hashes = F.when(F.col("all_hashes").isNotNull(), hash_faults(F.col("hash"), F.col("all_hashes"), [other("quick_hash"), other("validation_hash"), other("similarity_hash")]))
    path = F.coalesce(F.try_variant_get(v, "$.local_attributes.file_path", "string"), F.col(path_col))
    return known.withColumn("faults", F.concat(plain, F.coalesce(hashes, F.expr("CAST(array() AS array<string>)")))).withColumn(path_col, path)


def dump(rows: DataFrame, columns: list[str], *, exclude: tuple[str, ...] = (), aliases: dict[str, str] | None = None, nulls: bool = False) -> Column:
    """Columns as one JSON text: without ``exclude`` ("a" or "a.b" for a field of a struct), under their aliases, and without
    null fields unless ``nulls``."""
    shape, names = rows.schema, aliases or {}
    kept = []
    for name in columns:
        if name in exclude:
            continue
        inner = [e.split(".", 1)[1] for e in exclude if e.startswith(f"{name}.")]
        column = F.col(name).dropFields(*inner) if inner and isinstance(shape[name].dataType, T.StructType) else F.col(name)
        kept.append(column.alias(names.get(name, name)))
    return F.to_json(F.struct(*kept), {"ignoreNullFields": str(not nulls).lower()})


def with_privacy(annotations: DataFrame, core: list[str], private: bool) -> DataFrame:
    """Core annotations take the privacy of the request, others keep theirs."""
    return annotations.withColumn("private", F.when(F.col("schema").isin(core), F.lit(private)).otherwise(F.col("private")))


def classification_record(labels: Column, vocabulary: Column | None = None, **extra: Column) -> Column:
    """A classification record as JSON from an array of label texts; null fields are left out."""
    shaped = F.transform(labels, lambda x: F.struct(x.alias("label")))
    fields = [shaped.alias("labels")] + ([vocabulary.alias("vocabulary")] if vocabulary is not None else [])
    return F.to_json(F.struct(*fields, *(c.alias(k) for k, c in extra.items())))


def embedding_record(vector: Column, model: Column | None = None) -> Column:
    fields = [vector.alias("vector")] + ([model.alias("model")] if model is not None else [])
    return F.to_json(F.struct(*fields))


def fits(json_record: Column) -> Column:
    return json_size(json_record) <= MOST_BYTES


def chunk_numbers(sizes: list[int], first: int, later: int, most: int) -> list[int]:
    """The chunk of each item: filled in order, a comma between items, ``first`` and ``later`` bytes for the rest of a chunk."""
    out, held, chunk, empty = [], first, 0, True
    if first > most:
        raise ValueError(f"the other fields take {first} bytes")
    for size in sizes:
        if held + size + (not empty) > most:
            if empty:
                raise ValueError(f"an item takes {size} bytes")
            chunk, held, empty = chunk + 1, later, True
            if held + size > most:
                raise ValueError(f"an item takes {size} bytes")
        held += size + (not empty)
        empty = False
        out.append(chunk)
    return out


def split_lists(records: DataFrame, most: int = MOST_BYTES, sizes_col: str = "sizes", first_col: str = "first", later_col: str = "later") -> DataFrame:
    """``records`` with ``chunks``: the chunk number of each item of a list whose items have ``sizes`` bytes."""

    @F.pandas_udf("array<int>")
    def numbered(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, first, later in batches:
            yield pd.Series([chunk_numbers(list(s), f, n, most) for s, f, n in zip(sizes, first, later)], dtype=object)

    return records.withColumn("chunks", numbered(sizes_col, first_col, later_col))


def split_text(text: str, skeleton: int, most: int = MOST_BYTES, reserve: int = TEXT_RESERVE) -> list[str]:
    """Parts of a text that fit a record whose other fields take ``skeleton`` bytes; no letter is cut, escapes are counted."""
    room = most - skeleton - reserve
    if room < 1024:
        raise ValueError(f"the other fields take {skeleton} bytes")
    data, parts, at = text.encode("utf-8"), [], 0
    while at < len(data):
        end = min(at + room, len(data))
        while at < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        part = data[at:end].decode("utf-8")
        if skeleton + len(json.dumps(part)) - 2 > most:
            room = int(room * 0.9)
            if room < 100:
                raise ValueError("the text escapes to too many bytes")
            continue
        parts.append(part)
        at = end
    return parts


def split_texts(records: DataFrame, most: int = MOST_BYTES, reserve: int = TEXT_RESERVE) -> DataFrame:
    """Rows ``(id, text, skeleton)`` as parts ``(id, index, total, text)``."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, skeletons: pd.Series) -> pd.Series:
        return pd.Series([split_text(t or "", int(s), most, reserve) or [""] for t, s in zip(texts, skeletons)], dtype=object)

    cut = records.withColumn("parts", parts("text", "skeleton"))
    return cut.select("id", F.size("parts").alias("total"), F.posexplode("parts").alias("index", "text"))


def reassemble(parts: DataFrame, key: str = "id") -> DataFrame:
    """Texts from their parts in order of ``index``; ``complete`` tells whether all ``total`` are there.

    A record has at most a hundred parts, so a group is small.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "")
    return parts.groupBy(key).agg(joined.alias("text"), (F.count(F.lit(1)) == F.max("total")).alias("complete"))


def wrapped(records: DataFrame, most: int = MOST_BYTES, reserve: int = TEXT_RESERVE, key: str = "id") -> DataFrame:
    """Rows ``(id, text, skeleton)`` as annotations: ``text`` and ``group``, which is null for a record that fits ``most``
    bytes; others are split, and each part tells its group, its index and how many there are. Group ids follow from the
    record, so a task that runs again gives the same."""
    size = F.octet_length("text")
    exact = F.col("skeleton") + json_size(F.to_json(F.struct(F.col("text").alias("t")))) - 8 <= most
    # a byte is six at most as JSON; only texts between the bounds are written out to be measured, and each is judged once
    whole = F.when(F.col("skeleton") + 6 * size <= most, True).when(F.col("skeleton") + size > most, False).otherwise(exact)

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, skeletons: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, int(s), most, reserve) or [""] for t, s in zip(texts, skeletons)], dtype=object)

    judged = records.withColumn("__whole", F.coalesce(whole, F.lit(True)))
    cut = judged.withColumn("__parts", parts(F.when(~F.col("__whole"), F.col("text")), "skeleton"))
    name = F.md5(F.concat(F.lit("group "), F.col(key).cast("string")))
    group = lambda i: F.struct(name.alias("id"), i.alias("index"), F.size("__parts").alias("total"))
    alone = F.array(F.struct(F.col("text"), F.lit(None).cast("struct<id: string, index: int, total: int>").alias("group")))
    rows = F.when(F.col("__whole"), alone).otherwise(F.transform("__parts", lambda t, i: F.struct(t.alias("text"), group(i).alias("group"))))
    return cut.select(key, F.inline(rows))


def unwrapped(annotations: DataFrame, key: str = "id") -> DataFrame:
    """Annotations as ``wrapped`` gives them, groups put together again; ``complete`` is false where parts are missing."""
    alone = annotations.where("group IS NULL").select(key, "text", F.lit(True).alias("complete"))
    parts = annotations.where("group IS NOT NULL").select(key, "text", "group.index", "group.total")
    return alone.unionByName(reassemble(parts, key).select(key, "text", "complete"))


def number_chunks(items: DataFrame, key: str, order: list[str], most: int = MOST_BYTES, first: int = 0, later: int = 0) -> DataFrame:
    """``items`` (``key``, ``order``, ``size``) with the chunk that each falls into when each key's items are put into chunks
    in order, as ``chunk_numbers`` does, and their ``place`` in the key from 1.

    Items are sorted over the partitions by key and order (which tells the items of a key apart), so one key is dealt to
    as many tasks as it needs; ``chunking`` says how the chunks of one partition follow from those of the ones before.
    """
    entries, ordered = chunking.entries(items, key, order, most, first, later)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, now, began = most + 1, None, False
        held = chunk = place = 0
        for batch in batches:
            chunks, places = [], []
            for k, size in zip(batch[key], batch["size"]):
                if not began and (entry := entries.get(TaskContext.get().partitionId())):
                    now, held, chunk, place = k, *entry
                elif not began or k != now:
                    now, held, chunk, place = k, first, 0, 0
                began = True
                if held + size + 1 > room:
                    if place == 0 or later + size + 1 > room:
                        raise ValueError(f"an item takes {size} bytes")
                    chunk, held = chunk + 1, later
                held += size + 1
                place += 1
                chunks.append(chunk)
                places.append(place)
            yield batch.assign(place=places, chunk=chunks)

    schema = T.StructType([*items.schema, T.StructField("place", T.LongType()), T.StructField("chunk", T.IntegerType())])
    return ordered.mapInPandas(numbered, schema)


# Caches


def export_rows(cache: DataFrame, with_records: bool = True) -> DataFrame:
    """Cached rows as they leave: the record (bytes, packed with zlib if ``is_compressed``) as JSON text, or an error."""
    if not with_records:
        return cache.drop("record", "is_compressed")

    @F.pandas_udf("string")
    def plain(data: pd.Series, packed: pd.Series) -> pd.Series:
        def text(x: bytes | None, p: int | None) -> str | None:
            if x is None:
                return None
            try:
                found = (zlib.decompress(x) if p else x).decode("utf-8")
                json.loads(found)
                return found
            except (zlib.error, UnicodeDecodeError, json.JSONDecodeError):
                return '{"error":"Could not decode record"}'

        return pd.Series([text(x, p) for x, p in zip(data, packed)], dtype=object)

    return cache.withColumn("record", plain("record", "is_compressed")).drop("is_compressed")


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A row per path: the new one where there is one."""
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new)


def upsert_hash(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """``hashes`` (``path``, ``modified``, ``hash``) put into the cache; a full record of another time is dropped first."""
    put = hashes.select("path", F.col("modified").alias("__m"), F.col("hash").alias("__h"))
    joined = cache.join(put, "path", "full_outer")
    stale = F.col("__m").isNotNull() & ~F.col("__m").eqNullSafe(F.col("modified"))
    return joined.select(
        "path", F.coalesce("__m", "modified").alias("modified"), F.coalesce("__h", "hash").alias("hash"), F.when(~stale, F.col("record")).alias("record")
    )


def prune_cache(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows whose file is still there with the same time."""
    return cache.join(files.select("path", "modified"), ["path", "modified"], "left_semi")


# Catalog of records and collections


def download(records: DataFrame, asked: DataFrame) -> DataFrame:
    """The record of each asked hash: the private one, else the public one; of several the newest (``date_modified``, if the
    records have it), and of these the last in order."""
    order = [c for c in ("date_modified", "record") if c in records.columns]
    newest = lambda test: F.max(F.when(test, F.struct(*order)))["record"]
    by = records.groupBy("hash").agg(newest(F.col("private")).alias("__private"), newest(~F.col("private")).alias("__public"))
    found = asked.join(by, "hash", "left")
    scope = F.when(F.col("__private").isNotNull(), "private").when(F.col("__public").isNotNull(), "public")
    return found.select(*asked.columns, F.coalesce("__private", "__public").alias("record"), scope.alias("scope"))


def delete_scope(rows: DataFrame, hashes: DataFrame, scope: str) -> DataFrame:
    """``rows`` without those of ``hashes`` that are in scope: "all", "private", "public" or "none"."""
    if scope == "none":
        return rows
    marked = rows.join(hashes.select("hash").distinct().withColumn("__gone", F.lit(True)), "hash", "left")
    hit = F.coalesce("__gone", F.lit(False)) & {"all": F.lit(True), "private": F.col("private"), "public": ~F.col("private")}[scope]
    return marked.where(~hit).drop("__gone")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Status of each new tag (``hash``, ``name``, ``value``, ``private``): added, upvoted if it is public and known, no action."""
    known = tags.select("hash", "name", "value", "private").distinct().withColumn("__known", F.lit(True))
    found = new.join(known, ["hash", "name", "value", "private"], "left")
    return found.withColumn("status", F.when(F.col("__known").isNull(), "added").when(~F.col("private"), "upvoted").otherwise("no action")).drop("__known")


def collection_change(members: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """What adding ``asked`` hashes to each collection would do: counts of added, duplicate and invalid ones."""
    keys = ["collection_id", "hash"]
    state = (
        asked.select(*keys).distinct()
        .join(members.select(*keys).distinct().withColumn("__in", F.lit(1)), keys, "left")
        .join(known.select("hash").distinct().withColumn("__known", F.lit(1)), "hash", "left")
    )
    status = F.when(F.col("__known").isNull(), "invalid").when(F.col("__in").isNotNull(), "duplicate").otherwise("added")
    by = state.withColumn("s", status).groupBy("collection_id")
    return by.agg(*(F.count_if(F.col("s") == s).alias(s) for s in ("added", "duplicate", "invalid")))


def collection_removal(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts of hashes that removal finds and doesn't find in each collection."""
    keys = ["collection_id", "hash"]
    state = asked.select(*keys).distinct().join(members.select(*keys).distinct().withColumn("__in", F.lit(1)), keys, "left")
    return state.groupBy("collection_id").agg(F.count("__in").alias("removed"), F.count_if(F.col("__in").isNull()).alias("not_found"))
