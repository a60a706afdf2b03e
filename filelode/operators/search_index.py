"""An inverted index of names, extensions, media types and tags, so that a search reads a few buckets instead of all files.

The index has a row for each key of a file: each trigram of its name in lower case (``n:abc``), its extension (``e:.pdf``),
its media type and the head of that (``m:text/plain``, ``m:text``), its tags (``t:name``). Rows are sorted by bucket (a hash of the
key), key and ordinal over the partitions, so a key that a third of all files have fills files of its own; beside them are
the counts of the keys. A search looks up how often its keys are there, joins the rarest keys' files, rarest first, and holds
the candidates against the whole query as a scan would, so it gives what the scan gives.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelode.functions.scalars import media_head
from filelode.operators import filters

GRAM = 3
BUCKETS = 256
#: Keys of a search whose files are joined; the others' are left to the check of the candidates.
JOINED = 3
#: Candidates up to which the rows are asked for by their ordinals; ordinals up to which a side of a join is broadcast.
LISTED, BROADCAST = 2_000, 1_000_000


def _keys() -> Column:
    """All keys of a file, each once."""
    name = F.lower(F.col("name"))
    starts = F.when(F.length(name) >= GRAM, F.sequence(F.lit(1), F.length(name) - (GRAM - 1))).otherwise(F.expr("CAST(array() AS array<int>)"))
    grams = F.transform(starts, lambda i: F.concat(F.lit("n:"), F.substring(name, i, F.lit(GRAM))))
    other = F.array(
        F.concat(F.lit("e:"), F.lower("extension")), F.concat(F.lit("m:"), F.col("media_type")), F.concat(F.lit("m:"), media_head(F.col("media_type")))
    )
    tags, none = F.transform("tags", lambda t: F.concat(F.lit("t:"), t["name"])), F.expr("CAST(array() AS array<string>)")
    return F.filter(F.array_distinct(F.concat(F.coalesce(grams, none), other, F.coalesce(tags, none))), lambda k: k.isNotNull())


def bucket_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


@dataclass
class SearchIndex:
    """A folder with the rows of the files (by ordinal), the index and the counts of its keys."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, files: DataFrame, path: str) -> "SearchIndex":
        """``files``: ordinal, hash, name, extension, size, media_type, tags (array of name, ...) and what else a search gives back."""
        spark = files.sparkSession
        if "tags" not in files.columns:
            files = files.withColumn("tags", F.expr("CAST(array() AS array<struct<name: string>>)"))
        files.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(f"{path}/files")
        rows = spark.read.parquet(f"{path}/files")
        tall = rows.select(F.explode(_keys()).alias("key"), "ordinal").withColumn("bucket", (F.crc32(F.col("key").cast("binary")) % BUCKETS).cast("int"))
        order = ["bucket", "key", "ordinal"]
        tall.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/keys")
        counts = spark.read.parquet(f"{path}/keys").groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("files"))
        counts.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/counts")
        return cls(spark, path)

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def _rows_of(self, table: str, keys: list[str]) -> DataFrame:
        """Rows of keys; only their buckets are read, and of these the row groups that can hold them."""
        found = self.spark.read.parquet(f"{self.path}/{table}")
        return found.where(F.col("bucket").isin(sorted({bucket_of(k) for k in keys})) & F.col("key").isin(keys))

    def counts(self, keys: list[str]) -> dict[str, int]:
        found = {r.key: r.files for r in self._rows_of("counts", keys).select("key", "files").collect()} if keys else {}
        return {k: found.get(k, 0) for k in keys}

    def _candidates(self, keys: list[str], counts: dict[str, int]) -> tuple[DataFrame, int]:
        """Ordinals of the files that have the rarest of the keys, and at most how many they are."""
        rarest = sorted(set(keys), key=lambda k: (counts[k], k))[:JOINED]
        out = self._rows_of("keys", rarest[:1]).select("ordinal")
        for key in rarest[1:]:
            side = self._rows_of("keys", [key]).select("ordinal")
            # the smaller side, of a known size, is sent to the other: what is left are its rows
            out = side.join(F.broadcast(out) if counts[rarest[0]] <= BROADCAST else out, "ordinal", "left_semi" if counts[rarest[0]] > BROADCAST else "inner")
        return out, counts[rarest[0]]

    def search(self, query: str, match_any: bool = False, deduplicate: bool = False) -> DataFrame:
        """What ``filters.search`` gives. A term without keys (a size, a word of under three letters) alone is a scan."""
        terms = [keys_of(field, value) for field, value in filters.terms(query)]
        files = self.files()
        plain = filters.search(files, query, match_any, deduplicate)
        known = [t for t in terms if t]
        if not known or (match_any and len(known) < len(terms)):
            return plain
        counts = self.counts(sorted({k for t in known for k in t}))
        if match_any:
            alive = [t for t in known if all(counts[k] for k in t)]
            parts = [self._candidates(t, counts) for t in alive]
        else:
            every = [k for t in known for k in t]
            parts = [self._candidates(every, counts)] if all(counts[k] for k in every) else []
        if not parts:
            return plain.limit(0)
        most = sum(n for _, n in parts)
        found = parts[0][0]
        for more, _ in parts[1:]:
            found = found.unionByName(more)
        if most <= LISTED:
            some = files.where(F.col("ordinal").isin([r.ordinal for r in found.distinct().collect()]))
        else:
            found = found.distinct() if len(parts) > 1 else found
            some = files.join(F.broadcast(found) if most <= BROADCAST else found, "ordinal", "left_semi")
        return filters.search(some, query, match_any, deduplicate)


def keys_of(field: str, value: str) -> list[str]:
    """The keys that every file which a term matches has; none if the term says nothing about keys."""
    if field == "extension":
        return ["e:." + value.lower().lstrip(".")]
    if field == "type":
        return ["m:" + value]
    if field == "tag":
        return ["t:" + value]
    if field == "size":
        return []
    word = value.lower()
    return sorted({"n:" + word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})
