"""Collections of the catalog as tables: create, update, read by page, populate, export; records, tags and datasets.

``collections`` has ``collection_id``, ``name``, ``description``, ``is_private``, ``date_modified``; ``members`` has
``collection_id``, ``hash``; ``records`` has ``hash`` and whatever a record has. Nothing is changed in place: a function
gives the table as it is afterwards, and what happened to each row that was asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelode.functions.scalars import dataset_id, parse_hash
from filelode.operators import filters
from filelode.operators.records import scrub

#: Files that are read page by page at most, results of a search page.
MOST_PAGED, MOST_FOUND = 10_000, 50
SORTS = ("date_modified", "date_created", "size", "name")


def pagination(total: int, number: int, per_page: int) -> dict[str, int | bool]:
    """What a page tells about itself. Pages count from 1."""
    if number < 1 or per_page < 1:
        raise ValueError(f"no page {number} of {per_page}")
    pages = max(1, -(-total // per_page))
    start = min((number - 1) * per_page, total)
    end = min(number * per_page, total)
    return {
        "current_page": number, "record_count": total, "page_count": pages, "per_page": per_page, "has_next": number < pages, "has_prev": number > 1,
        "start_index": start + 1 if end > start else 0, "end_index": end,
    }


def create_collections(collections: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``collections`` with ``new`` ones, and the status of each new one: created, or conflict where its name is taken.

    Of new ones with one name the smallest id is created.
    """
    taken = collections.select("name").distinct().withColumn("__taken", F.lit(True))
    first = new.groupBy("name").agg(F.min("collection_id").alias("__first"))
    judged = new.join(taken, "name", "left").join(first, "name")
    made = F.col("__taken").isNull() & (F.col("collection_id") == F.col("__first"))
    status = judged.select("collection_id", "name", F.when(made, "created").otherwise("conflict").alias("status"))
    return collections.unionByName(judged.where(made).select(*collections.columns)), status


def update_collections(collections: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``collections`` with ``changes`` (``collection_id``, ``name``, ``description``; null: as it is) and a status of each.

    A change of nothing is invalid, one of an unknown id not found, a name that another collection has is a conflict.
    """
    put = changes.select("collection_id", F.col("name").alias("__name"), F.col("description").alias("__description"))
    names = collections.select(F.col("name").alias("__name"), F.col("collection_id").alias("__owner")).groupBy("__name").agg(F.min("__owner").alias("__owner"))
    known = collections.select("collection_id").distinct().withColumn("__known", F.lit(True))
    judged = put.join(known, "collection_id", "left").join(names, "__name", "left")
    status = (
        F.when(F.col("__name").isNull() & F.col("__description").isNull(), "invalid")
        .when(F.col("__known").isNull(), "not found")
        .when(F.col("__owner") != F.col("collection_id"), "conflict")
        .otherwise("updated")
    )
    judged = judged.withColumn("status", status)
    good = judged.where("status = 'updated'").select("collection_id", "__name", "__description")
    after = collections.join(good, "collection_id", "left").withColumns({"name": F.coalesce("__name", "name"), "description": F.coalesce("__description", "description")})
    return after.select(*collections.columns), judged.select("collection_id", "status")


def collection_page(members: DataFrame, records: DataFrame, collection: object, number: int = 1, per_page: int = 100, hydrate: bool = False) -> tuple[DataFrame, dict]:
    """A page of a collection's files by hash, whole records if ``hydrate``, and what the page tells about itself."""
    mine = members.where(F.col("collection_id") == collection).select("hash").distinct()
    about = pagination(mine.count(), number, per_page)
    some = mine.orderBy("hash").offset((number - 1) * per_page).limit(per_page)
    return (some.join(records, "hash") if hydrate else some), about


class PageLayout:
    """Members of collections in an order-statistics layout: sorted by collection and hash over parts, each with its count.

    A page is found by adding up the counts, so page 1,000 reads the one or two parts that it lies in, as page 1 does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, members: DataFrame, path: str, per_part: int = 1_000_000) -> "PageLayout":
        """``members`` (``collection_id``, ``hash``), repeated ones once, in parts of about ``per_part``.

        A collection of any size is dealt to as many parts as it needs, as parts are ranges of both columns.
        """
        spark, key = members.sparkSession, ["collection_id", "hash"]
        rows = members.select(*key).distinct()
        parts = max(1, -(-rows.count() // per_part))
        numbered = rows.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id())
        numbered.sortWithinPartitions(*key).write.partitionBy("part").parquet(f"{path}/members")
        ranges = spark.read.parquet(f"{path}/members").groupBy("collection_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        ranges.repartitionByRange("collection_id", "part").sortWithinPartitions("collection_id", "part").write.parquet(f"{path}/parts")
        return cls(spark, path)

    def parts(self, collection: object) -> list:
        """(part, n, least, most) of a collection in order: a row for each of its parts."""
        found = self.spark.read.parquet(f"{self.path}/parts").where(F.col("collection_id") == collection)
        return sorted(found.select("part", "n", "least", "most").collect())

    def _members(self, collection: object, parts: list[int]) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/members").where(F.col("part").isin(parts) & (F.col("collection_id") == collection))
        return found.select("collection_id", "hash")

    def page(self, collection: object, number: int = 1, per_page: int = 100) -> tuple[DataFrame, dict]:
        """A page of a collection's files by hash, and what the page tells about itself."""
        parts = self.parts(collection)
        about = pagination(sum(p.n for p in parts), number, per_page)
        start, end = (number - 1) * per_page, number * per_page
        chosen, before, skipped = [], 0, 0
        for p in parts:
            if before < end and before + p.n > start:
                skipped = before if not chosen else skipped
                chosen.append(p.part)
            before += p.n
        return self._members(collection, chosen).orderBy("hash").offset(max(0, start - skipped)).limit(per_page), about

    def after(self, collection: object, hash_: object = None, per_page: int = 100) -> DataFrame:
        """The files that come after a hash (from the first on if there is none), without counting pages."""
        chosen, room = [], per_page
        for p in self.parts(collection):
            if hash_ is not None and p.most <= hash_:
                continue
            if room <= 0:
                break
            chosen.append(p.part)
            room -= p.n if hash_ is None or p.least > hash_ else 0
        found = self._members(collection, chosen)
        found = found if hash_ is None else found.where(F.col("hash") > hash_)
        return found.orderBy("hash").limit(per_page)


def populate(members: DataFrame, records: DataFrame, collection: object, use_export: bool = False) -> DataFrame:
    """All records of a collection. One of more than ``MOST_PAGED`` files wants ``use_export``, as it is not read by page."""
    mine = members.where(F.col("collection_id") == collection).select("hash").distinct()
    if not use_export and (n := mine.limit(MOST_PAGED + 1).count()) > MOST_PAGED:
        raise ValueError(f"more than {MOST_PAGED} files ({n} counted): say use_export")
    return mine.join(records, "hash")


def export_collection(members: DataFrame, records: DataFrame, collection: object, path: str) -> None:
    """The records of a collection as a folder of compressed JSON lines."""
    populate(members, records, collection, use_export=True).write.mode("overwrite").option("compression", "gzip").json(path)


def index_records(catalog: DataFrame, new: DataFrame, private: bool, personal: list[str]) -> tuple[DataFrame, DataFrame]:
    """``catalog`` (``hash``, ``record``, ``private``) with ``new`` (``hash``, ``record``) and a status for each hash.

    A hash that is no SHA-256 is invalid. Public records lose the values of personal fields. A record replaces the one of
    its hash and privacy: inserted, or updated. Of repeated new hashes the one that sorts last is kept.
    """
    ok = F.coalesce(parse_hash(F.col("hash"))["function"] == "SHA-256", F.lit(False))
    judged = new.groupBy("hash").agg(F.max("record").alias("record")).withColumn("__ok", ok)
    put = judged.where("__ok").select("hash", "record").withColumn("private", F.lit(private))
    if not private:
        put = scrub(put, personal)
    keys = ["hash", "private"]
    known = catalog.select(*keys).distinct().withColumn("__known", F.lit(True))
    status = (
        judged.withColumn("private", F.lit(private)).join(known, keys, "left")
        .select("hash", F.when(~F.col("__ok"), "invalid").when(F.col("__known").isNotNull(), "updated").otherwise("inserted").alias("status"))
    )
    return catalog.join(put.select(*keys), keys, "left_anti").unionByName(put.select(*catalog.columns)), status


def delete_tags(tags: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tags`` (``tag_id``, ``hash``, ...) without those asked for (``hash``, ``tag_id``), and whether each was there."""
    keys = ["hash", "tag_id"]
    wanted = asked.select(*keys).distinct()
    there = tags.select(*keys).distinct().withColumn("__there", F.lit(True))
    status = wanted.join(there, keys, "left").select(*keys, F.when(F.col("__there").isNotNull(), "deleted").otherwise("not found").alias("status"))
    return tags.join(wanted, keys, "left_anti"), status


def datasets_of(datasets: DataFrame, asked: DataFrame, text_col: str = "text") -> DataFrame:
    """``asked`` with the id that its text names and, if the registry has it, kind and schema of the dataset."""
    found = asked.withColumn("dataset_id", dataset_id(F.col(text_col)))
    return found.join(datasets.select("dataset_id", "kind", "schema"), "dataset_id", "left")


def local_paths(results: DataFrame, files: DataFrame, hot: float = 1 / 1000) -> DataFrame:
    """``results`` (``hash``) with the path of the local file of that content, the first in scan order (``ordinal``; by path
    without one); null where there is none. One row a result.

    Files of a hash are one row before they are joined. A hash with more than ``hot`` of all results (there are fewer
    than 1 / ``hot`` such, by counting) is broadcast, so its results aren't shuffled to one task.
    """
    order = [c for c in ("ordinal", "path") if c in files.columns]
    first = files.groupBy("hash").agg(F.min(F.struct(*order))["path"].alias("path"))
    counts = results.groupBy("hash").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    often = F.broadcast(counts.where(F.col("__n") > max(1, int(total * hot))).select("hash"))
    heavy = F.broadcast(often.join(first, "hash", "left"))
    rest = results.join(often, "hash", "left_anti")
    return results.join(heavy, "hash").unionByName(rest.join(first, "hash", "left"))


def search_page(files: DataFrame, query: str, *, scope: str = "user", user: object = None, deduplicate: bool = True, match_any: bool = False,
                sort_by: str = "date_modified", descending: bool = True, number: int = 1, per_page: int = 25) -> DataFrame:
    """A page of what a search finds among the user's files, or among all public ones (``scope`` "global"), sorted.

    Ties come in scan order. A page holds 1 to ``MOST_FOUND`` results.
    """
    if not query.strip():
        raise ValueError("nothing to search for")
    if not 1 <= per_page <= MOST_FOUND or number < 1:
        raise ValueError(f"no page {number} of {per_page}")
    if sort_by not in SORTS or scope not in ("user", "global"):
        raise ValueError(f"no sort by {sort_by} in scope {scope}")
    some = files.where(F.col("owner") == user) if scope == "user" else files.where(~F.col("private"))
    found = filters.search(some, query, match_any, deduplicate)
    key: Column = F.lower("name") if sort_by == "name" else F.col(sort_by)
    return found.orderBy(key.desc() if descending else key.asc(), "ordinal").offset((number - 1) * per_page).limit(per_page)


def upgrade_hashes(records: DataFrame, made: DataFrame, function: str = "BLAKE3") -> DataFrame:
    """``records`` (``hash``, ``all_hashes``) with the hash of one more function from ``made`` (``hash``, ``value``) and a
    ``status``: upgraded, known, conflict where another value is known (which stays), or missing."""
    own = F.filter("all_hashes", lambda x: x["id"] == function)
    joined = records.join(made.select("hash", F.col("value").alias("__value")), "hash", "left")
    status = (
        F.when(F.size(own) == 0, F.when(F.col("__value").isNotNull(), "upgraded").otherwise("missing"))
        .when(F.col("__value").isNull() | (F.get(own, F.lit(0))["value"] == F.col("__value")), "known")
        .otherwise("conflict")
    )
    more = F.array(F.struct(F.lit(function).alias("id"), F.col("__value").alias("value")))
    judged = joined.withColumn("status", status)
    return judged.withColumn("all_hashes", F.when(F.col("status") == "upgraded", F.concat("all_hashes", more)).otherwise(F.col("all_hashes"))).drop("__value")


def refreshed(held: DataFrame, catalog: DataFrame) -> DataFrame:
    """``held`` (``hash``, ``record``, ``date_modified``) as the catalog has them now; ``state`` tells new, same or gone."""
    now = catalog.select("hash", F.col("record").alias("__record"), F.col("date_modified").alias("__modified"))
    joined = held.join(now, "hash", "left")
    newer = F.col("__modified") > F.col("date_modified")
    state = F.when(F.col("__modified").isNull(), "gone").when(newer, "new").otherwise("same")
    return joined.select(
        "hash", F.when(newer, F.col("__record")).otherwise(F.col("record")).alias("record"), F.greatest("date_modified", "__modified").alias("date_modified"), state.alias("state")
    )


def stubs(annotations: DataFrame) -> DataFrame:
    """What a listing tells about annotations: everything but the record, and how many bytes and fields that has."""
    fields = F.map_keys(F.from_json("record", "map<string,variant>"))
    return annotations.withColumns({"record_bytes": F.octet_length("record"), "record_fields": F.size(fields)}).drop("record")
