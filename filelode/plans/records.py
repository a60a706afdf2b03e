"""Queries on annotations, validation, oversized records, caches and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelode.functions import languages
from filelode.operators import catalog, sets, validation
from filelode.operators import records as R
from filelode.plans.catalogue import named
from filelode.plans.views import FILES_SQL, files, read

# Validation


def _classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    good = F.to_json(F.struct(F.array(F.struct(F.lit("toxic").alias("label"), (F.col("toxic") * 0.5).alias("score"))).alias("labels")))
    record = (
        F.when(kind == 0, F.lit('{"labels": []}'))
        .when(kind == 1, F.lit('{"labels": [], "producer": "p"}'))
        .when(kind == 2, F.lit('{"labels": [{"label": "a", "score": 2}, {"score": 0.5}]}'))
        .when(kind == 3, F.lit('{"labels": [{"label": "a", "more": 1}], "other": true}'))
        .when(kind == 4, F.lit("{broken"))
        .otherwise(good)
    )
    return read(spark, sf_dir, "labels").select("doc_id", record.alias("record"))


@named(
    "f15_validate_classification",
    """SELECT doc_id, doc_id % 6 IN (1, 5) AS valid, CASE doc_id % 6 WHEN 0 THEN ['$ needs vocabulary or vocabulary_url or producer without labels']
      WHEN 2 THEN ['$.labels[*].score', '$.labels[*].label missing'] WHEN 3 THEN ['$ has other fields', '$.labels[*] has other fields']
      WHEN 4 THEN ['$ is not JSON'] ELSE [] END AS errors FROM labels""",
)
def f15_validate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(_classifications(spark, sf_dir), "classification").select("doc_id", "valid", "errors")


@named("a10_validation_summary", "SELECT count(*) AS total, count(*) FILTER (doc_id % 6 IN (1, 5)) AS valid, count(*) FILTER (doc_id % 6 NOT IN (1, 5)) AS invalid FROM labels")
def a10_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(validation.validate(_classifications(spark, sf_dir), "classification"))


@named(
    "f15_validate_embedding",
    "SELECT vec_id, len(embedding) BETWEEN 1 AND 16384 AND vec_id % 5 <> 0 AS valid FROM embeddings",
)
def f15_validate_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = R.embedding_record(F.col("embedding"), F.lit("m"))
    record = F.when(F.col("vec_id") % 5 == 0, F.regexp_replace(plain, r"\[", '["x",')).otherwise(plain)
    return validation.validate(read(spark, sf_dir, "embeddings").select("vec_id", record.alias("record")), "embedding").select("vec_id", "valid")


@named("f15_validate_generic", """SELECT event_id, event_id % 4 <> 1 AS valid FROM events""")
def f15_validate_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.when(F.col("event_id") % 4 == 1, '{"data": {"a": {"b": 1}}}').otherwise(F.concat(F.lit('{"data": '), "props", F.lit("}")))
    return validation.validate(read(spark, sf_dir, "events").select("event_id", nested.alias("record")), "generic").select("event_id", "valid")


# Annotations


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hash"),
        F.when(F.col("l_linenumber") == 1, "file/base").otherwise("open/generic").alias("schema"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("source_id"),
        F.lit("1").alias("version"),
        F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).alias("variant"),
        F.to_json(F.struct(F.col("l_quantity").cast("int").alias("quantity"), F.col("l_linestatus").alias("status"), F.array("l_partkey").alias("parts"))).alias("record"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )


@named(
    "p2_annotations_of",
    "SELECT l_orderkey AS hash, l_partkey FROM lineitem WHERE l_linenumber <> 1 AND l_suppkey % 3 = 2",
)
def p2_annotations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annotations_of(_annotations(spark, sf_dir), "open/generic", "m2").select("hash", "l_partkey")


@named("p9_remove_annotations", "SELECT l_orderkey AS hash, l_partkey FROM lineitem WHERE NOT (l_linenumber <> 1 AND l_suppkey % 3 = 2)")
def p9_remove_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remove_annotations(_annotations(spark, sf_dir), "open/generic", "m2").select("hash", "l_partkey")


@named(
    "p3_flatten",
    """WITH a AS (SELECT l_orderkey AS hash, max(CASE WHEN l_linenumber = 1 THEN l_linestatus END) AS file_base__status,
      max(CASE WHEN l_linenumber <> 1 THEN (l_quantity::INT)::VARCHAR END) AS open_generic__quantity FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS hash, o_orderstatus AS source_path, file_base__status, open_generic__quantity FROM orders LEFT JOIN a ON hash = o_orderkey""",
)
def p3_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderstatus").alias("source_path"))
    return R.flatten(rows, _annotations(spark, sf_dir), [("file/base", "status"), ("open/generic", "quantity")])


@named("p5_scrub", """SELECT event_id, '{"k":null}' AS record FROM events""")
def p5_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scrub(read(spark, sf_dir, "events").select("event_id", F.col("props").alias("record")), ["k", "author"])


@named("p6_privacy", "SELECT l_orderkey AS hash, l_partkey, CASE WHEN l_linenumber = 1 THEN false ELSE l_suppkey % 2 = 0 END AS private FROM lineitem")
def p6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotations(spark, sf_dir).withColumn("private", F.col("l_suppkey") % 2 == 0)
    return R.with_privacy(rows, ["file/base"], False).select("hash", "l_partkey", "private")


@named(
    "p8_classification_record",
    """SELECT doc_id, '{"labels":[{"label":"q' || quality || '"},{"label":"t' || toxic || '"}]' || CASE WHEN doc_id % 2 = 0 THEN ',"producer":"p"' ELSE '' END || '}' AS record FROM labels""",
)
def p8_classification_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string")))
    record = R.classification_record(labels, producer=F.when(F.col("doc_id") % 2 == 0, "p"))
    return read(spark, sf_dir, "labels").select("doc_id", record.alias("record"))


@named(
    "n3_upsert_annotations",
    """WITH a AS (SELECT o_orderkey AS hash, CASE WHEN o_custkey % 3 = 0 THEN 'file/base' ELSE 'open/generic' END AS schema, 'm' || o_custkey % 2 AS source_id, 0 AS age FROM orders
      UNION ALL SELECT o_orderkey, 'file/base', 'm1', 1 FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT o_orderkey, 'open/generic', 'm1', 1 FROM orders WHERE o_orderkey % 2 = 1)
    SELECT hash, schema, arg_max(source_id, age) AS source_id, max(age) AS age FROM a
    GROUP BY hash, schema, CASE WHEN schema <> 'file/base' THEN source_id END""",
)
def n3_upsert_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    fixed = {"version": F.lit("1"), "variant": F.lit(None).cast("string")}
    old = orders.select(
        F.col("o_orderkey").alias("hash"), F.when(F.col("o_custkey") % 3 == 0, "file/base").otherwise("open/generic").alias("schema"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string")).alias("source_id"), F.lit(0).alias("record"),
    )
    new = orders.select(
        F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderkey") % 2 == 0, "file/base").otherwise("open/generic").alias("schema"),
        F.lit("m1").alias("source_id"), F.lit(1).alias("record"),
    )
    found = R.upsert_annotations(old.withColumns(fixed), new.withColumns(fixed), ["file/base"])
    return found.select("hash", "schema", "source_id", F.col("record").alias("age"))


# Oversized records


@named(
    "sh1_split_lists",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, (strlen(text) + 2)::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, strlen(text)) AS i FROM conversations),
    w AS (SELECT conv_id, turn, size, i, 0 AS chunk, 100 + size AS held FROM t WHERE i = 1 UNION ALL
      SELECT t.conv_id, t.turn, t.size, t.i, w.chunk + CASE WHEN w.held + 1 + t.size > 60000 THEN 1 ELSE 0 END, CASE WHEN w.held + 1 + t.size > 60000 THEN 50 + t.size ELSE w.held + 1 + t.size END
      FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
    SELECT conv_id, turn, size, i AS place, chunk FROM w""",
)
def sh1_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.octet_length("text") + 2).cast("long").alias("size"))
    return R.number_chunks(rows, "conv_id", ["turn", "size"], most=60_000, first=100, later=50)


@named("sh2_sh3_split_and_reassemble", "SELECT doc_id AS id, text, true AS complete FROM documents")
def sh2_sh3_split_and_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(200).alias("skeleton"))
    return R.reassemble(R.split_texts(rows, most=8192, reserve=1024))


@named(
    "sh3_reassemble",
    """SELECT l_orderkey AS id, string_agg(l_returnflag || l_partkey, '' ORDER BY l_linenumber, l_returnflag || l_partkey) AS text, count(*) = max(l_linenumber) AS complete
    FROM lineitem GROUP BY l_orderkey""",
)
def sh3_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order has few lines, as a split record has few parts."""
    parts = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text")
    )
    total = parts.groupBy("id").agg(F.max("index").alias("total"))
    return R.reassemble(parts.join(total, "id"))


# Caches

_CACHE_SQL = f"WITH {FILES_SQL}, cache AS (SELECT name AS path, ordinal % 7 AS modified, hash, CASE WHEN ordinal % 2 = 0 THEN 'r' END AS record FROM files WHERE ordinal % 3 <> 0)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("ordinal % 3 != 0").select(
        F.col("name").alias("path"), (F.col("ordinal") % 7).alias("modified"), "hash", F.when(F.col("ordinal") % 2 == 0, "r").alias("record")
    )


@named(
    "c1_upsert_cache",
    _CACHE_SQL + """, new AS (SELECT name AS path, 9 AS modified, upper(hash) AS hash, 'n' AS record FROM files WHERE ordinal % 4 = 0 OR ordinal % 3 = 0)
    SELECT * FROM new UNION ALL SELECT * FROM cache WHERE path NOT IN (SELECT path FROM new)""",
)
def c1_upsert_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = files(spark, sf_dir).where("ordinal % 4 = 0 OR ordinal % 3 = 0").select(F.col("name").alias("path"), F.lit(9).cast("long").alias("modified"), F.upper("hash").alias("hash"), F.lit("n").alias("record"))
    return R.upsert_cache(_cache(spark, sf_dir), new)


@named(
    "c2_upsert_hash",
    _CACHE_SQL + """, put AS (SELECT name AS path, ordinal % 5 AS m, 'h' AS h FROM files WHERE ordinal % 2 = 0 OR ordinal % 3 = 0)
    SELECT path, coalesce(m, modified) AS modified, coalesce(h, hash) AS hash, CASE WHEN m IS NULL OR m = modified THEN record END AS record FROM cache FULL JOIN put USING (path)""",
)
def c2_upsert_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = files(spark, sf_dir).where("ordinal % 2 = 0 OR ordinal % 3 = 0").select(F.col("name").alias("path"), (F.col("ordinal") % 5).alias("modified"), F.lit("h").alias("hash"))
    return R.upsert_hash(_cache(spark, sf_dir), put)


@named("c4_prune_cache", _CACHE_SQL + ", now AS (SELECT name AS path, ordinal % 5 AS modified FROM files) SELECT c.* FROM cache c WHERE (path, modified) IN (SELECT path, modified FROM now)")
def c4_prune_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = files(spark, sf_dir).select(F.col("name").alias("path"), (F.col("ordinal") % 5).alias("modified"))
    return R.prune_cache(_cache(spark, sf_dir), now).select("path", "modified", "hash", "record")


# Catalog

_CATALOG_SQL = "r AS (SELECT o_custkey AS hash, o_orderkey AS record, o_orderkey % 2 = 0 AS private FROM orders)"


@named(
    "r1_download",
    """WITH p AS (SELECT o_custkey AS hash, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS pr, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 <> 0) AS pu FROM orders GROUP BY 1)
    SELECT c_custkey AS hash, coalesce(pr, pu) AS record, CASE WHEN pr IS NOT NULL THEN 'private' WHEN pu IS NOT NULL THEN 'public' END AS scope FROM customer LEFT JOIN p ON hash = c_custkey""",
)
def r1_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hash"), F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 2 == 0).alias("private"), F.col("o_orderdate").alias("date_modified"))
    return R.download(catalog, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hash"))).select("hash", "record", "scope")


@named("r2_delete_scope", f"WITH {_CATALOG_SQL} SELECT hash, record FROM r WHERE NOT (private AND hash IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10))")
def r2_delete_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hash"), F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 2 == 0).alias("private"))
    gone = read(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("hash"))
    return R.delete_scope(catalog, gone, "private").select("hash", "record")


_TAG_COLUMNS = "p_name AS hash, p_brand AS name, p_type AS value, p_size % 2 = 0 AS private"


@named(
    "r7_add_tags",
    f"""WITH k AS (SELECT DISTINCT {_TAG_COLUMNS} FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey, {_TAG_COLUMNS} FROM part WHERE p_partkey % 2 = 1)
    SELECT p_partkey, CASE WHEN k.hash IS NULL THEN 'added' WHEN NOT n.private THEN 'upvoted' ELSE 'no action' END AS status FROM n LEFT JOIN k USING (hash, name, value, private)""",
)
def r7_add_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("hash"), F.col("p_brand").alias("name"), F.col("p_type").alias("value"), (F.col("p_size") % 2 == 0).alias("private")
    )
    return R.add_tags(rows.where("p_partkey % 2 = 0").drop("p_partkey"), rows.where("p_partkey % 2 = 1")).select("p_partkey", "status")


# Members are orders by customer; asked for are order lines by supplier, half of whose hashes no record has.
_MEMBERS_SQL = """m AS (SELECT DISTINCT o_custkey % 50 AS collection_id, o_orderkey AS hash FROM orders),
asked AS (SELECT DISTINCT l_suppkey % 50 AS collection_id, l_orderkey + l_linenumber % 2 * 1000000000 AS hash FROM lineitem)"""


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("collection_id"), F.col("o_orderkey").alias("hash"))
    hash_ = F.col("l_orderkey") + F.col("l_linenumber") % 2 * F.lit(1_000_000_000).cast("long")
    return members, read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("collection_id"), hash_.alias("hash"))


@named(
    "r15_add_files",
    f"""WITH {_MEMBERS_SQL}, s AS (SELECT a.collection_id, CASE WHEN a.hash NOT IN (SELECT l_orderkey FROM lineitem) THEN 'invalid' WHEN m.hash IS NOT NULL THEN 'duplicate' ELSE 'added' END AS s
      FROM asked a LEFT JOIN m USING (collection_id, hash))
    SELECT collection_id, count(*) FILTER (s = 'added') AS added, count(*) FILTER (s = 'duplicate') AS duplicate, count(*) FILTER (s = 'invalid') AS invalid FROM s GROUP BY collection_id""",
)
def r15_add_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, asked = _members(spark, sf_dir)
    return R.collection_change(members, asked, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash")))


@named(
    "r16_remove_files",
    f"""WITH {_MEMBERS_SQL} SELECT a.collection_id, count(m.hash) AS removed, count(*) FILTER (m.hash IS NULL) AS not_found FROM asked a LEFT JOIN m USING (collection_id, hash) GROUP BY a.collection_id""",
)
def r16_remove_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collection_removal(*_members(spark, sf_dir))


_COLLECTIONS_SQL = "c AS (SELECT c_custkey AS collection_id, c_nationkey AS date_modified, c_nationkey % 2 = 0 AS is_private FROM customer), m AS (SELECT DISTINCT o_custkey AS collection_id, o_orderkey AS hash FROM orders)"


@named(
    "r13_list_collections",
    f"""WITH {_COLLECTIONS_SQL}, s AS (SELECT collection_id, count(*) AS total_files, sum(trunc(o_totalprice)::BIGINT)::BIGINT AS total_size_bytes FROM m JOIN orders ON o_orderkey = hash GROUP BY collection_id),
    p AS (SELECT * FROM c ORDER BY date_modified DESC, collection_id LIMIT 50 OFFSET 50)
    SELECT collection_id, date_modified, is_private, coalesce(total_files, 0) AS total_files, coalesce(total_size_bytes, 0) AS total_size_bytes FROM p LEFT JOIN s USING (collection_id)""",
)
def r13_list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    collections = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection_id"), F.col("c_nationkey").alias("date_modified"), (F.col("c_nationkey") % 2 == 0).alias("is_private"))
    members = orders.select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("hash")).distinct()
    sizes = orders.select(F.col("o_orderkey").alias("hash"), F.col("o_totalprice").cast("long").alias("size"))
    return catalog.list_collections(collections, members, sizes, number=2)


@named(
    "r19_sync",
    f"""WITH {_MEMBERS_SQL}, s AS (SELECT collection_id, hash, max(o) AS o, max(n) AS n FROM (SELECT *, 1 AS o, 0 AS n FROM m UNION ALL SELECT *, 0, 1 FROM asked) GROUP BY ALL)
    SELECT collection_id, count(*) FILTER (o = 0) AS added, count(*) FILTER (n = 0) AS removed, count(*) FILTER (o = 1 AND n = 1) AS unchanged FROM s
    WHERE collection_id IN (SELECT collection_id FROM asked) GROUP BY collection_id""",
)
def r19_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sync(*_members(spark, sf_dir))[1]


@named("r17_privacy", f"WITH {_COLLECTIONS_SQL} SELECT collection_id, CASE WHEN collection_id IN (1, 2, 3) THEN true ELSE is_private END AS is_private FROM c")
def r17_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection_id"), (F.col("c_nationkey") % 2 == 0).alias("is_private"))
    return catalog.set_privacy(rows, [1, 2, 3], True)


@named("n5_tag_all", f"WITH {FILES_SQL} SELECT hash, t.name, t.value, t.private FROM files, (VALUES ('kind', 'text', true), ('label', 'x', false)) t(name, value, private)")
def n5_tag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tag_all(files(spark, sf_dir), [("kind", "text", True), ("label", "x", False)])


@named(
    "c6_cached_or_computed",
    _CACHE_SQL + """, now AS (SELECT name AS path, ordinal % 5 AS modified, hash FROM files)
    SELECT n.path, n.modified, CASE WHEN c.hash IS NULL THEN upper(n.hash) ELSE c.hash END AS hash, CASE WHEN c.hash IS NULL THEN 'disk' ELSE 'cache' END AS origin
    FROM now n LEFT JOIN cache c USING (path, modified)""",
)
def c6_cached_or_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = files(spark, sf_dir).select(F.col("name").alias("path"), (F.col("ordinal") % 5).alias("modified"), "hash")
    return catalog.cached_or_computed(now, _cache(spark, sf_dir), lambda rows: rows.withColumn("hash", F.upper("hash")))


@named(
    "s6_language",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name,
      CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END AS code, lang || '-419' AS locale FROM documents""",
)
def s6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "lang", F.lit("_419"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", languages.language_name(text).alias("name"), languages.language_code(F.col("lang")).alias("code"), languages.locale(text).alias("locale")
    )


@named("sk8_push", "SELECT o_orderkey // 1000 AS batch, count(*) AS records, CASE WHEN o_orderkey // 1000 % 7 = 0 THEN 'refused ' || count(*) END AS error FROM orders GROUP BY 1")
def sk8_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    def send(batch: list[dict]) -> None:
        if batch[0]["batch"] % 7 == 0:
            raise ValueError(f"refused {len(batch)}")

    rows = read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 1000").alias("batch"), "o_orderkey")
    return catalog.push(rows, send, batch_by="batch")


@named(
    "u3_lineage",
    """WITH RECURSIVE e AS (SELECT c_custkey AS collection, c_custkey // 2 AS part FROM customer UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_nationkey % 2 = 0),
    r AS (SELECT collection, part FROM e WHERE part > 0 UNION SELECT r.collection, e.part FROM r JOIN e ON e.collection = r.part WHERE e.part > 0),
    p AS (SELECT collection, part FROM r UNION SELECT c_custkey, c_custkey FROM customer)
    SELECT collection, count(DISTINCT c_nationkey) AS places, min(c_nationkey) AS first, sum(DISTINCT c_nationkey)::BIGINT AS total FROM p JOIN customer ON c_custkey = part GROUP BY collection""",
)
def u3_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of merges with shared parts: a collection is merged of those with half its key and, some, a third of it."""
    rows = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    halves, thirds = (r.select(key.alias("collection"), F.expr(f"c_custkey div {n}").alias("part")) for r, n in ((rows, 2), (rows.where("c_nationkey % 2 = 0"), 3)))
    edges = halves.unionByName(thirds).where("part > 0")
    found = catalog.lineages(edges, rows.select(key.alias("collection"), F.col("c_nationkey").alias("path")))
    return found.groupBy("collection").agg(F.count(F.lit(1)).alias("places"), F.min("path").alias("first"), F.sum("path").alias("total"))


@named(
    "c6_arriving_files",
    """WITH s AS (SELECT l_suppkey AS path, l_linenumber // 3 AS batch, max(l_partkey) AS modified FROM lineitem GROUP BY ALL),
    p AS (SELECT *, lag(modified) OVER (PARTITION BY path ORDER BY batch) AS before FROM s)
    SELECT path, batch, CASE WHEN before IS NULL THEN 'new' WHEN modified > before THEN 'changed' ELSE 'same' END AS status FROM p""",
)
def c6_arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.expr("l_linenumber div 3").alias("batch")).agg(F.max("l_partkey").alias("modified"))
    return sets.arrivals(rows).select("path", "batch", "status")
