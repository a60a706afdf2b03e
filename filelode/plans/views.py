"""Views of the driver's tables with the columns of a file record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of a table that was just read, with ``row``: where each stands in it, file by file in the order of their paths."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    paths = placed.select("__path").distinct().select("__path", F.row_number().over(Window.orderBy("__path")).alias("__file"))
    found = placed.join(F.broadcast(paths), "__path")  # a row for each file
    return found.withColumn("row", F.col("__file") * F.lit(1 << 40) + F.col("__at")).drop("__path", "__file", "__at")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file record per document; ``ordinal`` is the scan order."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    lang = F.coalesce("lang", F.lit("unknown"))
    minutes = (F.col("doc_id") % 1000).cast("int")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.sha2(text, 256).alias("hash"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), lang).alias("name"),
        F.concat(F.lit("."), lang).alias("extension"),
        F.octet_length(text).cast("long").alias("size"),
        F.concat(F.lit("text/"), lang).alias("media_type"),
        "source",
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").cast("timestamp_ntz").alias("__t0"),
        minutes.alias("__m"),
    ).withColumn("date_modified", F.expr("__t0 + make_dt_interval(0, 0, __m, 0)").cast("timestamp")).drop("__t0", "__m")


FILES_SQL = """
files AS (
  SELECT doc_id AS ordinal, sha256(coalesce(text, '')) AS hash,
         'doc_' || doc_id || '.' || coalesce(lang, 'unknown') AS name, '.' || coalesce(lang, 'unknown') AS extension,
         strlen(coalesce(text, ''))::BIGINT AS size, 'text/' || coalesce(lang, 'unknown') AS media_type, source,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id % 1000)::INT) AS date_modified
  FROM documents
)
"""


def big_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order line with sizes over many orders of magnitude, for summaries at scale."""
    size = (F.col("l_extendedprice") * 100).cast("long") * F.pow(F.lit(10), F.col("l_linenumber") - 1).cast("long")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
        size.alias("size"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("x/"), F.col("l_returnflag"), F.col("l_linestatus"), (F.col("l_suppkey") % 9).cast("string")).alias("media_type"),
        F.concat(F.lit("."), (F.col("l_partkey") % 31).cast("string")).alias("extension"),
        F.col("l_shipdate").cast("timestamp").alias("date_modified"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_quantity").cast("int").cast("string")).alias("hash"),
    )


BIG_FILES_SQL = """
big_files AS (
  SELECT l_orderkey * 8 + l_linenumber AS ordinal, trunc(l_extendedprice * 100)::BIGINT * (10 ** (l_linenumber - 1))::BIGINT AS size,
         'part_' || l_partkey AS name, 'x/' || l_returnflag || l_linestatus || (l_suppkey % 9) AS media_type,
         '.' || (l_partkey % 31) AS extension, l_shipdate AS date_modified, l_partkey || '-' || l_quantity::INT AS hash
  FROM lineitem
)
"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("hash"), F.col("p_brand").alias("name"), F.col("p_type").alias("value"), "p_partkey", "p_size")
