"""File inventories out of the driver's tables: every row of a table is a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/corpus"
URLS = "/web"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size_bytes, modified_ns, attributes, identity, content, doc_id, source, lang: all of `documents` as files under /corpus/source/lang."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    ext = F.when(i % 6 == 0, ".txt").when(i % 6 == 1, ".TXT").when(i % 6 == 2, ".md").when(i % 6 == 3, "").when(i % 6 == 4, ".tar.gz").otherwise(".")
    return d.select(
        F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/"), "lang", F.lit("/d"), i.cast("string"), ext).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(1700000000000000000) + i * 1000000007).alias("modified_ns"),
        F.when(i % 29 == 0, 4096).when(i % 31 == 0, 1024).otherwise(32).cast("long").alias("attributes"),
        F.when(i % 2 == 0, F.concat(F.lit("sh:"), F.sha2(F.col("text").cast("binary"), 256))).otherwise(F.concat(F.lit("own:"), i.cast("string"))).alias("identity"),
        F.col("text").cast("binary").alias("content"), "doc_id", "source", "lang",
    )


#: The same relation for DuckDB, as a common table expression `files`.
FILES_SQL = """files AS (
  SELECT '/corpus/' || source || '/' || lang || '/d' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' WHEN 3 THEN '' WHEN 4 THEN '.tar.gz' ELSE '.' END AS path,
    strlen(text) AS size_bytes, 1700000000000000000 + doc_id * 1000000007 AS modified_ns,
    CASE WHEN doc_id % 29 = 0 THEN 4096 WHEN doc_id % 31 = 0 THEN 1024 ELSE 32 END AS attributes,
    CASE WHEN doc_id % 2 = 0 THEN 'sh:' || sha256(text) ELSE 'own:' || doc_id END AS identity, text, doc_id, source, lang
  FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size_bytes, modified_ns, attributes, page_id: all of `pages` as files under /web/host/path."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rest = F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "")
    return p.select(F.concat(F.lit(f"{URLS}/"), rest, F.lit("/p"), F.col("page_id").cast("string")).alias("path"), F.octet_length("html").cast("long").alias("size_bytes"), (F.lit(1700000000000000000) + F.col("page_id")).alias("modified_ns"), F.lit(32).cast("long").alias("attributes"), "page_id")


PAGES_SQL = """page_files AS (
  SELECT '/web/' || regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') || '/p' || page_id AS path, strlen(html) AS size_bytes, 1700000000000000000 + page_id AS modified_ns, 32 AS attributes, page_id
  FROM pages)"""
