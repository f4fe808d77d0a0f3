"""A deterministic history of four snapshots, derived from the `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOVED = "moved/"

#: The same in DuckDB: `vf` has snapshot_id, path, blob_hash, size.
SQL = """snaps AS (SELECT unnest([1,2,3,4])::BIGINT AS snapshot_id),
vf AS (SELECT snapshot_id, concat(CASE WHEN doc_id % 11 = 0 AND snapshot_id >= 3 THEN 'moved/' ELSE '' END, source, '/', lang, '/', doc_id::VARCHAR, '.txt') AS path,
         sha256(body) AS blob_hash, strlen(body)::BIGINT AS size
       FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN concat(text, '#v', snapshot_id::VARCHAR) ELSE text END AS body FROM documents, snaps)
       WHERE (doc_id + snapshot_id) % 7 <> 0)"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, path, body) of every file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = docs.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4)])).alias("snapshot_id")).where((F.col("doc_id") + F.col("snapshot_id")) % 7 != 0)
    top = F.when((F.col("doc_id") % 11 == 0) & (F.col("snapshot_id") >= 3), MOVED).otherwise("")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("#v"), F.col("snapshot_id").cast("string"))).otherwise(F.col("text"))
    return rows.select("snapshot_id", F.concat(top, "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), body.alias("body"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, path, blob_hash, size): content stays behind in the scan."""
    return bodies(spark, sf_dir).select("snapshot_id", "path", F.sha2("body", 256).alias("blob_hash"), F.octet_length("body").cast("long").alias("size"))


def snapshot(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return files(spark, sf_dir).where(F.col("snapshot_id") == k)
