"""Continuous intake of objects: a stream of contents, deduplicated against what is stored, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.compare import new_objects


def objects_from(stream: DataFrame, content: str = "content") -> DataFrame:
    """(obj_hash, content) of a stream or table of contents."""
    return stream.select(F.sha2(F.col(content).cast("binary"), 256).alias("obj_hash"), F.col(content).cast("binary").alias("content"))


def intake(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends what the table at ``path`` lacks; replaying a batch overwrites its own part, so nothing doubles."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        mine = f"{path}/batch={number}"
        try:
            stored = spark.read.schema("obj_hash string, content binary, batch long").option("basePath", path).parquet(path).where(F.col("batch") != number)
        except Exception as error:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = spark.createDataFrame([], "obj_hash string")
        new_objects(batch, stored).write.mode("overwrite").parquet(mine)

    return objects_from(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
