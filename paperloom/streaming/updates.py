"""An extension: files that arrive are taken into a library as a stream, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, markdown of text files as they appear."""
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return found.select("path", T.checksum(F.col("content")).alias("sha256"), F.decode("content", "UTF-8").alias("markdown"))


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces what the table holds of its paths: a version is written beside the old one, then named current, so
    that a batch that runs again has the same result."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["path"])
        if number:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            new = old.join(new, "path", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
