"""Numbers of rows within their keys, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... within each key, in the order (which should be total; rows that it leaves equal have any order).

    Rows are sorted by ranges of key and order, so a common key fills several ranges. A row's number is its number in its range and
    the numbers of rows of its key in earlier ranges: prefix sums over one row for each range and key. The ranges are a written
    table, as both parts must see the same ones."""
    ranges = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    same = [F.col(f"_k{k}").eqNullSafe(F.col(c)) for k, c in enumerate(keys)]
    counts = ranges.groupBy("_range", *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)]).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*[f"_k{k}" for k in range(len(keys))]).orderBy("_range")  # a row for each range of a key
    bases = counts.withColumn("_base", F.sum("_c").over(before) - F.col("_c")).filter("_base > 0").withColumnRenamed("_range", "_at")
    local = ranges.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    joined = local.join(bases, [F.col("_range") == F.col("_at"), *same], "left")  # keys that begin in an earlier range: one for each range
    return joined.withColumn(name, (F.col("_local") + F.coalesce("_base", F.lit(0))).cast("int")).select(*rows.columns, name)
