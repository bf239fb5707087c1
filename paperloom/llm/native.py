"""Column expressions for places in texts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<start: int, end: int, value: string>"


def spans(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches (never empty ones) as array<struct<start, end, value>>; code points, end exclusive.

    What stands between the matches comes from a split by the same pattern, so running sums of lengths give the places.
    """
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, both: Column) -> Column:
        begin = acc["at"] + F.length(both["between"])
        end = begin + F.length(both["match"])
        own = F.struct(begin.alias("start"), end.alias("end"), both["match"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["found"], own).alias("found"))

    def located(matches: Column) -> Column:
        pairs = F.arrays_zip(matches.alias("match"), F.split(text, pattern, -1).alias("between"))
        return F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), start, step, lambda acc: acc["found"])

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))


def sorted_join(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")
