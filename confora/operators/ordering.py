"""Contiguous numbers in a global order, without one task that sees every row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def globally_numbered(df: DataFrame, *order: Column | str, name: str = "position", first: int = 1, partitions: int | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order`` (ties: any), from ``first``.

    Rows are dealt into ranges of the order and sorted within them, and the ranges are written with each row's place. What the driver gets is a count for each
    range; the numbers are those counts summed up, plus the place. Ranges hold their rows whatever the skew of the first columns, as
    long as the order tells rows apart.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranges = written(ranges, "ranges")
    counts = dict(ranges.groupBy(F.shiftright("__at", 33).cast("int").alias("range")).count().collect())
    starts, total = [], first
    for k in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    start = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")  # folded to a constant
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranges.withColumn(name, F.get(start, F.shiftright("__at", 33).cast("int")) + place).drop("__at")
