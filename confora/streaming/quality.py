"""Incremental stages over a folder that models arrive in, and windowed aggregates of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.workflow import Settings, quality
from ..sources import pdb


def model_stream(spark: SparkSession, path: str, pattern: str = "*.pdb", files_per_trigger: int = 1000) -> DataFrame:
    """(file, value): whole structure files as they arrive."""
    s = spark.readStream.schema("value string").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return s.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def score_arrivals(stream: DataFrame, output: str, checkpoint: str, settings: Settings | None = None, then: Callable | None = None) -> StreamingQuery:
    """Scores every new model once and appends to ``output`` by batch number, so that a repeated batch overwrites itself."""
    settings = settings or Settings()

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("structure_id"), "file", F.posexplode(F.split("value", "\r?\n")).alias("line_index", "line"))
        scored = quality(pdb.atoms(rows.where("line != ''"), pdb.LENIENT), settings)
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")
        if then:
            then(scored, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, every: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than ``late`` are dropped by the watermark of a stream."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
