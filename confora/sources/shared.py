"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a session of one process that has none gets a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = shared_dir.own = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='confora-')}"
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def file_name() -> Column:
    """The name of the file that a row was read from, as it is in the store: Spark's metadata have it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object): any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


#: Rows that are broadcast at most.
FEW = 100_000


def broadcast_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast only if it was counted to have at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def deleted(df: DataFrame) -> None:
    """Removes the files of a table made by ``written`` that no later plan reads."""
    if path := getattr(df, "written_path", None):
        fs, at = file_system(df.sparkSession, path)
        fs.delete(at, True)


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, for the driver; None if there is none."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a small file from the driver to the store of ``path``."""
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path
