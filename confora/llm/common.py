"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import components
from ..sources.shared import shared_dir, written  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns never clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def free_name(name: str, *taken: str) -> str:
    """``name`` with as many underscores before it as it takes to be none of the ``taken`` (upper and lower case are one)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component), component being the smallest node that links reach."""
    return components(edges)
