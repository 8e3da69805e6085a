"""Ensemble screening of residues and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def with_total(df: DataFrame, structures: DataFrame, key: str) -> DataFrame:
    """Adds n_total, the number of all structures, also of those without any row."""
    return df.crossJoin(F.broadcast(structures.agg(F.count_distinct(key).alias("n_total"))))  # one row


def residue_frequency(contacts: DataFrame, structures: DataFrame, structure: str, residue: str, within: Column, distance: str, hot: int | None = None) -> DataFrame:
    """Structures seen and within reach, least, median and mean distance over all rows, frequency over all structures.

    Distinct counts are plain counts over (residue, structure), reduced map-side first; distances have an aggregation of their own, so no
    row is expanded. Both are partitioned by residue. Medians of residues with more than ``hot`` rows are refined by histograms."""
    one = contacts.groupBy(residue, structure).agg(F.max(F.when(within, 1).otherwise(0)).alias("__in"))
    seen = one.groupBy(residue).agg(F.count(structure).alias("n_structures"), F.sum(F.when(F.col(structure).isNotNull(), F.col("__in")).otherwise(0)).alias("n_within"))
    far = contacts.groupBy(F.col(residue).alias("__r")).agg(F.min(distance).alias("min_distance"), F.avg(distance).alias("mean_distance"))
    middle = quantiles(contacts, [F.col(residue)], distance, {"median_distance": 0.5}, hot).withColumnRenamed("k0", "__m")
    s = seen.join(far, F.col(residue).eqNullSafe(F.col("__r"))).join(middle, F.col(residue).eqNullSafe(F.col("__m")), "left").drop("__r", "__m")
    return with_total(s, structures, structure).withColumn("frequency", F.col("n_within") / F.col("n_total"))


def graph_occurrence(edges: DataFrame, structures: DataFrame, structure: str, residue: str) -> DataFrame:
    """Each residue counts once per structure."""
    o = edges.select(residue, structure).distinct().groupBy(residue).agg(F.count(structure).alias("n_graphs"))
    return with_total(o, structures, structure).withColumn("occurrence", F.col("n_graphs") / F.col("n_total"))


def node_sets(edges: DataFrame, structure: str, node: str) -> DataFrame:
    return edges.groupBy(structure).agg(F.array_sort(F.collect_set(node)).alias("nodes"))


def set_types(sets: DataFrame, structure: str) -> DataFrame:
    """Structures of equal node sets form a type; types by descending set size, then descending number, then first structure."""
    from pyspark.sql import Window

    g = sets.groupBy("nodes").agg(F.count("*").alias("n_structures"), F.min(structure).alias("representative")).withColumn("set_size", F.size("nodes"))
    order = Window.orderBy(F.desc("set_size"), F.desc("n_structures"), "representative")
    return g.withColumn("type_number", F.row_number().over(order))  # one row per type


def structure_filter(sets: DataFrame, required: list[str], mode: str = "all") -> DataFrame:
    """Adds n_present, missing and passed. Without required residues nothing passes."""
    need = F.array(*[F.lit(x) for x in required]) if required else F.array().cast("array<string>")
    out = sets.withColumn("n_present", F.size(F.array_intersect("nodes", need))).withColumn("missing", F.array_sort(F.array_except(need, "nodes")))
    if not required:
        return out.withColumn("passed", F.lit(False))
    return out.withColumn("passed", F.col("n_present") == len(required) if mode == "all" else F.col("n_present") > 0)


def contact_sets(structures: DataFrame, near: DataFrame, graph: DataFrame, definition: str, structure: str = "structure_id", node: str = "residue") -> DataFrame:
    """(structure, nodes) of every structure: residues within reach, in the graph, in either or in both, by ``definition``."""
    if definition not in ("distance", "graph", "distance_or_graph", "distance_and_graph"):
        raise ValueError(f"unknown contact definition {definition!r}")
    none = F.array().cast("array<string>")
    n, g = (node_sets(x, structure, node).withColumnRenamed("nodes", c) for x, c in ((near, "__n"), (graph, "__g")))
    out = structures.select(structure).distinct().join(n, structure, "left").join(g, structure, "left")
    n, g = F.coalesce("__n", none), F.coalesce("__g", none)
    nodes = {"distance": n, "graph": g, "distance_or_graph": F.array_sort(F.array_union(n, g)), "distance_and_graph": F.array_sort(F.array_intersect(n, g))}[definition]
    return out.select(structure, nodes.alias("nodes"))


def filter_reason(filtered: DataFrame, required: list[str], mode: str = "all") -> DataFrame:
    """Adds why a structure passed ``structure_filter`` or did not."""
    good, bad = ("all_key_residues_present", "missing_required_key_residues") if mode == "all" else ("at_least_one_key_residue_present", "no_key_residue_present")
    return filtered.withColumn("reason", F.when(F.col("passed"), good).otherwise(bad) if required else F.lit("no_key_residues_selected"))


def first_structures(df: DataFrame, n: int | None, order: str = "input_order") -> DataFrame:
    """The first ``n`` rows of an index by its order, or all: a limit that is asked for."""
    return df.orderBy(order).limit(n) if n else df


def first_seen(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """One row for each key, that of the least ordinal."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min_by(row, ordinal).alias("__r")).select("__r.*")


def coverage(required: DataFrame, present: DataFrame, key: str, minimum: float | None = None) -> DataFrame:
    """(n_required, n_present, coverage); raises when it is below ``minimum``."""
    r = required.select(key).distinct()
    c = r.join(present.select(key).distinct().withColumn("__there", F.lit(1)), key, "left").agg(F.count("*").alias("n_required"), F.count("__there").alias("n_present"))
    c = c.withColumn("coverage", F.when(F.col("n_required") > 0, F.col("n_present") / F.col("n_required")))
    if minimum is not None and ((found := c.first()).coverage is None or found.coverage < minimum):
        raise ValueError(f"coverage {found.coverage} is below {minimum}")
    return c
