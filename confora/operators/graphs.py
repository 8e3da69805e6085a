"""Interaction graphs as tables: blueprint, signatures, classes, labels, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import last_integer, natural_key
from ..sources.shared import deleted, written


def place(structure: str, kind: str = "string") -> list:
    """The order of graphs of one edge count: the last integer of the id, its natural key, the id."""
    sid = F.col(structure)
    return [sid] if kind != "string" else [last_integer(sid), natural_key(sid), sid]


def ordered(df: DataFrame, structure: str) -> list:
    return place(structure, df.schema[structure].dataType.simpleString())


def graph_order(df: DataFrame, structure: str, edge_count: str = "edge_count") -> list:
    """Sort expressions of graphs: most edges first, then ``place``."""
    return [F.desc(edge_count), *ordered(df, structure)]


def blueprint(nodes: DataFrame, order: list, key: str = "node_key") -> DataFrame:
    """Zero-based index of the distinct nodes of all graphs. The node vocabulary, not the graphs, sets its size."""
    return nodes.dropDuplicates([key]).withColumn("global_idx", F.row_number().over(Window.orderBy(*order)) - 1)


def edge_signatures(edges: DataFrame, structure: str, u: str = "u", v: str = "v") -> DataFrame:
    """(structure, signature, edge_count) of simple undirected graphs: repeated contacts are one edge."""
    e = edges.select(structure, F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    sets = e.groupBy(structure).agg(F.array_sort(F.collect_set(F.concat_ws("-", "a", "b"))).alias("s"))
    return sets.select(structure, F.array_join("s", ",").alias("signature"), F.size("s").alias("edge_count"))


def edge_count_blocks(signatures: DataFrame) -> DataFrame:
    """(edge_count, n_graphs, n_signatures): the blocks that classes are made in."""
    each = signatures.groupBy("edge_count", "signature").agg(F.count("*").alias("n"))
    return each.groupBy("edge_count").agg(F.sum("n").alias("n_graphs"), F.count("*").alias("n_signatures"))


def signature_classes(signatures: DataFrame, structure: str) -> DataFrame:
    """Graphs at distance 0: (class_number, signature, edge_count, leader, size), exact where labels are distinct.

    Classes are visited by descending edge count and then by their first member, as sequential
    leader clustering would.
    """
    first = F.min_by(structure, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ordered(signatures, structure))]))
    g = signatures.groupBy("edge_count", "signature").agg(first.alias("leader"), F.count("*").alias("size"))
    return g.withColumn("class_number", F.row_number().over(Window.orderBy(*graph_order(g, "leader"))))  # a row per class


def jaccard_candidates(current: DataFrame, reference: DataFrame, member: str, current_class: str, reference_class: str) -> DataFrame:
    """Class pairs that share members, with shared count and Jaccard index."""
    c, r = current.select(member, current_class).distinct(), reference.select(member, reference_class).distinct()
    shared = c.join(r, member).groupBy(current_class, reference_class).agg(F.count("*").alias("shared"))
    nc, nr = c.groupBy(current_class).agg(F.count("*").alias("n_current")), r.groupBy(reference_class).agg(F.count("*").alias("n_reference"))
    out = shared.join(nc, current_class).join(nr, reference_class)
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_current") + F.col("n_reference") - F.col("shared")))


#: Neighbours from which a node is a hub, whose rows do not meet in one task, and how many hubs are broadcast at most.
HUB, BROADCAST_HUBS = 100_000, 200_000


def with_values(rows: DataFrame, values: DataFrame, key: str, hubs: DataFrame | None) -> DataFrame:
    """``rows`` with the one row of ``values`` for their key. Rows of ``hubs`` stay where they are, and their few values are sent to them."""
    if hubs is None:
        return rows.join(values, key)
    few = F.broadcast(hubs.withColumnRenamed("x", key))
    sent = F.broadcast(values.join(few, key, "left_semi"))  # at most a row for each hub
    return rows.join(few, key, "left_semi").join(sent, key).unionByName(rows.join(few, key, "left_anti").join(values.join(few, key, "left_anti"), key))


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node with an edge to another or itself, the component being the smallest node that edges reach.

    Alternating large-star and small-star rounds. The least neighbour of each node is an aggregation, reduced map-side, and its result goes
    back to the edges by a join. A node with more than ``HUB`` neighbours would have all its edges in one task of that join, so the least neighbours of hubs, of which there are
    at most two for every ``HUB`` edges, are broadcast (if counted to be few enough; else the join's own skew handling is left to it). Every round ends in tables of the shared
    folder, and those before are deleted. Rounds grow with the logarithm of the longest chain; ``max_rounds`` only guards against a bug and raises
    instead of returning a partial answer. Edges with a null end are none.
    """
    given = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull()).distinct()
    given = written(given, "edges")
    e, before = written(given.where("a < b"), "stars"), None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        low = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")), "low")
        *now, n_hubs = low.agg(F.sum("n"), F.sum("h"), F.count_if(F.col("n") > HUB)).first()  # the edges that are left, by number and hash
        if now == before:
            deleted(low)
            break
        before = now
        hubs = low.where(F.col("n") > HUB).select("x") if 0 < n_hubs <= BROADCAST_HUBS else None
        # large-star: neighbours above x are tied to the least of x's neighbourhood
        large = with_values(both.where("y > x"), low.select("x", "m"), "x", hubs).select(F.col("m").alias("a"), F.col("y").alias("b")).where("a < b").distinct()
        # small-star: x and its lower neighbours are tied to the least of them; who has many of these had as many neighbours before
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = with_values(large, least, "b", hubs).select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
        new = written(small.where("a < b").distinct(), "stars")
        deleted(e)
        deleted(low)
        e = new
    else:
        raise RuntimeError("components did not settle")
    tied = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    alone = given.select(F.col("a").alias("node")).distinct().join(tied, "node", "left_anti").select("node", F.col("node").alias("component"))  # roots, and nodes with an edge to themselves only
    return tied.unionByName(alone)
