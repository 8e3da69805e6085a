"""Leader clustering of graphs over one blueprint, in parallel rounds.

Taken one by one in order, a graph joins the first leader below the threshold, or else leads. That is the first
maximal independent set, in this order, of the graph whose links are the pairs below the threshold. Three steps give the same classes without a loop over graphs:

1. Graphs at distance 0. A refinement of labels by neighbours gives each edge set a key that equal graphs share. In rounds, the first graph of each key is
   compared with the others of its key; those that differ go on. One round is the rule, as different graphs rarely share a key.
2. Links between the first graphs of these classes, within an edge count. With a distance of at most T no more than 2T labels
   have other degrees: an edge changes two of them, a relabelled vertex two. So of 2T + 1 groups of labels one has equal degrees in both, and pairs
   meet by group and its degrees, at the first group that they share. Large buckets are cut into tiles, met tile by tile. Pairs with more than 2T changed labels, or
   degrees too far apart, go before the search.
3. Rounds over links alone: a graph whose earlier neighbours are all decided against leads, its neighbours are members.

A pair whose search is given up counts as far apart and is counted in ``n_over_budget``.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import broadcast_if_few, deleted, written
from .edit_distance import BUDGET, EXACT, OVER_BUDGET, degree_bound, searched

#: Members of a bucket that meet in one task.
TILE = 512
#: Leaders of one round are broadcast when they were counted to be at most so many.
BROADCAST_LEADERS = 10_000

def degrees_by_label(labels: dict, edges) -> dict:
    """Sorted degrees of the vertices of each label, without those of no edge."""
    degree: dict = defaultdict(int)
    for e in {frozenset(e) for e in edges}:
        for x in e:
            degree[x] += 1
    out: dict = defaultdict(list)
    for x, n in degree.items():
        out[labels[x]].append(n)
    return {label: sorted(ns) for label, ns in out.items()}


def refined_key(labels: dict, edges) -> str:
    """Equal for graphs at distance 0: the colours of vertices after as many rounds of refinement by neighbours as make a difference."""
    near: dict = {x: [] for e in edges for x in e}
    for e in {frozenset(e) for e in edges}:
        ends = [*e, *e][:2]
        near[ends[0]].append(ends[1])
        near[ends[1]].append(ends[0])
    digest = lambda x: hashlib.blake2b(repr(x).encode(), digest_size=8).hexdigest()
    colour, kinds = {x: digest(labels[x]) for x in near}, 0
    while len(set(colour.values())) > kinds:
        kinds = len(set(colour.values()))
        colour = {x: digest((colour[x], sorted(colour[y] for y in near[x]))) for x in near}
    return digest(sorted(colour.values()))


def group_of(label: str, groups: int) -> int:
    return int.from_bytes(hashlib.blake2b(str(label).encode(), digest_size=4).digest(), "big") % groups


def signed(distinct: DataFrame, labels: dict, most: int) -> DataFrame:
    """Adds key, groups (one string of degrees for each group of labels) and degrees (one string for each label)."""
    groups = 2 * most + 1
    kind = distinct.schema

    def run(batches):
        for b in batches:
            keys, by_group, by_label = [], [], []
            for edges in b.column("edges").to_pylist():
                pairs = [(e["u"], e["v"]) for e in edges]
                found = sorted((str(x), ns) for x, ns in degrees_by_label(labels, pairs).items())
                keys.append(refined_key(labels, pairs))
                by_group.append([repr([x for x in found if group_of(x[0], groups) == g]) for g in range(groups)])
                by_label.append([repr(x) for x in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string()), pa.array(by_group, pa.list_(pa.string())), pa.array(by_label, pa.list_(pa.string()))], [*b.schema.names, "key", "groups", "degrees"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return distinct.mapInArrow(run, f"{schema}, key string, groups array<string>, degrees array<string>")


def compared(pairs: DataFrame, labels: dict, limit: float, budget: int) -> DataFrame:
    """Adds distance and status to rows with edges_a and edges_b, which it drops. Rows are dealt evenly."""
    rest = [f for f in pairs.schema if f.name not in ("edges_a", "edges_b")]

    def run(batches):
        for b in batches:
            values, states = [], []
            for ea, eb in zip(b.column("edges_a").to_pylist(), b.column("edges_b").to_pylist()):
                ea, eb = ([(e["u"], e["v"]) for e in x] for x in (ea, eb))
                if degree_bound(ea, eb) >= limit:
                    found = (math.inf, "beyond", 0)
                else:
                    found = searched(labels, ea, labels, eb, limit, budget)
                values.append(found[0])
                states.append(found[1])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(values, pa.float64()), pa.array(states, pa.string())], [*(f.name for f in rest), "distance", "status"])

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", distance double, status string")


def equal_classes(distinct: DataFrame, labels: dict, budget: int) -> DataFrame:
    """(id, first): for each graph the first one, in order, that it equals up to its labels."""
    key = ["edge_count", "key"]
    left, done = distinct.select(*key, "id", "ord", "edges"), None
    while True:
        lead = left.groupBy(*key).agg(F.min_by(F.struct(F.col("id").alias("first"), F.col("edges").alias("edges_b")), "ord").alias("lead")).select(*key, "lead.*")
        lead = written(lead, "leads")
        pairs = left.join(broadcast_if_few(lead, BROADCAST_LEADERS), key).withColumn("edges_a", F.col("edges"))
        told = written(compared(pairs.repartition("id"), labels, 1, budget), "equal")
        same = F.col("distance") == 0
        found = told.where(same).select("id", "first")
        done = found if done is None else done.unionByName(found)
        left = told.where(~same).select(*key, "id", "ord", "edges")
        if left.isEmpty():
            return done


def tiled_pairs(firsts: DataFrame, most: int) -> DataFrame:
    """Pairs (a before b) of one edge count that share a group's degrees and differ in at most 2 * ``most`` labels, each once."""
    each = firsts.select("*", F.posexplode("groups").alias("group", "is"))
    bucket = ["edge_count", "group", "is"]
    tiles = each.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    each = each.join(tiles, bucket).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    columns = ["id", "ord", "edges", "groups", "degrees"]
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in columns]
    left = each.select(*bucket, *side("a"), F.col("tile").alias("low"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("high"))
    right = each.select(*bucket, *side("b"), F.col("tile").alias("high"), F.explode(F.sequence(F.lit(0), "tile")).alias("low"))
    met = left.join(right, [*bucket, "low", "high"]).where((F.col("low") < F.col("high")) | (F.col("ord_a") < F.col("ord_b")))
    earlier = F.exists(F.arrays_zip(F.slice("groups_a", 1, F.col("group")).alias("x"), F.slice("groups_b", 1, F.col("group")).alias("y")), lambda g: g["x"] == g["y"])
    changed = F.size(F.array_union(F.array_except("degrees_a", "degrees_b"), F.array_except("degrees_b", "degrees_a")))  # a label whose degrees differ is listed once or twice
    met = met.where(~earlier & (changed <= 4 * most))
    swap = F.col("ord_a") > F.col("ord_b")
    return met.select("edge_count", *[F.when(swap, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for c in ("id", "ord", "edges") for s, t in ("ab", "ba")])


def first_independent(links: DataFrame) -> DataFrame:
    """(id, leader, distance): the members among the ends of ``links`` (id_a, ord_a, id_b, distance; a before b), each with its earliest leader. Whoever is no member leads.

    In each round those with no earlier end among the links that are left lead, and the later ends of their links are members.
    """
    left, members = written(links.select("id_a", "id_b"), "links"), None
    while not left.isEmpty():
        leads = left.select("id_a").distinct().join(left.select(F.col("id_b").alias("id_a")).distinct(), "id_a", "left_anti")
        out = written(left.join(leads, "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct(), "members")
        members = out if members is None else members.unionByName(out)
        rest = left
        for end in ("id_a", "id_b"):
            rest = rest.join(out.withColumnRenamed("id", end), end, "left_anti")
        rest = written(rest.select("id_a", "id_b"), "links")
        deleted(left)
        left = rest
    led = links if members is None else links.join(members.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
    first = F.min_by(F.struct(F.col("id_a").alias("leader"), "distance"), "ord_a").alias("first")
    return led.groupBy(F.col("id_b").alias("id")).agg(first).select("id", "first.leader", "first.distance")


def leader_classes(graphs: DataFrame, structure: str, labels: dict, order: list, threshold: float = 1.0, budget: int = BUDGET) -> DataFrame:
    """(structure, leader, distance, edge_count, n_over_budget) of ``graphs`` (structure, edges, edge_count) over a blueprint, vertex to label.

    Graphs below ``threshold`` of their leader are its members; unequal edge counts are infinitely far apart, equal edges always share a leader. ``order`` are sort
    expressions over ``structure``. ``n_over_budget`` counts the searches of a graph's class that were given up.
    """
    most = math.ceil(threshold) - 1
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    distinct = graphs.groupBy("edge_count", "edges").agg(F.min_by(structure, key).alias("id"), F.min(key).alias("ord"))
    distinct = written(signed(distinct, labels, max(most, 0)), "graphs")
    if most < 0:
        classes = distinct.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("n_over_budget"))
    else:
        equal = written(equal_classes(distinct, labels, budget), "classes")
        classes = equal.select("id", F.col("first").alias("leader"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("n_over_budget"))
        if most > 0:
            firsts = distinct.join(equal.where("id = first").select("id"), "id", "left_semi")
            told = written(compared(tiled_pairs(firsts, most).repartition("id_a", "id_b"), labels, threshold, budget), "pairs")
            led = written(first_independent(told.where(F.col("status") == EXACT)), "led")
            given_up = told.where(F.col("status") == OVER_BUDGET).select(F.explode(F.array("id_a", "id_b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n"))
            found = equal.join(led.withColumnRenamed("id", "first"), "first", "left").join(given_up, "first", "left")
            none = F.lit(0).cast("long")
            classes = found.select("id", F.coalesce("leader", "first").alias("leader"), F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("n", none).alias("n_over_budget"))
    by_edges = distinct.select("edge_count", "edges", "id").join(classes, "id").drop("id")
    return graphs.join(by_edges, ["edge_count", "edges"]).select(structure, "leader", "distance", "edge_count", "n_over_budget")
