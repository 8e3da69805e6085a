"""Stages, joins, classes and chemistry over ensembles, as queries on the structures of ``structures`` and on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import chemistry, graphs, interactions, labels, placement, proximity, screening
from ..operators.edit_distance import edit_distances
from ..operators.leaders import leader_classes
from ..operators.superpose import superpose
from ..sources import conservation, pdb, shared
from ..streaming import quality as streaming
from . import workflow
from .catalog import query, r6, t
from .structures import ATOMS, BONDS, HEAVY, LIGAND, bond_lines, every_atom, pick

NUMBER = "regexp_extract(structure_id, '[0-9]+')::BIGINT"
SETTINGS = workflow.Settings(min_global=60.0, max_clashes=2, delta=0.5, region_radius=2.0, min_region_mean=60.0, min_region_p10=52.0, contact_cutoff=3.0, min_frequency=0.001, min_grade=5, min_occurrence=0.001)


def number(column: str = "structure_id"):
    return F.regexp_extract(column, "([0-9]+)", 1).cast("long")


# stages
RADIUS = "CASE element WHEN 'H' THEN 1.20 WHEN 'C' THEN 1.70 WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'P' THEN 1.80 ELSE 1.50 END::DOUBLE"
PAIRS = f"""p AS (SELECT *, {RADIUS} AS r FROM h WHERE record = 'ATOM'), l AS (SELECT *, {RADIUS} AS r FROM h WHERE {LIGAND}),
d AS (SELECT p.structure_id, p.serial AS protein_serial, l.serial AS ligand_serial, p.resname, p.resseq, p.chain, p.icode, p.atom_name, p.b_factor, p.r + l.r - 0.5 AS cutoff,
    (p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z) AS d2 FROM p JOIN l USING (structure_id)), clash AS (SELECT *, sqrt(d2) AS distance, cutoff - sqrt(d2) AS overlap FROM d WHERE sqrt(d2) < cutoff)"""


@query(f"WITH {HEAVY}, {PAIRS} SELECT structure_id, ligand_serial, protein_serial, round(distance, 6) AS distance, row_number() OVER (PARTITION BY structure_id ORDER BY ligand_serial, protein_serial, distance) AS pair_number FROM clash")
def q120_ordered_clashes(spark, d):
    pairs = proximity.ordered_pairs(workflow.clash_verdicts(every_atom(spark, d), SETTINGS)[0])
    return r6(pairs.select("structure_id", "ligand_serial", "protein_serial", "distance", "pair_number"), "distance")


@query(f"""WITH {HEAVY}, {PAIRS} SELECT s.structure_id, coalesce(n, 0) AS clash_count, round(coalesce(o, 0.0), 6) AS overlap_sum, round(m, 6) AS min_clash_distance, coalesce(n, 0) <= 2 AS passed FROM (SELECT DISTINCT structure_id FROM a) s
    LEFT JOIN (SELECT structure_id, count(*) AS n, sum(overlap) AS o, min(distance) AS m FROM clash GROUP BY 1) USING (structure_id)""")
def q121_clash_stage(spark, d):
    return r6(workflow.clash_verdicts(every_atom(spark, d), SETTINGS)[1], "overlap_sum", "min_clash_distance")


REGION = """near AS (SELECT DISTINCT structure_id, chain, resseq, icode FROM d WHERE d2 <= 4), v AS (SELECT p.structure_id, p.chain, p.resseq, p.icode, coalesce(avg(p.b_factor) FILTER (p.atom_name = 'CA'), avg(p.b_factor)) AS v
    FROM p SEMI JOIN near USING (structure_id, chain, resseq, icode) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {HEAVY}, {PAIRS}, {REGION} SELECT structure_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, count(*) AS n_values, avg(v) > 60 AND quantile_cont(v, 0.1) > 52 AS passed FROM v GROUP BY 1")
def q122_region_stage(spark, d):
    return r6(workflow.region_verdicts(every_atom(spark, d), SETTINGS).select("structure_id", "mean", "median", "p10", "n_values", "passed"), "mean", "median", "p10")


CONTACTS = "con AS (SELECT structure_id, resname || resseq || icode AS residue, sqrt(min(d2)) AS distance FROM d GROUP BY 1, 2), edge AS (SELECT structure_id, residue FROM con WHERE distance <= 4), n AS (SELECT count(DISTINCT structure_id) AS total FROM a)"


def contacts(spark, d):
    return workflow.residue_contacts(every_atom(spark, d), SETTINGS)


@query(f"WITH {HEAVY}, {PAIRS}, {CONTACTS} SELECT structure_id, residue, round(distance, 6) AS distance FROM con")
def q123_residue_contacts(spark, d):
    return r6(contacts(spark, d), "distance")


GRADES = "g AS (SELECT ['ALA', 'SER', 'HIS', 'ASP', 'GLY'][s_suppkey % 5 + 1] || (s_suppkey % 50 + 1) AS residue, min(s_nationkey % 9 + 1) AS grade FROM supplier GROUP BY 1)"


def grades(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(pick(["ALA", "SER", "HIS", "ASP", "GLY"], k % 5), (k % 50 + 1).cast("string"))
    return t(spark, d, "supplier").groupBy(name.alias("residue")).agg(F.min(F.col("s_nationkey") % 9 + 1).alias("grade"))


def structure_index(spark, d):
    return every_atom(spark, d).select("structure_id").distinct()


KEYED = f"""f AS (SELECT residue, count(*) AS n_structures, count(*) FILTER (distance <= 3) AS n_within FROM con GROUP BY 1), o AS (SELECT residue, count(*) AS k FROM edge GROUP BY 1),
j AS (SELECT residue, n_structures, n_within / total::DOUBLE AS frequency, k / total::DOUBLE AS occurrence, grade FROM f CROSS JOIN n LEFT JOIN o USING (residue) LEFT JOIN g USING (residue)
    UNION ALL SELECT residue, NULL, NULL, NULL, grade FROM g ANTI JOIN f USING (residue)), keys AS (SELECT *, coalesce(grade >= 5 AND frequency >= 0.001 AND occurrence >= 0.001, false) AS key FROM j)"""


@query(f"WITH {HEAVY}, {PAIRS}, {CONTACTS}, {GRADES}, {KEYED} SELECT residue, n_structures, round(frequency, 9) AS frequency, round(occurrence, 9) AS occurrence, grade, key FROM keys")
def q124_key_stage(spark, d):
    return r6(key_stage(spark, d).select("residue", "n_structures", "frequency", "occurrence", "grade", "key"), "frequency", "occurrence", digits=9)


def key_stage(spark, d):
    c = contacts(spark, d)
    return workflow.key_residues(c, c.where("distance <= 4"), grades(spark, d), structure_index(spark, d), SETTINGS)


REQUIRED = ["ALA21", "ALA41"]


@query(f"""WITH {HEAVY}, {PAIRS}, {CONTACTS}, s AS (SELECT DISTINCT structure_id FROM a), q AS (SELECT s.structure_id, def, res, coalesce(bool_or(CASE def WHEN 'distance' THEN distance <= 3 WHEN 'graph' THEN distance <= 5 AND distance > 1 WHEN 'distance_or_graph' THEN distance <= 5
    ELSE distance <= 3 AND distance > 1 END), false) AS there FROM s CROSS JOIN (SELECT unnest(['distance', 'graph', 'distance_or_graph', 'distance_and_graph']) AS def) CROSS JOIN (SELECT unnest(['ALA21', 'ALA41']) AS res) LEFT JOIN con ON con.structure_id = s.structure_id AND con.residue = res GROUP BY 1, 2, 3)
SELECT structure_id, def AS definition, count(*) FILTER (there) AS n_present, bool_or(there) AS passed, CASE WHEN bool_or(there) THEN 'at_least_one_key_residue_present' ELSE 'no_key_residue_present' END AS reason FROM q GROUP BY 1, 2""")
def q125_contact_definitions(spark, d):
    c, index, out = contacts(spark, d), structure_index(spark, d), None
    for kind in ("distance", "graph", "distance_or_graph", "distance_and_graph"):
        sets = screening.contact_sets(index, c.where("distance <= 3"), c.where("distance <= 5 and distance > 1"), kind)
        rows = screening.filter_reason(screening.structure_filter(sets, REQUIRED, "any"), REQUIRED, "any").select("structure_id", F.lit(kind).alias("definition"), "n_present", "passed", "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {HEAVY}, {PAIRS}, {CONTACTS} SELECT residue, count(*) AS n, string_agg(structure_id, ';' ORDER BY {NUMBER}) AS structures FROM con WHERE distance <= 3 GROUP BY 1")
def q126_residue_details(spark, d):
    out = interactions.residue_details(contacts(spark, d).where("distance <= 3"))
    return out.select("residue", "n", F.array_join("structures", ";").alias("structures"))


@query(f"""WITH {HEAVY}, {PAIRS}, {CONTACTS}, w AS (SELECT count(*) AS need FROM (SELECT DISTINCT structure_id FROM a)), k AS (SELECT structure_id FROM con WHERE residue IN ('ALA21', 'SER2', 'HIS3', 'ASP4') GROUP BY 1)
SELECT structure_id, count(*) AS n_edges FROM edge SEMI JOIN k USING (structure_id) GROUP BY 1""")
def q127_kept_structures(spark, d):
    c = contacts(spark, d)
    kept = workflow.kept_structures(c, ["ALA21", "SER2", "HIS3", "ASP4"], workflow.Settings(required_mode="any")).where("passed")
    return c.where("distance <= 4").join(kept.select("structure_id"), "structure_id", "left_semi").groupBy("structure_id").agg(F.count("*").alias("n_edges"))


GRAPHS = """e AS (SELECT DISTINCT 'run10_model_' || l_orderkey AS structure_id, 'P' || (l_partkey % 2) AS ligand, 'S' || (l_suppkey % 3) AS residue FROM lineitem),
sig AS (SELECT structure_id, string_agg(ligand || '-' || residue, ',' ORDER BY ligand || '-' || residue) AS signature, count(*) AS edge_count, regexp_extract(structure_id, '[0-9]+$')::BIGINT AS n FROM e GROUP BY 1),
cls AS (SELECT signature, edge_count, min(n) AS lead, row_number() OVER (ORDER BY edge_count DESC, min(n)) AS class_number FROM sig GROUP BY 1, 2)"""


def order_graphs(spark, d):
    text = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    return t(spark, d, "lineitem").select(text("run10_model_", F.col("l_orderkey")).alias("structure_id"), text("P", F.col("l_partkey") % 2).alias("ligand"), text("S", F.col("l_suppkey") % 3).alias("residue"), "l_linenumber", "l_returnflag", "l_shipdate")


@query(f"WITH {GRAPHS} SELECT structure_id, class_number, 'run10_model_' || lead AS leader, edge_count FROM sig JOIN cls USING (signature, edge_count)")
def q128_classes(spark, d):
    e = order_graphs(spark, d)
    return workflow.classes(e, e.select("structure_id").distinct())


@query(f"WITH {GRAPHS} SELECT structure_id, class_number, 'run10_model_' || lead AS leader, edge_count FROM sig JOIN cls USING (signature, edge_count)")
def q129_leader_classes(spark, d):
    """The same classes by exact edit distances within blocks of equal edge count: with distinct labels, distance 0 is an equal edge set, and 0.5 asks for that."""
    e = order_graphs(spark, d)
    names = {f"P{i}": f"P{i}" for i in range(2)} | {f"S{i}": f"S{i}" for i in range(3)}
    ends = F.struct(F.least("ligand", "residue").alias("u"), F.greatest("ligand", "residue").alias("v"))
    g = e.groupBy("structure_id").agg(F.array_sort(F.collect_set(ends)).alias("edges")).withColumn("edge_count", F.size("edges"))
    led = leader_classes(g, "structure_id", names, graphs.ordered(g, "structure_id"))
    numbers = led.select("edge_count", "leader").distinct()
    numbers = graphs.blueprint(numbers, graphs.graph_order(numbers, "leader"), "leader").select("leader", (F.col("global_idx") + 1).alias("class_number"))
    return led.join(numbers, "leader").select("structure_id", "class_number", "leader", "edge_count")


#: Distances of all pairs of edge sets that occur, over five vertices of two labels, from all 120 mappings.
DISTANCES = """v AS (SELECT range AS i, CASE WHEN range < 2 THEN 'P' ELSE 'S' END AS label FROM range(5)),
o AS MATERIALIZED (SELECT l_orderkey, list(DISTINCT (l_partkey % 2) * 5 + 2 + l_suppkey % 3) AS given FROM lineitem GROUP BY 1),
s AS MATERIALIZED (SELECT DISTINCT list_sort(given) AS edges FROM o),
perm AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p, ((a.label <> 'P')::INT + (b.label <> 'P')::INT + (c.label <> 'S')::INT + (d.label <> 'S')::INT + (e.label <> 'S')::INT) AS relabelled
    FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
image AS MATERIALIZED (SELECT edges, relabelled, list_transform(edges, lambda x: least(p[x // 5 + 1], p[x % 5 + 1]) * 5 + greatest(p[x // 5 + 1], p[x % 5 + 1])) AS moved FROM s, perm),
dist AS MATERIALIZED (SELECT x.edges AS a, y.edges AS b, min(relabelled + len(x.moved) + len(y.edges) - 2 * len(list_intersect(x.moved, y.edges))) AS n FROM image x, s y GROUP BY 1, 2)"""


def two_label_graphs(spark, d):
    """Order graphs over vertices P0, P1 of label P and S0, S1, S2 of label S."""
    e = order_graphs(spark, d)
    ends = F.struct(F.least("ligand", "residue").alias("u"), F.greatest("ligand", "residue").alias("v"))
    return e.groupBy("structure_id").agg(F.array_sort(F.collect_set(ends)).alias("edges")).withColumn("edge_count", F.size("edges"))


TWO_LABELS = {"P0": "P", "P1": "P", "S0": "S", "S1": "S", "S2": "S"}


@query(f"""WITH {DISTANCES}, p AS (SELECT x.l_orderkey, list_sort(x.given) AS a, list_sort(y.given) AS b FROM o x JOIN o y ON y.l_orderkey = x.l_orderkey + 1),
q AS (SELECT l_orderkey, CASE WHEN p.a = p.b THEN 'exact' WHEN l_orderkey % 10 = 0 THEN 'over_budget' WHEN n < 3 THEN 'exact' ELSE 'beyond' END AS status, n FROM p JOIN dist USING (a, b))
SELECT l_orderkey, status, CASE WHEN status = 'exact' THEN n::DOUBLE END AS distance FROM q""")
def q163_edit_distances(spark, d):
    """The graph of an order against that of the next: 0, 1 and 2, beyond the limit of 3, and pairs without a budget, which are given up."""
    nodes = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("label")) for k, v in TWO_LABELS.items()])
    g = two_label_graphs(spark, d).select(F.regexp_extract("structure_id", "([0-9]+)$", 1).cast("long").alias("l_orderkey"), "edges")
    after = g.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("edges").alias("edges_b"))
    pairs = g.select("l_orderkey", F.col("edges").alias("edges_a")).join(after, "l_orderkey").withColumns({"nodes_a": nodes, "nodes_b": nodes})
    found = edit_distances(pairs.withColumn("budget", F.when(F.col("l_orderkey") % 10 == 0, 0).otherwise(1000)), limit=3)
    return found.select("l_orderkey", "status", F.when(F.col("status") == "exact", F.col("distance")).alias("distance"))


@query(f"""WITH RECURSIVE {DISTANCES}, first AS (SELECT list_sort(given) AS edges, min(l_orderkey) AS lead FROM o GROUP BY 1), block AS (SELECT len(edges) AS edge_count, list(edges ORDER BY lead) AS todo FROM first GROUP BY 1),
near AS MATERIALIZED (SELECT a, list(b) AS others FROM dist WHERE n < 3 GROUP BY 1), step AS (SELECT edge_count, todo, [todo[1]] AS leaders, 2 AS k FROM block
    UNION ALL SELECT edge_count, todo, CASE WHEN len(list_intersect(leaders, others)) > 0 THEN leaders ELSE leaders || [todo[k]] END, k + 1 FROM step JOIN near ON a = todo[k] WHERE k <= len(todo)),
led AS (SELECT edge_count, unnest(leaders) AS leader FROM step WHERE k = len(todo) + 1),
best AS (SELECT f.edges, min(l.lead) AS lead FROM first f JOIN led ON edge_count = len(f.edges) JOIN first l ON l.edges = leader JOIN dist ON a = f.edges AND b = leader AND n < 3 GROUP BY 1)
SELECT 'run10_model_' || l_orderkey AS structure_id, 'run10_model_' || CASE WHEN list_sort(given) IN (SELECT leader FROM led) THEN f.lead ELSE best.lead END AS leader,
    CASE WHEN list_sort(given) IN (SELECT leader FROM led) THEN 0.0 ELSE n END::DOUBLE AS distance, len(given) AS edge_count
FROM o JOIN first f ON f.edges = list_sort(given) JOIN best ON best.edges = f.edges JOIN first l ON l.lead = best.lead JOIN dist ON a = f.edges AND b = l.edges""")
def q164_leader_distances(spark, d):
    """Leaders at a threshold of 3 where labels repeat: members are 0, 1 or 2 edits away from the earliest leader that is near enough."""
    g = two_label_graphs(spark, d)
    return leader_classes(g, "structure_id", TWO_LABELS, graphs.ordered(g, "structure_id"), 3.0).select("structure_id", "leader", "distance", F.col("edge_count").cast("long").alias("edge_count"))


# joins
@query("""WITH good AS (SELECT s_nationkey AS k, n_regionkey AS r, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 6000),
e AS (SELECT k, avg(s_acctbal) AS v FROM good GROUP BY 1), f AS (SELECT r, avg(s_acctbal) AS v FROM good GROUP BY 1)
SELECT c_custkey, round(coalesce(e.v, f.v), 6) AS score, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'chain_insensitive' ELSE 'missing' END AS match_mode
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN e ON c_nationkey = e.k LEFT JOIN f ON n_regionkey = f.r""")
def q10_key_fallback_join(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("base"))
    values = t(spark, d, "supplier").where("s_acctbal > 6000").join(nation, F.col("s_nationkey") == F.col("key")).select("key", "base", F.col("s_acctbal").alias("score"))
    regions = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("key")).select("c_custkey", "key", "base")
    return r6(interactions.scores_with_fallback(regions, values, ["key"], ["base"], "score").select("c_custkey", "score", "match_mode"), "score")


@query(f"""WITH {ATOMS}, l AS (SELECT * FROM a WHERE {LIGAND}), u AS (SELECT structure_id, resname, chain, resseq, min(serial) AS s3 FROM l GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
q AS (SELECT a.k AS contact_id, a.structure_id, CASE WHEN k % 5 = 0 THEN serial END AS s1, CASE WHEN k % 5 = 1 THEN serial END AS s2, a.resname, a.chain, a.resseq, a.x, a.y, a.z, k % 5 AS m, serial AS own FROM l a)
SELECT contact_id, q.structure_id, CASE m WHEN 0 THEN own WHEN 1 THEN own WHEN 2 THEN s3 WHEN 3 THEN own END AS serial, CASE m WHEN 0 THEN 'index' WHEN 1 THEN 'index_list' WHEN 2 THEN CASE WHEN s3 IS NULL THEN 'unresolved' ELSE 'residue' END WHEN 3 THEN 'coordinates' ELSE 'unresolved' END AS resolved_by
FROM q LEFT JOIN u USING (structure_id, resname, chain, resseq)""")
def q131_resolved_contacts(spark, d):
    a = every_atom(spark, d).where(pdb.is_ligand()).withColumn("k", number() * 10 + F.col("line_index"))
    m = F.col("k") % 5
    far = lambda c: F.when(m == 3, F.col(c)).otherwise(-999.0)
    records = a.select(
        "structure_id", F.col("k").alias("contact_id"), F.when(m == 0, F.col("serial")).otherwise(-1).alias("ligand_serial"), F.when(m == 1, F.array(F.lit(-7), "serial")).otherwise(F.array(F.lit(-7))).alias("ligand_serials"),
        F.when(m == 2, F.col("resname")).otherwise("none").alias("resname"), "chain", "resseq", *[far(c).alias(c) for c in "xyz"],
    )
    found = interactions.resolved_contacts(records, a)
    return found.select("contact_id", "structure_id", "serial", "resolved_by")


@query(f"""WITH {HEAVY}, c AS (SELECT structure_id, k AS contact_id, x + 0.25 AS x, y, z, chain, resseq FROM a WHERE record = 'ATOM'),
j AS (SELECT c.structure_id, contact_id, b.atom_name, b.serial, (c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y) + (c.z - b.z) * (c.z - b.z) AS d2 FROM c JOIN (SELECT * FROM a WHERE atom_name NOT LIKE 'H%') b USING (structure_id, chain, resseq))
SELECT structure_id, contact_id, arg_min(atom_name, (d2, serial)) AS atom_name, round(sqrt(min(d2)), 6) AS distance FROM j GROUP BY 1, 2""")
def q132_closest_atoms(spark, d):
    a = every_atom(spark, d)
    points = a.where("record = 'ATOM'").select("structure_id", (number() * 10 + F.col("line_index")).alias("contact_id"), (F.col("x") + 0.25).alias("x"), "y", "z", "chain", "resseq")
    return r6(interactions.closest_atoms(points, a), "distance")


@query("""WITH s AS (SELECT s_suppkey AS k, ['ALA', 'SER', 'HIS', 'ASP'][s_suppkey % 4 + 1] AS resname FROM supplier), t AS (SELECT DISTINCT k + 10 AS n, resname FROM s WHERE k % 3 > 0)
SELECT k AS position, CASE WHEN k % 3 > 0 THEN resname || (k + 10) || 'A' END AS target_key, CASE WHEN k % 3 > 0 THEN 'manual_offset' END AS method, CASE WHEN k % 3 > 0 THEN 'mapped' ELSE 'missing' END AS status FROM s""")
def q36_conservation_mapping(spark, d):
    """A manual offset takes precedence; rows that it does not reach have no chain to be aligned with."""
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").select(k.cast("int").alias("position"), F.lit("X").alias("seq"), pick(["ALA", "SER", "HIS", "ASP"], k % 4).alias("resname"), F.lit("A").alias("chain"), k.cast("int").alias("resseq"), F.lit("").alias("icode"), F.lit(1.0).alias("score"), F.lit(5).alias("grade"))
    s = conservation.keyed(s)
    residues = s.where(F.col("position") % 3 > 0).withColumn("resseq", F.col("resseq") + 10)
    return conservation.mapped(s, conservation.keyed(residues.drop("residue_key")), {"A": 10}).select("position", "target_key", "method", "status")


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) || (c_custkey % 100) AS base FROM customer WHERE c_custkey % 100 IN (SELECT s_suppkey FROM supplier)")
def q134_base_alias(spark, d):
    """Labels of two shapes meet on the residue without its chain."""
    name = F.upper(F.substring("c_mktsegment", 1, 3))
    k = F.col("c_custkey") % 100
    left = t(spark, d, "customer").select("c_custkey", X.residue_base(F.concat(name, k.cast("string"), pick(["A", "B", ""], k % 3))).alias("base"))
    right = t(spark, d, "supplier").select(F.explode(F.array(*[F.concat(F.lit(x), F.col("s_suppkey").cast("string"), F.lit("Z")) for x in ("AUT", "BUI", "FUR", "MAC", "HOU")])).alias("label"))
    right = right.select(X.residue_base(F.col("label")).alias("base")).distinct()
    return left.join(right, "base").select("c_custkey", "base")


# labels
@query("""SELECT 'class_' || n_nationkey AS current_class, 'class_' || (n_nationkey + 100) AS reference_class, 'class_' || (n_nationkey + 100) AS assigned_class, 'exact_member_set' AS match_type, 1.0::DOUBLE AS jaccard, count(*) AS current_size, count(*) AS reference_size
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20 GROUP BY n_nationkey
UNION ALL SELECT 'class_' || n_nationkey, '', 'class_' || (120 + row_number() OVER (ORDER BY n_nationkey) - 1), 'new_class_appended', 0.0, count(*), 0 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey >= 20 GROUP BY n_nationkey
UNION ALL SELECT '', 'class_5', '', 'reference_class_not_present', 0.0, 0, count(*) FROM supplier""")
def q25_stable_labels(spark, d):
    return stable(spark, d)


def stable(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("class_"), F.col("c_nationkey").cast("string")).alias("class"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("structure_id"), "c_nationkey")
    ref = c.where("c_nationkey < 20").select(F.concat(F.lit("class_"), (F.col("c_nationkey") + 100).cast("string")).alias("reference_class"), "structure_id", F.lit("").alias("representative"))
    ref = ref.union(t(spark, d, "supplier").select(F.lit("class_5"), F.concat(F.lit("old"), F.col("s_suppkey").cast("string")), F.lit("")))
    return labels.stable_labels(c, ref)


@query("""SELECT c_custkey, 'class_' || CASE WHEN c_nationkey < 20 THEN c_nationkey + 100 ELSE 120 + k - 1 END AS class FROM customer JOIN (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey >= 20 ORDER BY c_nationkey) AS k FROM (SELECT DISTINCT c_nationkey FROM customer)) USING (c_nationkey)""")
def q136_relabelled(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("class_"), F.col("c_nationkey").cast("string")).alias("class"))
    return labels.relabelled(rows, stable(spark, d))


@query("""WITH x AS (SELECT c_nationkey, c_nationkey % 5 AS ref, count(*) AS n FROM customer GROUP BY 1, 2), sizes AS (SELECT ref, sum(n) AS total, max(n) AS most FROM x GROUP BY 1)
SELECT 'g' || (ref + 10) AS reference_class, match_type, n_matched FROM (SELECT ref, 'member_overlap' AS match_type, 1 AS n_matched FROM sizes)""")
def q137_overlap_labels(spark, d):
    """Five reference classes of five nations each: one of the nations in each keeps the label, by overlap."""
    n = F.col("c_nationkey")
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), n.cast("string")).alias("class"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("structure_id"), n)
    ref = c.select(F.concat(F.lit("g"), (n % 5 + 10).cast("string")).alias("reference_class"), "structure_id", F.lit("").alias("representative"))
    found = labels.stable_labels(c, ref, 0.05).where("match_type = 'member_overlap'")
    return found.groupBy("reference_class", "match_type").agg(F.count("*").alias("n_matched"))


# interaction graphs
@query(f"WITH {ATOMS} SELECT structure_id, serial FROM a WHERE {LIGAND} AND (resname <> 'TMP' OR line_index >= 8)")
def q138_ligand_inventory(spark, d):
    lig = every_atom(spark, d).where(pdb.is_ligand())
    found = interactions.ligand_inventory(lig.where("resname != 'TMP'"), lig.where("line_index >= 8"), "union")
    return found.select("structure_id", "serial")


@query(f"WITH {ATOMS} SELECT structure_id, serial, row_number() OVER (PARTITION BY structure_id ORDER BY resname, chain, resseq, icode, atom_name, serial) AS atom_number FROM a WHERE {LIGAND}")
def q139_ordered_atoms(spark, d):
    return interactions.ordered_atoms(every_atom(spark, d).where(pdb.is_ligand())).select("structure_id", "serial", "atom_number")


#: Bonds by distance among the atoms of ``rest``.
GUESSED = """el(e, r, most) AS (VALUES ('H', 0.31, 1), ('C', 0.76, 4), ('N', 0.71, 4), ('O', 0.66, 2), ('P', 1.07, 5), ('S', 1.05, 6), ('I', 1.39, 3)),
typed AS (SELECT * FROM rest JOIN el ON e = CASE WHEN element <> '' THEN element ELSE substr(atom_name, 1, 1) END),
tried AS (SELECT p.structure_id, p.resname, p.chain, p.resseq, p.serial AS i, q.serial AS j, p.most, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d, p.r + q.r + 0.45 AS reach
    FROM typed p JOIN typed q ON p.structure_id = q.structure_id AND p.resname = q.resname AND p.chain = q.chain AND p.resseq = q.resseq AND p.serial <> q.serial AND NOT (p.e = 'H' AND q.e = 'H')),
placed AS (SELECT *, row_number() OVER (PARTITION BY structure_id, resname, chain, resseq, i ORDER BY d, j) AS place FROM tried WHERE d >= 0.4 AND d <= reach::DOUBLE),
guessed AS (SELECT structure_id, least(i, j) AS u, greatest(i, j) AS v FROM placed WHERE place <= most GROUP BY 1, resname, chain, resseq, 2, 3 HAVING count(*) = 2)"""


@query(f"""WITH {ATOMS}, {BONDS}, l AS (SELECT * FROM a WHERE {LIGAND}), known AS (SELECT b.structure_id, u, v, p.resname, p.chain, p.resseq FROM bonds b JOIN l p ON p.structure_id = b.structure_id AND p.serial = u JOIN l q ON q.structure_id = b.structure_id AND q.serial = v),
rest AS (SELECT * FROM l ANTI JOIN known USING (structure_id, resname, chain, resseq)), {GUESSED}
SELECT structure_id, u, v, 'listed' AS edge_type FROM known UNION ALL SELECT structure_id, u, v, 'distance' FROM guessed""")
def q140_ligand_bonds(spark, d):
    return interactions.ligand_bonds(every_atom(spark, d).where(pdb.is_ligand()), pdb.conect_edges(bond_lines(spark, d)))


#: Pairs of elements some way apart: disulfide, carbon-iodine, phosphate, an amine, and a hydrogen on carbon that an oxygen comes near.
ENDS = [("S", "S", 2.05), ("C", "I", 2.14), ("P", "O", 1.6), ("C", "N", 1.47), ("C", "H", 1.09)]


@query(f"""WITH part_of AS (SELECT 'm' || c_custkey AS structure_id, c_custkey % 5 + 1 AS k, [2.05, 2.14, 1.6, 1.47, 1.09][c_custkey % 5 + 1]::DOUBLE + (c_custkey % 7)::DOUBLE / 8 AS pos FROM customer),
three AS (SELECT structure_id, 1 AS serial, ['S', 'C', 'P', 'C', 'C'][k] AS element, 0.0::DOUBLE AS x FROM part_of UNION ALL SELECT structure_id, 2, ['S', 'I', 'O', 'N', 'H'][k], pos FROM part_of UNION ALL SELECT structure_id, 3, 'O', pos + 1.25 FROM part_of),
rest AS (SELECT structure_id, serial, element, element || serial AS atom_name, 'LIG' AS resname, 'A' AS chain, 1 AS resseq, x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM three), {GUESSED} SELECT structure_id, u, v FROM guessed""")
def q165_guessed_bonds(spark, d):
    """Bonds of element pairs at growing distances, with an oxygen 1.25 beyond the second atom, of which a hydrogen takes only the nearer neighbour."""
    k = (F.col("c_custkey") % 5).cast("int")
    at = pick([e[2] for e in ENDS], k) + (F.col("c_custkey") % 7).cast("double") / 8
    atom = lambda serial, element, x: F.struct(F.lit(serial).alias("serial"), element.alias("element"), x.alias("x"))
    three = F.array(atom(1, pick([e[0] for e in ENDS], k), F.lit(0.0)), atom(2, pick([e[1] for e in ENDS], k), at), atom(3, F.lit("O"), at + 1.25))
    rows = t(spark, d, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("structure_id"), F.explode(three).alias("a")).select("structure_id", "a.*")
    fixed = {"resname": F.lit("LIG"), "chain": F.lit("A"), "resseq": F.lit(1), "y": F.lit(0.0), "z": F.lit(0.0), "atom_name": F.concat("element", F.col("serial").cast("string"))}
    return interactions.ligand_bonds(rows.withColumns(fixed), spark.createDataFrame([], "structure_id string, u int, v int")).select("structure_id", "u", "v")


@query("""WITH e AS (SELECT 'm' || l_orderkey AS structure_id, 'P' || (l_partkey % 2) AS u, 'S' || (l_suppkey % 3) AS v, l_returnflag || l_linestatus AS type, epoch_us(l_shipdate) * 8 + l_linenumber AS o FROM lineitem)
SELECT structure_id, u, v, max(o) AS last FROM e GROUP BY 1, 2, 3""")
def q141_graph_edges(spark, d):
    """Of repeated contacts the last type stands: here the type is the ordinal itself, so that ties have one answer."""
    e = order_graphs(spark, d).select(F.regexp_replace("structure_id", "run10_model_", "m").alias("structure_id"), F.col("residue").alias("u"), F.col("ligand").alias("v"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 8 + F.col("l_linenumber")).alias("ordinal"))
    out = interactions.graph_edges(e.withColumn("type", F.col("ordinal")))
    return out.select("structure_id", "u", "v", F.col("type").alias("last"))


@query("""WITH e AS (SELECT DISTINCT o_custkey, 'N' || (o_orderkey % 7) AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 7) AS first FROM orders) SELECT o_custkey, string_agg(node, ';' ORDER BY first) AS nodes FROM e GROUP BY 1""")
def q142_ordered_nodes(spark, d):
    e = t(spark, d, "orders").select("o_custkey", F.concat(F.lit("N"), (F.col("o_orderkey") % 7).cast("string")).alias("node"), "o_orderkey")
    return interactions.ordered_nodes(e, "o_custkey", "node", "o_orderkey").select("o_custkey", F.array_join("nodes", ";").alias("nodes"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 50, s_suppkey) AS by_number, row_number() OVER (ORDER BY CASE s_suppkey % 50 WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 9 END, s_suppkey) AS by_list FROM supplier""")
def q143_node_order(spark, d):
    from pyspark.sql import Window

    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("ASP"), (F.col("s_suppkey") % 50).cast("string")).alias("base"))
    at = lambda mode, *x: F.row_number().over(Window.orderBy(interactions.node_order(mode, "base", *x), "s_suppkey"))
    return s.select("s_suppkey", at("sequence").alias("by_number"), at("manual", ["ASP7", "ASP3"]).alias("by_list"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q144_first_seen(spark, d):
    return screening.first_seen(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT 'error' AS severity, n_name AS project, CASE WHEN n_nationkey % 3 = 0 THEN 'missing ligands' ELSE 'ligands not found: /nowhere/' || n_nationkey END AS message FROM nation WHERE n_nationkey % 3 < 2")
def q145_preflight(spark, d):
    path = shared.put(spark, f"{shared.new_path(spark, 'there')}.pdb", b"x")
    k = F.col("n_nationkey")
    ligands = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("/nowhere/"), k.cast("string"))).otherwise(path)
    return workflow.preflight(spark, t(spark, d, "nation").select(F.col("n_name").alias("project"), F.lit(path).alias("models"), F.lit(path).alias("template"), ligands.alias("ligands")))


# superposition and placement
@query("""WITH p AS (SELECT vec_id % 20 AS g, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z FROM embeddings)
SELECT g AS structure_id, count(*) AS n_matched, round(sqrt(avg((x + y + 1) * (x + y + 1) + (y - x - 2) * (y - x - 2) + 9)), 6) AS rmsd_before, 0.0::DOUBLE AS rmsd_after FROM p GROUP BY 1""")
def q42_superpose_rmsd(spark, d):
    """A quarter turn about z and a shift are found again."""
    p = t(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("structure_id"), *[(F.col("embedding")[i].cast("double") * 20).alias(c) for i, c in enumerate("xyz")])
    turned = p.select("vec_id", "structure_id", (-F.col("y") - 1).alias("x"), (F.col("x") + 2).alias("y"), (F.col("z") + 3).alias("z"))
    out = superpose(p, turned, ["structure_id"], ["vec_id"]).select("structure_id", "n_matched", "rmsd_before", "rmsd_after")
    return r6(out, "rmsd_before", "rmsd_after").withColumn("rmsd_after", F.abs("rmsd_after"))


PLACED = "l AS (SELECT s_suppkey AS k, s_nationkey % 3 + 1 AS g, (s_suppkey * 0.5)::DOUBLE AS x, (s_suppkey * 0.25)::DOUBLE AS y FROM supplier)"


def jobs(spark, d):
    s = t(spark, d, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("structure_id"), F.col("n_nationkey").cast("double").alias("k"))
    turn = F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0)])
    transforms = s.select("structure_id", turn.alias("rotation"), F.array("k", F.lit(0.0), F.lit(5.0)).alias("translation"))
    protein = s.select("structure_id", F.lit(-500.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    k = F.col("s_suppkey")
    lig = t(spark, d, "supplier").select((F.col("s_nationkey") % 3 + 1).cast("int").alias("group_index"), k.cast("int").alias("atom_index"), (k * 0.5).alias("x"), (k * 0.25).alias("y"), F.lit(0.0).alias("z"))
    return transforms, protein, lig.where(k <= 60)  # a template's ligands do not grow with the ensemble


@query(f"WITH {PLACED} SELECT 'm' || n_nationkey AS structure_id, g AS group_index, k AS atom_index, round(n_nationkey - y, 6) AS x, round(x, 6) AS y, 5.0::DOUBLE AS z FROM nation CROSS JOIN l WHERE k <= 60")
def q147_placed_atoms(spark, d):
    return r6(placement.placed(*jobs(spark, d), avoid=False)[0], "x", "y", "z")


@query(f"WITH {PLACED} SELECT 'm' || n_nationkey AS structure_id, min(g) AS group_index, count(*) AS n_atoms, 0 AS clashes_before, 0 AS n_attempts, true AS clear FROM nation CROSS JOIN l WHERE k <= 60 GROUP BY n_nationkey")
def q148_placement_audit(spark, d):
    transforms, protein, lig = jobs(spark, d)
    audit = placement.placed(transforms, protein, lig, assembly=True)[2]
    return audit.select("structure_id", "group_index", "n_atoms", "clashes_before", "n_attempts", "clear")


@query("SELECT 'm' || n_nationkey AS structure_id, 1 AS clashes_before, 0 AS clashes_after, true AS clear, true AS within_reach FROM nation")
def q149_clash_relief(spark, d):
    """One atom that overlaps one obstacle is moved clear of it, within five units and without a random choice."""
    transforms, _, _ = jobs(spark, d)
    k = F.regexp_extract("structure_id", "([0-9]+)", 1).cast("double")
    protein = transforms.select("structure_id", (k + 0.25 + k / 50).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("z"))
    lig = spark.range(1).select(F.lit(1).alias("group_index"), F.lit(1).alias("atom_index"), *[F.lit(0.0).alias(c) for c in "xyz"])
    audit = placement.placed(transforms, protein, lig)[2]
    return audit.select("structure_id", "clashes_before", "clashes_after", "clear", ((F.col("shift") > 0) & (F.col("shift") <= 5)).alias("within_reach"))


#: Two ligands of two atoms, one above the other, and a sheet of protein atoms below them that every other structure has.
CROWD = """s AS (SELECT s_suppkey AS k, (s_suppkey % 7)::DOUBLE / 20 AS dx FROM supplier), lig(g, i, x, y, z) AS (VALUES (1, 1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 2, 1.5, 0.0, 0.0), (2, 1, 0.5, 0.3, 1.0), (2, 2, 2.0, 0.3, 1.0)),
sheet AS (SELECT k, a.range - 2.0::DOUBLE AS x, b.range - 2.0::DOUBLE AS y, CASE WHEN k % 2 = 0 THEN -1.2 ELSE -50.0 END::DOUBLE AS z FROM s, range(6) a, range(6) b),
atom AS (SELECT k, g, i, x + dx AS x, y, z FROM s, lig), other AS (SELECT k, 0 AS g, x, y, z FROM sheet UNION ALL SELECT k, g, x, y, z FROM atom WHERE g = 1)"""


@query(f"""WITH {CROWD}, n AS (SELECT a.k, a.g, count(o.k) AS n FROM atom a LEFT JOIN other o ON o.k = a.k AND o.g < a.g AND (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) + (a.z - o.z) * (a.z - o.z) < 4 GROUP BY 1, 2)
SELECT k AS structure_id, g AS group_index, CASE WHEN k % 2 = 1 OR g = 1 THEN n END AS clashes_before, 0 AS clashes_after, 1.5::DOUBLE AS length, k % 2 = 0 OR g = 2 AS moved FROM n""")
def q167_crowded_placement(spark, d):
    """Groups that meet the protein and each other. What is left is counted on the atoms that come out, not taken from the audit; where the first group had to move, the second one's start depends on it and is not compared."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("structure_id"), ((F.col("s_suppkey") % 7) / 20).alias("dx"))
    turn = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    name = F.col("structure_id").cast("string").alias("structure_id")
    transforms = s.select(name, turn.alias("rotation"), F.array("dx", F.lit(0.0), F.lit(0.0)).alias("translation"))
    grid = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(a - 2.0).alias("x"), F.lit(b - 2.0).alias("y")) for b in range(6)]) for a in range(6)])))
    protein = s.select(name, grid.alias("p"), F.when(F.col("structure_id") % 2 == 0, -1.2).otherwise(-50.0).alias("z")).select("structure_id", "p.x", "p.y", "z")
    lig = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 1.5, 0.0, 0.0), (2, 1, 0.5, 0.3, 1.0), (2, 2, 2.0, 0.3, 1.0)], "group_index int, atom_index int, x double, y double, z double")
    atoms, _, audit = placement.placed(transforms, protein, lig)
    there = protein.select("structure_id", F.lit(0).alias("group_index"), "x", "y", "z").unionByName(atoms.select("structure_id", "group_index", "x", "y", "z"))
    met = proximity.voxel_join(atoms.select("structure_id", "group_index", "x", "y", "z"), there, 2.0, ["structure_id"]).where("r.group_index < l.group_index and d2 < 4 - 1e-9")
    left = met.groupBy(F.col("l.structure_id").alias("structure_id"), F.col("l.group_index").alias("group_index")).agg(F.count("*").alias("n"))
    first, second = (atoms.where(F.col("atom_index") == i).select("structure_id", "group_index", *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i in (1, 2))
    length = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))
    out = audit.join(left, ["structure_id", "group_index"], "left").join(first.join(second, ["structure_id", "group_index"]), ["structure_id", "group_index"])
    known = (F.col("structure_id").cast("long") % 2 == 1) | (F.col("group_index") == 1)
    return out.select(F.col("structure_id").cast("long").alias("structure_id"), "group_index", F.when(known, F.col("clashes_before")).alias("clashes_before"), F.coalesce("n", F.lit(0)).cast("int").alias("clashes_after"), F.round(length, 6).alias("length"), (F.col("shift") > 0).alias("moved"))


@query("""WITH p AS (SELECT vec_id, vec_id % 20 AS g, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[4]::DOUBLE AS ex, embedding[5]::DOUBLE AS ey FROM embeddings),
m AS (SELECT vec_id, g, x, y, CASE WHEN g % 2 = 1 THEN -1 ELSE 1 END * (x * cos(0.7) - y * sin(0.7)) + ex + 3 AS u, x * sin(0.7) + y * cos(0.7) + ey - 4 AS v FROM p),
c AS (SELECT g, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, u - avg(u) OVER w AS u, v - avg(v) OVER w AS v FROM m WINDOW w AS (PARTITION BY g)),
h AS (SELECT g, count(*) AS n, sum(x * x + y * y + u * u + v * v) AS e, sum(x * u) AS a, sum(x * v) AS b, sum(y * u) AS c, sum(y * v) AS d FROM c GROUP BY 1)
SELECT g AS structure_id, n AS n_matched, round(sqrt(greatest(0, e - 2 * sqrt(a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c))) / n), 6) AS rmsd_after FROM h""")
def q168_noisy_superposition(spark, d):
    """Points of a plane turned by 0.7, with noise, every other structure mirrored: the best fit in closed form from the two singular values of the covariance."""
    e = lambda i: F.col("embedding")[i].cast("double")
    p = t(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("structure_id"), (e(0) * 20).alias("x"), (e(1) * 20).alias("y"), F.lit(0.0).alias("z"), e(3).alias("ex"), e(4).alias("ey"))
    side = F.when(F.col("structure_id") % 2 == 1, -1).otherwise(1)
    turned = p.select("vec_id", "structure_id", (side * (F.col("x") * F.cos(F.lit(0.7)) - F.col("y") * F.sin(F.lit(0.7))) + F.col("ex") + 3).alias("x"), (F.col("x") * F.sin(F.lit(0.7)) + F.col("y") * F.cos(F.lit(0.7)) + F.col("ey") - 4).alias("y"), "z")
    return r6(superpose(p.drop("ex", "ey"), turned, ["structure_id"], ["vec_id"]).select("structure_id", "n_matched", "rmsd_after"), "rmsd_after")


# chemistry: every nation is a structure with an acetate, a zinc ion and a sulfate
SHAPE = [("ACT", "A", 1, "CH3", "C", -1.5, 0.0), ("ACT", "A", 1, "C", "C", 0.0, 0.0), ("ACT", "A", 1, "O", "O", 0.7, 1.1), ("ACT", "A", 1, "OXT", "O", 0.7, -1.1), ("ACT", "A", 1, "H1", "H", -1.9, 0.9), ("ION", "B", 2, "ZN", "ZN", 9.0, 9.0),
         ("SO4", "C", 3, "S", "S", 20.0, 0.0), ("SO4", "C", 3, "OA", "O", 21.4, 0.0), ("SO4", "C", 3, "OB", "O", 18.6, 0.0), ("SO4", "C", 3, "OC", "O", 20.0, 1.4)]
UNITS = """unit(resname, chain, resseq, atom_name, unit, rule) AS (VALUES ('ACT', 'A', 1, 'CH3', 'ACT aliphatic carbon unit', 'aliphatic_carbon'), ('ACT', 'A', 1, 'C', 'ACT aliphatic carbon unit', 'aliphatic_carbon'), ('ACT', 'A', 1, 'O', 'ACT carboxylate oxygen unit', 'carboxylate_oxygen'),
    ('ACT', 'A', 1, 'OXT', 'ACT carboxylate oxygen unit', 'carboxylate_oxygen'), ('ION', 'B', 2, 'ZN', 'Zn2+ ion', 'metal_ion'), ('SO4', 'C', 3, 'S', 'SO4 S site', 'individual_atom'), ('SO4', 'C', 3, 'OA', 'SO4 sulfate/sulfonate oxygen unit', 'sulfate_sulfonate_oxygen'),
    ('SO4', 'C', 3, 'OB', 'SO4 sulfate/sulfonate oxygen unit', 'sulfate_sulfonate_oxygen'), ('SO4', 'C', 3, 'OC', 'SO4 sulfate/sulfonate oxygen unit', 'sulfate_sulfonate_oxygen'))"""


def ligand_atoms(spark, d):
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("resname", "chain", "resseq", "atom_name", "element", "x", "y"), s, strict=True)], F.lit(i).alias("serial")) for i, s in enumerate(SHAPE, 1)])
    sid = F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))
    return t(spark, d, "nation").select(sid.alias("structure_id"), "n_nationkey", F.explode(rows).alias("r")).select("structure_id", "n_nationkey", "r.*", F.lit(0.0).alias("z"))


def units(spark, d):
    atoms = ligand_atoms(spark, d)
    listed = spark.createDataFrame([(7, 8), (7, 9), (7, 10)], "u int, v int")
    bonds = atoms.select("structure_id").distinct().crossJoin(F.broadcast(listed))  # three bonds
    return chemistry.contact_units(atoms.where("not (resname = 'SO4' and n_nationkey % 5 = 0)"), bonds)


@query(f"WITH {UNITS} SELECT 'm' || n_nationkey AS structure_id, resname, atom_name, unit, rule, CASE resname WHEN 'ACT' THEN 'local_geometry_covalent_cutoff' ELSE 'listed_bonds' END AS evidence FROM nation CROSS JOIN unit WHERE NOT (resname = 'SO4' AND n_nationkey % 5 = 0)")
def q150_contact_units(spark, d):
    return units(spark, d).select("structure_id", "resname", "atom_name", "unit", "rule", "evidence")


@query(f"""WITH {UNITS} SELECT resname, atom_name, CASE WHEN resname = 'SO4' THEN atom_name || ' site' ELSE unit END AS unit, CASE WHEN resname = 'SO4' THEN 0.8 ELSE 1.0 END::DOUBLE AS support, CASE WHEN resname = 'SO4' THEN 'below_consensus' ELSE 'apply' END AS decision FROM unit""")
def q151_consensus_units(spark, d):
    return chemistry.consensus_units(units(spark, d), 0.81).select("resname", "atom_name", "unit", F.round("support", 9).alias("support"), "decision")


@query("""SELECT * FROM (VALUES ('ACT_CARBOXYLATE_OXYGEN_O_OXT', 'accepted', 'O;OXT', 1.0::DOUBLE), ('ACT_ALIPHATIC_CARBON_C_CH3', 'proposed', 'C;CH3', 1.0), ('ION_METAL_ION_ZN', 'rejected', 'ZN', 1.0), ('SO4_SULFATE_SULFONATE_OXYGEN_OA_OB_OC', 'proposed', 'OA;OB;OC', 0.8)) v(proposal_id, status, atoms, support)
UNION ALL SELECT 'NONE_SUCH', 'accepted without a proposal', NULL, NULL""")
def q152_proposals(spark, d):
    rows, unmatched = chemistry.accepted_units(chemistry.proposals(units(spark, d), 0.7), ["ACT_CARBOXYLATE_OXYGEN_O_OXT", "NONE_SUCH", "ION_METAL_ION_ZN"], ["ION_METAL_ION_ZN"])
    rows = rows.select("proposal_id", "status", "atoms", F.round("support", 9).alias("support"))
    return rows.unionByName(unmatched.select("proposal_id", F.concat("asked", F.lit(" without a proposal")).alias("status")), allowMissingColumns=True)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'manual unit' WHEN p_partkey % 3 = 0 THEN 'universal unit' ELSE 'LIG_1_A' || p_partkey END AS unit, CASE WHEN p_partkey % 2 = 0 THEN 'manual' WHEN p_partkey % 3 = 0 THEN 'universal' ELSE 'unmapped' END AS unit_source FROM part""")
def q153_layered_units(spark, d):
    k = F.col("p_partkey")
    atoms = t(spark, d, "part").select("p_partkey", F.concat(F.lit("LIG:1:A"), k.cast("string")).alias("atom_key"))
    layers = [("manual", atoms.where(k % 2 == 0).withColumn("unit", F.lit("manual unit"))), ("universal", atoms.where(k % 3 == 0).withColumn("unit", F.lit("universal unit")))]
    return chemistry.layered_units(atoms, layers).select("p_partkey", "unit", "unit_source")


@query("SELECT * FROM (VALUES ('ACT', 25::BIGINT, 'C;CH3;O;OXT', 'C;O', 'CC(=O)[O-]', 'not_validated'), ('ION', 25, 'ZN', 'ZN', NULL, 'not_given'), ('SO4', 25, 'OA;OB;OC;S', 'O;S', NULL, 'not_given')) v(resname, n_structures, atom_names, elements, smiles, smiles_status)")
def q154_substrate_inventory(spark, d):
    return chemistry.substrate_inventory(ligand_atoms(spark, d), {"ACT": "CC(=O)[O-]"})


TYPE = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Polar contact' WHEN 'RF' THEN 'Hydrophobic contact' WHEN 'NO' THEN 'Pi interaction' WHEN 'NF' THEN 'Metal coordination' ELSE 'Other' END"
CANON = f"""c AS (SELECT DISTINCT 'm' || l_orderkey AS structure_id, CASE WHEN l_partkey % 4 = 3 THEN 'P3' ELSE 'unit ' || (l_partkey % 4 % 2) END || ' | ' || {TYPE} || ' | S' || (l_suppkey % 2) AS edge, l_orderkey FROM lineitem),
cl AS (SELECT DISTINCT 'm' || l_orderkey AS structure_id, 'class_' || (l_orderkey % 9 + 1) AS class, l_orderkey FROM lineitem)"""


def canonical(spark, d):
    kinds = {"AF": "hbond", "RF": "hydrophobic_interaction", "NO": "pi-stacking", "NF": "metal"}
    text = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    li = t(spark, d, "lineitem")
    rows = li.select(text("m", F.col("l_orderkey")).alias("structure_id"), text("P", F.col("l_partkey") % 4).alias("atom_key"), F.element_at(X.literal_map(kinds), F.concat("l_returnflag", "l_linestatus")).alias("type"), text("S", F.col("l_suppkey") % 2).alias("residue"))
    known = spark.createDataFrame([("P0", "unit 0"), ("P1", "unit 1"), ("P2", "unit 0")], "atom_key string, unit string")
    return chemistry.canonical_edges(rows, known)


def old_classes(spark, d):
    k = F.col("l_orderkey")
    return t(spark, d, "lineitem").select(F.concat(F.lit("m"), k.cast("string")).alias("structure_id"), F.concat(F.lit("class_"), (k % 9 + 1).cast("string")).alias("class")).distinct()


@query(f"WITH {CANON} SELECT structure_id, edge FROM c")
def q155_canonical_edges(spark, d):
    return canonical(spark, d)


@query(f"WITH {CANON}, n AS (SELECT count(DISTINCT structure_id) AS total FROM c) SELECT edge, count(*) AS n, round(count(*) / any_value(total)::DOUBLE, 9) AS frequency, CASE WHEN count(*) / any_value(total)::DOUBLE >= 0.2 THEN 'common' WHEN count(*) / any_value(total)::DOUBLE <= 0.1 THEN 'rare' ELSE 'other' END AS category FROM c CROSS JOIN n GROUP BY 1")
def q27_common_rare(spark, d):
    c = shared.written(canonical(spark, d), "edges")
    return r6(chemistry.edge_frequencies(c, c, 0.2, 0.1).select("edge", "n", "frequency", "category"), "frequency", digits=9)


SIGNED = """sets AS (SELECT class, cl.structure_id, cl.l_orderkey, string_agg(edge, '; ' ORDER BY edge) AS sig FROM cl JOIN c USING (structure_id) GROUP BY 1, 2, 3),
most AS (SELECT class, arg_min(sig, (-n, sig)) AS signature FROM (SELECT class, sig, count(*) AS n FROM sets GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {CANON}, {SIGNED} SELECT * FROM most")
def q157_class_signatures(spark, d):
    return chemistry.class_signatures(canonical(spark, d), old_classes(spark, d))


@query(f"""WITH {CANON}, size AS (SELECT class, count(*) AS n FROM cl GROUP BY 1), inside AS (SELECT class, edge, count(*) AS k FROM cl JOIN c USING (structure_id) GROUP BY 1, 2)
SELECT class, coalesce(string_agg(edge, '; ' ORDER BY edge) FILTER (k = n), '') AS signature FROM size LEFT JOIN inside USING (class) GROUP BY 1""")
def q158_shared_signatures(spark, d):
    return chemistry.class_signatures(canonical(spark, d), old_classes(spark, d), "intersection")


@query(f"""WITH {CANON}, {SIGNED}, m AS (SELECT structure_id, class, signature FROM cl JOIN most USING (class)), g AS (SELECT signature, row_number() OVER (ORDER BY count(*) DESC, signature) AS k FROM m GROUP BY 1)
SELECT structure_id, class, 'class_' || k AS merged_class FROM m JOIN g USING (signature)""")
def q29_merged_classes(spark, d):
    classes = old_classes(spark, d)
    return chemistry.merged_classes(chemistry.class_signatures(canonical(spark, d), classes), classes).select("structure_id", "class", "merged_class")


@query(f"""WITH {CANON}, {SIGNED}, g AS (SELECT class, sig, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, sig) AS k, count(*) OVER (PARTITION BY class) AS many FROM sets GROUP BY 1, 2)
SELECT structure_id, class, CASE WHEN many > 1 THEN class || '.' || k ELSE class END AS split FROM sets JOIN g USING (class, sig)""")
def q160_split_classes(spark, d):
    return chemistry.split_classes(canonical(spark, d), old_classes(spark, d))


CANDIDATES = """f AS (SELECT edge, CASE WHEN count(*) / (SELECT count(DISTINCT structure_id) FROM c)::DOUBLE >= 0.25 THEN 'common' WHEN count(*) / (SELECT count(DISTINCT structure_id) FROM c)::DOUBLE <= 0.02 THEN 'rare' ELSE 'other' END AS category FROM c GROUP BY 1),
ce AS (SELECT DISTINCT class, edge FROM cl JOIN c USING (structure_id) WHERE cl.l_orderkey % 3 = 0), v AS (SELECT class, (SELECT count(*) FROM f WHERE category = 'common') - count(*) FILTER (category = 'common') AS n_common_edges_missing, count(*) FILTER (category = 'rare') AS n_rare_edges_present
    FROM (SELECT DISTINCT class FROM cl) LEFT JOIN (SELECT * FROM ce JOIN f USING (edge)) USING (class) GROUP BY 1)"""


def class_verdicts(spark, d):
    c, classes = shared.written(canonical(spark, d), "edges"), old_classes(spark, d)
    edges = classes.join(c, "structure_id").where(number() % 3 == 0).select("class", "edge").distinct()
    return chemistry.candidates(edges, chemistry.edge_frequencies(c, c, 0.25, 0.02), classes)


@query(f"WITH {CANON}, {CANDIDATES} SELECT *, n_common_edges_missing = 0 AND n_rare_edges_present = 0 AS is_candidate FROM v")
def q28_candidate_classes(spark, d):
    return class_verdicts(spark, d)


@query(f"""WITH {CANON}, {CANDIDATES} SELECT class AS merged_class, replace(class, 'class_', 'Class ') AS label, 'm' || min(l_orderkey) AS representative, count(*) AS n_structures, md5(string_agg(structure_id, ';' ORDER BY l_orderkey)) AS ids_md5,
    any_value(n_common_edges_missing = 0 AND n_rare_edges_present = 0) AS is_candidate, 'p/m' || min(l_orderkey) AS representative_path FROM cl JOIN v USING (class) GROUP BY 1""")
def q162_class_visuals(spark, d):
    merged = old_classes(spark, d).withColumnRenamed("class", "merged_class")
    paths = merged.select("structure_id", F.concat(F.lit("p/"), "structure_id").alias("path"))
    out = chemistry.class_visuals(merged, class_verdicts(spark, d), paths)
    return out.withColumn("ids_md5", F.md5("structure_ids")).drop("structure_ids")


@query("""WITH n AS (SELECT p_partkey AS node, 's' || (p_partkey // 20) AS structure_id, p_partkey // 4 AS component FROM part), b AS (SELECT node FROM n WHERE node % 4 IN (0, 1) OR node % 7 = 0)
SELECT structure_id, count(*) FILTER (node % 2 = 0 AND node NOT IN (SELECT node FROM b) AND k > 1) AS n_unattached, CASE WHEN count(*) FILTER (node % 2 = 0 AND node NOT IN (SELECT node FROM b) AND k > 1) > 0 THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT *, count(*) OVER (PARTITION BY structure_id, component) AS k FROM n) GROUP BY 1""")
def q39_topology_audit(spark, d):
    k = F.col("p_partkey")
    n = t(spark, d, "part").select(k.alias("node"), F.concat(F.lit("s"), F.floor(k / 20).cast("string")).alias("structure_id"), F.floor(k / 4).alias("component"))
    bonds = n.where((F.col("node") % 4).isin(0, 1) | (F.col("node") % 7 == 0)).select("structure_id", F.col("node").alias("u"), F.col("node").alias("v"))
    return chemistry.topology_audit(n, bonds, n.where(F.col("node") % 2 == 0))


# streams: the same plans as batches
@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q45_tumbling(spark, d):
    return streaming.windowed(t(spark, d, "events"), "1 day", by=("event_type",)).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q45_session(spark, d):
    return streaming.sessions(t(spark, d, "events"), "4 hours").select("user_id", "start", "n")


#: Molecules by their bonds, and the units of their atoms by rule: all twelve rules occur.
MOLECULES = {
    "SUC": "OA-CA OB-CA CA-CB CB-CC CC-CD CD-OC CD-OD", "TRI": "PX-OXA PX-OXB PX-OXY PY-OXY PY-OYA PY-OYZ PZ-OYZ PZ-OZA PZ-OZB", "MSO": "CM-SM SM-OM SM-ON SM-OP", "DMS": "CP-SP CQ-SP SP-OQ SP-OR",
    "NET": "CE-CF CF-NE NE-OE NE-OF", "GUM": "CG-NG CG-NH CG-NI NI-CH", "RPY": "NA-CA CA-CB CB-CC CC-CD CD-CE CE-NA", "FUR": "OQ-CQ CQ-CR CR-CS CS-CT CT-OQ CR-OR CS-OS", "HEX": "CA-CB CB-CC CC-CD CD-CE CE-CF",
    "ZNC": "ZN", "AMM": "NZ",
}
MOLECULE_UNITS = """unit(resname, atoms, unit, rule) AS (VALUES
('SUC', 'OA OB', 'SUC carboxylate oxygen 1 unit', 'carboxylate_oxygen'), ('SUC', 'OC OD', 'SUC carboxylate oxygen 2 unit', 'carboxylate_oxygen'), ('SUC', 'CA CB CC CD', 'SUC aliphatic carbon unit', 'aliphatic_carbon'),
('TRI', 'PX OXA OXB', 'TRI phosphate 1 unit', 'phosphate'), ('TRI', 'PY OYA', 'TRI phosphate 2 unit', 'phosphate'), ('TRI', 'PZ OZA OZB', 'TRI phosphate 3 unit', 'phosphate'),
('TRI', 'OXY', 'TRI phosphate 1–2 bridging oxygen', 'phosphate_bridging_oxygen'), ('TRI', 'OYZ', 'TRI phosphate 2–3 bridging oxygen', 'phosphate_bridging_oxygen'),
('MSO', 'OM ON OP', 'MSO sulfate/sulfonate oxygen unit', 'sulfate_sulfonate_oxygen'), ('MSO', 'CM', 'MSO CM site', 'individual_atom'), ('MSO', 'SM', 'MSO SM site', 'individual_atom'),
('DMS', 'OQ OR', 'DMS sulfonyl oxygen unit', 'sulfonyl_oxygen'), ('DMS', 'CP', 'DMS CP site', 'individual_atom'), ('DMS', 'CQ', 'DMS CQ site', 'individual_atom'), ('DMS', 'SP', 'DMS SP site', 'individual_atom'),
('NET', 'OE OF', 'NET nitro oxygen unit', 'nitro_oxygen'), ('NET', 'CE CF', 'NET aliphatic carbon unit', 'aliphatic_carbon'), ('NET', 'NE', 'NET NE site', 'individual_atom'),
('GUM', 'NG NH', 'GUM delocalized nitrogen unit', 'delocalized_nitrogen'), ('GUM', 'CG', 'GUM CG site', 'individual_atom'), ('GUM', 'NI', 'GUM NI site', 'individual_atom'), ('GUM', 'CH', 'GUM CH site', 'individual_atom'),
('RPY', 'CA CB CC CD CE', 'RPY aromatic ring unit', 'aromatic_ring'), ('RPY', 'NA', 'RPY NA site', 'individual_atom'),
('FUR', 'CQ CR CS CT', 'FUR sugar-ring carbon unit', 'sugar_ring_carbon'), ('FUR', 'OQ', 'FUR OQ site', 'individual_atom'), ('FUR', 'OR', 'FUR OR site', 'individual_atom'), ('FUR', 'OS', 'FUR OS site', 'individual_atom'),
('HEX', 'CA CB CC CD CE CF', 'HEX aliphatic carbon unit', 'aliphatic_carbon'), ('ZNC', 'ZN', 'Zn2+ ion', 'metal_ion'), ('AMM', 'NZ', 'AMM NZ site', 'individual_atom'))"""


@query(f"""WITH {MOLECULE_UNITS}, a AS (SELECT resname, unnest(string_split(atoms, ' ')) AS atom_name, unit, rule FROM unit)
SELECT s_suppkey AS structure_id, resname, atom_name, unit, rule FROM supplier CROSS JOIN a WHERE resname <> {list(MOLECULES)}[s_suppkey % {len(MOLECULES)} + 1]""")
def q169_unit_rules(spark, d):
    """Eleven molecules of which each structure lacks one: units by all twelve rules, from listed bonds."""
    atoms, bonds, serial = [], [], 0
    for k, (resname, text) in enumerate(MOLECULES.items()):
        pairs = [p.split("-") for p in text.split()]
        number = {n: serial + i for i, n in enumerate(dict.fromkeys(n for p in pairs for n in p), 1)}
        serial += len(number)
        atoms += [(k, resname, "A", k + 1, n, "ZN" if n == "ZN" else n[0], i, 9.0 * i, 0.5 * i * i) for n, i in number.items()]
        bonds += [(k, number[p[0]], number[p[1]]) for p in pairs if len(p) == 2]
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("structure_id"), (F.col("s_suppkey") % len(MOLECULES)).alias("lacks"))
    here = lambda rows, schema: s.join(F.broadcast(spark.createDataFrame(rows, schema)), F.col("k") != F.col("lacks")).withColumn("structure_id", F.col("structure_id").cast("string"))  # noqa: E731  eleven molecules
    a = here(atoms, "k int, resname string, chain string, resseq int, atom_name string, element string, serial int, x double, y double").withColumn("z", F.lit(0.0))
    found = chemistry.contact_units(a, here(bonds, "k int, u int, v int").select("structure_id", "u", "v"))
    return found.select(F.col("structure_id").cast("long").alias("structure_id"), "resname", "atom_name", "unit", "rule")


@query("""WITH m AS (SELECT c_nationkey AS project, c_custkey % 50 AS target, CASE WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 11 = 0 THEN 'conflict' ELSE 'mapped' END AS status FROM customer),
t AS (SELECT n_nationkey AS project, range AS target FROM nation, range(60)), c AS (SELECT DISTINCT s_nationkey AS project, s_suppkey % 60 AS target FROM supplier),
hit AS (SELECT DISTINCT project, target FROM m WHERE status = 'mapped'),
a AS (SELECT project, count(*) AS n_source, count(*) FILTER (status = 'mapped') AS n_mapped, count(*) FILTER (status = 'conflict') AS n_conflict FROM m GROUP BY 1),
b AS (SELECT t.project, count(*) AS n_target, count(hit.target) AS n_target_mapped FROM t LEFT JOIN hit USING (project, target) GROUP BY 1),
e AS (SELECT c.project, count(*) AS n_contact, count(hit.target) AS n_contact_mapped FROM c LEFT JOIN hit USING (project, target) GROUP BY 1)
SELECT project, coalesce(n_source, 0) AS n_source, coalesce(n_mapped, 0) AS n_mapped, coalesce(n_conflict, 0) AS n_conflict, round(n_mapped::DOUBLE / n_source, 9) AS source_coverage, n_target, n_target_mapped, round(n_target_mapped::DOUBLE / n_target, 9) AS target_coverage,
    coalesce(n_contact, 0) AS n_contact, coalesce(n_contact_mapped, 0) AS n_contact_mapped, round(n_contact_mapped::DOUBLE / n_contact, 9) AS contact_coverage FROM b LEFT JOIN a USING (project) LEFT JOIN e USING (project)""")
def q170_mapping_audit(spark, d):
    """What of the conservation rows, of the residues and of the contact residues a mapping reaches, for each project."""
    k, key = F.col("c_custkey"), lambda c: F.concat(F.lit("R"), c.cast("string")).alias("residue_key")
    mapping = t(spark, d, "customer").select(F.col("c_nationkey").alias("project"), key(k % 50).alias("target_key"), F.when(k % 7 == 0, "missing").when(k % 11 == 0, "conflict").otherwise("mapped").alias("status"))
    targets = t(spark, d, "nation").select(F.col("n_nationkey").alias("project"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("r")).select("project", key(F.col("r")))
    contacts = t(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), key(F.col("s_suppkey") % 60))
    return r6(conservation.audit(mapping, targets, contacts, ["project"]), "source_coverage", "target_coverage", "contact_coverage", digits=9)
