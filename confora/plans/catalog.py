"""The relational kernels as queries over the driver's tables, each with its SQL.

In these, an order is a structure, ``S<l_suppkey>`` a residue node, ``P<l_partkey % 16>`` a ligand
node, return flag and line status the interaction type, quantity the score; the first three components
of an embedding (times 20) are coordinates, ``vec_id % 20`` is the structure, labels below 5 are protein
atoms and the others ligand atoms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import graphs, proximity, scores, screening
from ..operators.ordering import globally_numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


STATS = ("mean", "median", "p10", "min", "max")


@query("""SELECT l_orderkey AS structure_id, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median,
    round(quantile_cont(l_quantity, 0.1), 6) AS p10, min(l_quantity) AS min, max(l_quantity) AS max, count(*) AS n_values,
    avg(l_quantity) >= 25 AS passed FROM lineitem GROUP BY 1""")
def q01_structure_quality(spark, d):
    s = scores.score_summary(t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "structure_id"), ["structure_id"], "l_quantity")
    return r6(s.withColumn("passed", F.col("mean") >= 25), *STATS)


@query("""WITH x AS (SELECT l_orderkey, l_quantity AS q, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS a FROM lineitem)
SELECT l_orderkey AS structure_id, round(coalesce(avg(a), avg(q)), 6) AS mean, round(coalesce(median(a), median(q)), 6) AS median,
    round(coalesce(quantile_cont(a, 0.1), quantile_cont(q, 0.1)), 6) AS p10, coalesce(min(a), min(q)) AS min, coalesce(max(a), max(q)) AS max,
    CASE WHEN count(a) > 0 THEN count(a) ELSE count(q) END AS n_values FROM x GROUP BY 1""")
def q02_ca_fallback_quality(spark, d):
    s = scores.score_summary(t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "structure_id"), ["structure_id"], "l_quantity", F.col("l_returnflag") == "A")
    return r6(s, *STATS)


@query("SELECT passed, count(*) AS n_structures FROM (SELECT l_orderkey, avg(l_quantity) >= 25 AS passed FROM lineitem GROUP BY 1) GROUP BY 1")
def q03_passed_failed_split(spark, d):
    return scores.split_counts(t(spark, d, "lineitem").groupBy("l_orderkey").agg((F.avg("l_quantity") >= 25).alias("passed")))


def points(spark, d):
    e = t(spark, d, "embeddings")
    xyz = {c: F.col("embedding")[i].cast("double") * 20 for i, c in enumerate("xyz")}
    element = F.element_at(F.array(*[F.lit(x) for x in "CNOS"]), (F.col("vec_id") % 4 + 1).cast("int"))
    p = e.select("vec_id", "label", (F.col("vec_id") % 20).alias("structure_id"), *[v.alias(k) for k, v in xyz.items()], X.vdw_radius(element).alias("radius"))
    return p.where("label < 5").drop("label"), p.where("label >= 5").drop("label")


POINTS = """p AS (SELECT vec_id, label, vec_id % 20 AS structure_id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z,
    CASE vec_id % 4 WHEN 0 THEN 1.70 WHEN 1 THEN 1.55 WHEN 2 THEN 1.52 ELSE 1.80 END::DOUBLE AS radius FROM embeddings),
pairs AS (SELECT a.structure_id, a.vec_id AS protein_id, b.vec_id AS ligand_id, a.x AS lx, a.y AS ly, a.z AS lz, b.x AS rx, b.y AS ry, b.z AS rz,
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, a.radius + b.radius - 0.5 AS cutoff, b.structure_id AS other
    FROM p a JOIN p b ON a.label < 5 AND b.label >= 5)"""
CLASHES = POINTS + """, c AS (SELECT *, sqrt(d2) AS distance, cutoff - sqrt(d2) AS overlap FROM pairs WHERE structure_id = other AND sqrt(d2) < cutoff)"""


def pair_columns(df):
    return df.select(F.col("l.structure_id").alias("structure_id"), F.col("l.vec_id").alias("protein_id"), F.col("r.vec_id").alias("ligand_id"), "distance", "overlap", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "lr" for c in "xyz"])


def clashes(spark, d):
    left, right = points(spark, d)
    return pair_columns(proximity.overlaps(proximity.structure_join(left, right, ["structure_id"]), 0.5).where("clash"))


@query("WITH " + CLASHES + " SELECT structure_id, protein_id, ligand_id, round(distance, 6) AS distance, round(overlap, 6) AS overlap FROM c")
def q04_proximity_pairs(spark, d):
    return r6(clashes(spark, d).select("structure_id", "protein_id", "ligand_id", "distance", "overlap"), "distance", "overlap")


@query("WITH " + POINTS + " SELECT DISTINCT protein_id AS vec_id FROM pairs WHERE d2 <= 0.25")
def q05_radius_semi(spark, d):
    left, right = points(spark, d)
    return proximity.voxel_join(left, right, 0.5).select(F.col("l.vec_id").alias("vec_id")).distinct()


def nearest_points(spark, d):
    left, right = points(spark, d)
    near = proximity.nearest_in_rings(left, right, ["structure_id"], ["vec_id"], "vec_id")
    return r6(near.withColumnRenamed("vec_id", "protein_id"), "min_distance")


@query("WITH " + POINTS + " SELECT protein_id, round(sqrt(min(d2)), 6) AS min_distance FROM pairs WHERE structure_id = other GROUP BY 1")
def q06_nearest(spark, d):
    return nearest_points(spark, d).select("protein_id", "min_distance")


@query("WITH " + POINTS + """ SELECT protein_id, ligand_id AS nearest_id FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY d2, ligand_id) AS k
    FROM pairs WHERE structure_id = other) WHERE k = 1""")
def q07_nearest_id(spark, d):
    return nearest_points(spark, d).select("protein_id", "nearest_id")


@query("WITH " + CLASHES + """ SELECT s.structure_id, coalesce(n, 0) AS clash_count, round(coalesce(o, 0.0), 6) AS overlap_sum, round(m, 6) AS min_clash_distance, coalesce(n, 0) <= 40 AS passed
    FROM (SELECT DISTINCT structure_id FROM p) s LEFT JOIN (SELECT structure_id, count(*) AS n, sum(overlap) AS o, min(distance) AS m FROM c GROUP BY 1) g USING (structure_id)""")
def q08_clash_rollup(spark, d):
    left, right = points(spark, d)
    out = proximity.clash_summary(left.select("structure_id").union(right.select("structure_id")), clashes(spark, d), "structure_id", 40)
    return r6(out, "overlap_sum", "min_clash_distance")


@query("WITH " + CLASHES + """, s AS (SELECT structure_id, sum((rx - lx) / distance * overlap) AS x, sum((ry - ly) / distance * overlap) AS y, sum((rz - lz) / distance * overlap) AS z
    FROM c WHERE distance > 0 GROUP BY 1) SELECT structure_id, round(x / sqrt(x * x + y * y + z * z), 6) AS dx, round(y / sqrt(x * x + y * y + z * z), 6) AS dy,
    round(z / sqrt(x * x + y * y + z * z), 6) AS dz FROM s WHERE sqrt(x * x + y * y + z * z) > 0""")
def q09_repulsion_direction(spark, d):
    return r6(proximity.repulsion(clashes(spark, d), "structure_id"), "dx", "dy", "dz")


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_structures, count(DISTINCT CASE WHEN l_quantity <= 25 THEN l_orderkey END) AS n_within, min(l_quantity) AS min_distance,
    round(median(l_quantity), 6) AS median_distance, round(avg(l_quantity), 6) AS mean_distance, (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_total,
    round(count(DISTINCT CASE WHEN l_quantity <= 25 THEN l_orderkey END)::DOUBLE / (SELECT count(DISTINCT o_orderkey) FROM orders), 9) AS frequency FROM lineitem GROUP BY 1""")
def q11_residue_frequency(spark, d):
    structures = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = screening.residue_frequency(t(spark, d, "lineitem"), structures, "l_orderkey", "l_suppkey", F.col("l_quantity") <= 25, "l_quantity")
    return r6(r6(out, "median_distance", "mean_distance"), "frequency", digits=9)


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_graphs, (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_total,
    round(count(DISTINCT l_orderkey)::DOUBLE / (SELECT count(DISTINCT o_orderkey) FROM orders), 9) AS occurrence FROM lineitem GROUP BY 1""")
def q12_graph_occurrence(spark, d):
    structures = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return r6(screening.graph_occurrence(t(spark, d, "lineitem"), structures, "l_orderkey", "l_suppkey"), "occurrence", digits=9)


def key_table(spark, d):
    structures = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    li = t(spark, d, "lineitem")
    f = screening.residue_frequency(li, structures, "l_orderkey", "l_suppkey", F.col("l_quantity") <= 25, "l_quantity").select("l_suppkey", "frequency")
    o = screening.graph_occurrence(li, structures, "l_orderkey", "l_suppkey").select("l_suppkey", "occurrence")
    s = t(spark, d, "supplier").select(F.col("s_suppkey"), F.col("s_suppkey").alias("l_suppkey")).join(f, "l_suppkey", "left").join(o, "l_suppkey", "left")
    grade = (F.col("s_suppkey") % 9 + 1).cast("long")
    return s.select("s_suppkey", grade.alias("grade"), F.coalesce("frequency", F.lit(0.0)).alias("frequency"), F.coalesce("occurrence", F.lit(0.0)).alias("occurrence"))


KEYS = """k AS (SELECT s_suppkey, s_suppkey % 9 + 1 AS grade, coalesce(w, 0)::DOUBLE / n AS frequency, coalesce(g, 0)::DOUBLE / n AS occurrence FROM supplier
    LEFT JOIN (SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity <= 25 THEN l_orderkey END) AS w, count(DISTINCT l_orderkey) AS g FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
    CROSS JOIN (SELECT count(DISTINCT o_orderkey) AS n FROM orders))"""


@query("WITH " + KEYS + " SELECT s_suppkey, grade, round(frequency, 9) AS frequency, round(occurrence, 9) AS occurrence FROM k WHERE grade >= 5 AND frequency >= 0.02 AND occurrence >= 0.038")
def q13_key_residues(spark, d):
    return r6(key_table(spark, d).where("grade >= 5 and frequency >= 0.02 and occurrence >= 0.038"), "frequency", "occurrence", digits=9)


@query("WITH " + KEYS + """ SELECT s_suppkey, CASE WHEN s = '' THEN 'selected' ELSE s END AS status FROM (SELECT s_suppkey, concat_ws('; ', CASE WHEN NOT grade >= 5 THEN 'conservation below cutoff' END,
    CASE WHEN NOT frequency >= 0.02 THEN 'distance frequency below cutoff' END, CASE WHEN NOT occurrence >= 0.038 THEN 'graph occurrence below cutoff' END) AS s FROM k)""")
def q14_selection_status(spark, d):
    checks = [(F.col("grade") >= 5, "conservation below cutoff"), (F.col("frequency") >= 0.02, "distance frequency below cutoff"), (F.col("occurrence") >= 0.038, "graph occurrence below cutoff")]
    return key_table(spark, d).select("s_suppkey", X.selection_status(checks).alias("status"))


def order_sets(spark, d):
    e = t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("node"))
    return screening.node_sets(e, "l_orderkey", "node")


SETS = "s AS (SELECT l_orderkey, list_sort(list(DISTINCT 'S' || (l_suppkey % 8))) AS nodes FROM lineitem GROUP BY 1)"


@query("WITH " + SETS + """ SELECT array_to_string(nodes, ';') AS nodes, n_structures, representative, set_size, row_number() OVER (ORDER BY set_size DESC, n_structures DESC, representative) AS type_number
    FROM (SELECT nodes, count(*) AS n_structures, min(l_orderkey) AS representative, len(nodes) AS set_size FROM s GROUP BY nodes)""")
def q15_node_set_types(spark, d):
    return screening.set_types(order_sets(spark, d), "l_orderkey").withColumn("nodes", F.array_join("nodes", ";"))


@query("WITH " + SETS + " SELECT l_orderkey, len(list_intersect(nodes, ['S1', 'S2'])) AS n_present FROM s WHERE list_has_all(nodes, ['S1', 'S2'])")
def q16_structure_filter_all(spark, d):
    return screening.structure_filter(order_sets(spark, d), ["S1", "S2"]).where("passed").select("l_orderkey", "n_present")


@query("WITH " + SETS + " SELECT l_orderkey, len(list_intersect(nodes, ['S1', 'S2'])) AS n_present FROM s WHERE list_has_any(nodes, ['S1', 'S2'])")
def q16_structure_filter_any(spark, d):
    return screening.structure_filter(order_sets(spark, d), ["S1", "S2"], "any").where("passed").select("l_orderkey", "n_present")


@query("WITH " + SETS + " SELECT l_orderkey, array_to_string(list_filter(['S1', 'S2', 'S5'], lambda x: NOT list_contains(nodes, x)), ';') AS missing FROM s")
def q17_required_missing(spark, d):
    return screening.structure_filter(order_sets(spark, d), ["S1", "S2", "S5"]).select("l_orderkey", F.array_join("missing", ";").alias("missing"))


@query("""SELECT node_key, row_number() OVER (ORDER BY kind, number) - 1 AS global_idx FROM (SELECT DISTINCT 0 AS kind, l_partkey % 16 AS number, 'P' || (l_partkey % 16) AS node_key FROM lineitem
    UNION SELECT DISTINCT 1, l_suppkey, 'S' || l_suppkey FROM lineitem)""")
def q19_blueprint_index(spark, d):
    li = t(spark, d, "lineitem")
    lig = li.select(F.lit(0).alias("kind"), (F.col("l_partkey") % 16).alias("number")).distinct()
    res = li.select(F.lit(1).alias("kind"), F.col("l_suppkey").alias("number")).distinct()
    nodes = lig.union(res).withColumn("node_key", F.concat(F.when(F.col("kind") == 0, "P").otherwise("S"), F.col("number").cast("string")))
    return graphs.blueprint(nodes, ["kind", "number"]).select("node_key", "global_idx")


def order_edges(spark, d, parts: int = 16, suppliers: int | None = None):
    s = F.col("l_suppkey") if suppliers is None else F.col("l_suppkey") % suppliers
    return t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("P"), (F.col("l_partkey") % parts).cast("string")).alias("u"), F.concat(F.lit("S"), s.cast("string")).alias("v"))


def signature_sql(parts: int, suppliers: str) -> str:
    return f"g AS (SELECT l_orderkey, string_agg(e, ',' ORDER BY e) AS signature, count(*) AS edge_count FROM (SELECT DISTINCT l_orderkey, 'P' || (l_partkey % {parts}) || '-S' || ({suppliers}) AS e FROM lineitem) GROUP BY 1)"


FINE, COARSE = signature_sql(16, "l_suppkey"), signature_sql(2, "l_suppkey % 3")
CLASSES = COARSE + ", k AS (SELECT edge_count, signature, min(l_orderkey) AS leader, count(*) AS size FROM g GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (ORDER BY edge_count DESC, leader) AS class_number FROM k)"


@query("WITH " + FINE + " SELECT * FROM g")
def q20_edge_signature(spark, d):
    return graphs.edge_signatures(order_edges(spark, d), "l_orderkey").withColumn("edge_count", F.col("edge_count").cast("long"))


def coarse(spark, d):
    return graphs.edge_signatures(order_edges(spark, d, 2, 3), "l_orderkey").withColumn("edge_count", F.col("edge_count").cast("long"))


@query("WITH " + CLASSES + " SELECT class_number, signature, edge_count, leader, size FROM c")
def q21_signature_classes(spark, d):
    return graphs.signature_classes(coarse(spark, d), "l_orderkey")


@query("WITH " + COARSE + " SELECT edge_count, count(*) AS n_graphs, count(DISTINCT signature) AS n_signatures FROM g GROUP BY 1")
def q22_edge_count_blocks(spark, d):
    return graphs.edge_count_blocks(coarse(spark, d))


@query("WITH " + CLASSES + " SELECT leader, l_orderkey AS member, 0.0::DOUBLE AS distance FROM g JOIN c USING (edge_count, signature) WHERE l_orderkey <> leader")
def q23_pairwise_same_signature(spark, d):
    g = coarse(spark, d)
    return g.join(graphs.signature_classes(g, "l_orderkey"), ["edge_count", "signature"]).where("l_orderkey != leader").select("leader", F.col("l_orderkey").alias("member"), F.lit(0.0).alias("distance"))


@query("""SELECT c_nationkey AS current_class, c_mktsegment AS reference_class, shared, round(shared::DOUBLE / (nc + nr - shared), 9) AS jaccard FROM
    (SELECT c_nationkey, c_mktsegment, count(*) AS shared FROM customer GROUP BY 1, 2) JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) USING (c_nationkey)
    JOIN (SELECT c_mktsegment, count(*) AS nr FROM customer GROUP BY 1) USING (c_mktsegment)""")
def q24_jaccard_candidates(spark, d):
    return r6(jaccards(spark, d).select("current_class", "reference_class", "shared", "jaccard"), "jaccard", digits=9)


def jaccards(spark, d):
    c = t(spark, d, "customer")
    return graphs.jaccard_candidates(c.select("c_custkey", F.col("c_nationkey").alias("current_class")), c.select("c_custkey", F.col("c_mktsegment").alias("reference_class")), "c_custkey", "current_class", "reference_class")


@query("""SELECT supertype, count(*) AS n, count(DISTINCT l_orderkey) AS n_structures FROM (SELECT l_orderkey, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Polar contact' WHEN 'RF' THEN 'Hydrophobic contact'
    WHEN 'NO' THEN 'Pi interaction' WHEN 'NF' THEN 'Metal coordination' ELSE 'Other' END AS supertype FROM lineitem) GROUP BY 1""")
def q26_interaction_supertype(spark, d):
    kinds = {"AF": "hbond", "RF": "hydrophobic_interaction", "NO": "pi-stacking", "NF": "metal"}
    kind = F.element_at(X.literal_map(kinds), F.concat("l_returnflag", "l_linestatus"))
    return t(spark, d, "lineitem").select("l_orderkey", X.supertype(X.interaction_type(kind)).alias("supertype")).groupBy("supertype").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_structures"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN false WHEN p_size <= 10 THEN true WHEN p_brand = 'Brand#2' THEN false ELSE true END AS keep,
    CASE WHEN p_type = 'SMALL' THEN 'drop_small' WHEN p_size <= 10 THEN 'keep_size' WHEN p_brand = 'Brand#2' THEN 'drop_brand' END AS rule_id FROM part""")
def q30_first_rule_wins(spark, d):
    rules = [("drop_small", F.col("p_type") == "SMALL", F.lit(False)), ("keep_size", F.col("p_size") <= 10, F.lit(True)), ("drop_brand", F.col("p_brand") == "Brand#2", F.lit(False))]
    keep, rule = X.first_rule(rules, F.lit(True))
    return t(spark, d, "part").select("p_partkey", keep.alias("keep"), rule.alias("rule_id"))


@query("""SELECT name, regexp_extract(name, '([0-9]+)[^0-9]*$', 1)::BIGINT AS last_int, lower(regexp_extract(name, '^[^0-9]*')) || lpad(regexp_extract(name, '([0-9]+)', 1), 12, '0') AS natural_key,
    regexp_extract(name, '^[^0-9]*') || lpad(((regexp_extract(name, '([0-9]+)[^0-9]*$', 1))::BIGINT + 7)::VARCHAR, 9, '0') AS shifted FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier)""")
def q34_last_integer_natural(spark, d):
    n = t(spark, d, "customer").select(F.col("c_name").alias("name")).union(t(spark, d, "supplier").select("s_name"))
    return n.select("name", X.last_integer(F.col("name")).alias("last_int"), X.natural_key(F.col("name")).alias("natural_key"), X.shift_last_integer(F.col("name"), 7).alias("shifted"))


@query(r"""SELECT doc_id, md5(CASE WHEN s = '' THEN '_' ELSE s END) AS token_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[ \t\n\r\f\v]+', '_', 'g'), '[^A-Za-z0-9_.:-]', '_', 'g') AS s FROM documents)""")
def q35_token_sanitise(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(X.graph_token(F.col("text"))).alias("token_md5"))


@query("""SELECT count(*) AS n_required, count(l_partkey) AS n_present, round(count(l_partkey)::DOUBLE / count(*), 9) AS coverage FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN
    (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50) ON p_partkey = l_partkey""")
def q37_coverage_audit(spark, d):
    present = t(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return r6(screening.coverage(t(spark, d, "part"), present, "p_partkey"), "coverage", digits=9)


@query()
def q38_connected_components(spark, d):
    """Components over every edge, with whole keys. Recursive SQL is too slow on it, so a test holds it against brute force."""
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    return graphs.components(t(spark, d, "lineitem").select(key("O", "l_orderkey").alias("u"), key("S", "l_suppkey").alias("v")).where("u is not null and v is not null"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_acctbal >= 0 THEN s_acctbal END DESC NULLS LAST, s_nationkey, s_suppkey) AS position FROM supplier""")
def q41_sort_nulls_last(spark, d):
    v = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    return globally_numbered(t(spark, d, "supplier"), v.desc_nulls_last(), "s_nationkey", "s_suppkey").select("s_suppkey", "position")


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q44_json_props(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
