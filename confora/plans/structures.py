"""The operators over structure files, as queries over files that are made of the driver's tables, each with its SQL.

An order is an atom line: ten orders are a structure, the first six of them protein atoms and the others ligand atoms; customer
numbers give names, places and scores. Lines are formatted and then read by the same parser as files are.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import settings
from ..operators import docking, interactions, matching, scores, screening, trimming
from ..sources import conservation, pdb, shared, sinks, tables
from . import workflow
from .catalog import query, r6, t

LINE = "%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s"
ATOMS = """a AS (SELECT o_orderkey AS k, o_custkey AS c, 'model_' || (o_orderkey // 10) AS structure_id, (o_orderkey % 10)::INT AS line_index, (o_orderkey % 10 + 1)::INT AS serial,
    CASE WHEN o_orderkey % 10 >= 6 THEN 'HETATM' ELSE 'ATOM' END AS record,
    CASE WHEN o_orderkey % 10 >= 6 THEN ['C', 'O', 'N', 'P'][o_custkey % 4 + 1] || (o_custkey % 3 + 1) ELSE ['N', 'CA', 'C', 'O', 'CB', 'HB1'][o_orderkey % 10 + 1] END AS atom_name,
    CASE o_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS altloc,
    CASE WHEN o_orderkey % 10 >= 6 THEN ['LIG', 'HOH', 'MG', 'TMP'][o_custkey % 4 + 1] ELSE ['ALA', 'SER', 'HIS', 'ASP'][o_custkey % 4 + 1] END AS resname,
    ['A', 'B', ''][o_custkey % 3 + 1] AS chain, (o_custkey % 50 + 1)::INT AS resseq, CASE WHEN o_custkey % 7 = 0 THEN 'A' ELSE '' END AS icode,
    (o_custkey % 64)::DOUBLE / 8 AS x, (o_orderkey % 32)::DOUBLE / 8 AS y, ((o_orderkey + o_custkey) % 48)::DOUBLE / 8 AS z, (50 + o_custkey % 50)::DOUBLE AS b_factor,
    CASE WHEN o_custkey % 2 = 0 THEN substr(CASE WHEN o_orderkey % 10 >= 6 THEN ['C', 'O', 'N', 'P'][o_custkey % 4 + 1] ELSE ['N', 'CA', 'C', 'O', 'CB', 'HB1'][o_orderkey % 10 + 1] END, 1, 1) ELSE '' END AS element FROM orders)"""
HEAVY = ATOMS + ", h AS (SELECT * FROM a WHERE NOT (element = 'H' OR atom_name LIKE 'H%'))"
PLACE = ("structure_id", "serial", "atom_name", "resname", "chain", "resseq", "icode", "x", "y", "z")
BLANK = "CASE WHEN chain = '' THEN '_' ELSE chain END"


def pick(values: list, at) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def model_lines(spark, d, serial=None, resseq=None):
    """(structure_id, file, line_index, line) and the order's k and c."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at, ligand = k % 10, k % 10 >= 6
    name = F.when(ligand, F.concat(pick(["C", "O", "N", "P"], c % 4), (c % 3 + 1).cast("string"))).otherwise(pick(["N", "CA", "C", "O", "CB", "HB1"], at))
    line = F.format_string(
        LINE, F.when(ligand, "HETATM").otherwise("ATOM"), at + 1 if serial is None else serial, name, F.when(c % 5 == 0, "A").when(c % 5 == 1, "B").otherwise(""),
        F.when(ligand, pick(["LIG", "HOH", "MG", "TMP"], c % 4)).otherwise(pick(["ALA", "SER", "HIS", "ASP"], c % 4)), pick(["A", "B", ""], c % 3), c % 50 + 1, F.when(c % 7 == 0, "A").otherwise(""),
        (c % 64) / 8, (k % 32) / 8, ((k + c) % 48) / 8, F.lit(1.0), (50 + c % 50).cast("double"), F.when(c % 2 == 0, F.substring(name, 1, 1)).otherwise(""),
    )
    if resseq is not None:
        line = F.when(resseq, F.concat(F.substring(line, 1, 22), F.lit("  x?"), F.substring(line, 27, 100))).otherwise(line)
    sid = F.concat(F.lit("model_"), F.floor(k / 10).cast("string"))
    return t(spark, d, "orders").select(sid.alias("structure_id"), F.concat(sid, F.lit(".pdb")).alias("file"), at.cast("int").alias("line_index"), line.alias("line"))


def model_atoms(spark, d, dialect=pdb.CLASH, **damage):
    return pdb.atoms(model_lines(spark, d, **damage), dialect)


def every_atom(spark, d):
    """All alternate locations, chains and elements as they are written."""
    return model_atoms(spark, d, pdb.Dialect(guess_element=False))


@query(f"WITH {ATOMS} SELECT {', '.join(PLACE)}, b_factor, element FROM a WHERE record = 'ATOM'")
def q50_scan_strict(spark, d):
    return model_atoms(spark, d, pdb.STRICT).select(*PLACE, "b_factor", "element")


@query(f"WITH {ATOMS} SELECT {', '.join(PLACE)}, altloc, CASE WHEN element <> '' THEN element WHEN atom_name = 'CA' THEN 'CA' ELSE substr(atom_name, 1, 1) END AS element FROM a WHERE altloc <> 'B'")
def q51_scan_clash(spark, d):
    return model_atoms(spark, d, pdb.CLASH).select(*PLACE, "altloc", "element")


@query(f"""WITH {ATOMS}, b AS (SELECT * REPLACE ((k % 5 + 1)::INT AS serial) FROM a) SELECT {', '.join(PLACE)}, CASE WHEN element <> '' THEN element WHEN atom_name = 'CA' THEN 'CA' ELSE substr(atom_name, 1, 1) END AS element
    FROM b QUALIFY row_number() OVER (PARTITION BY structure_id, serial ORDER BY line_index DESC) = 1""")
def q52_scan_graph(spark, d):
    return model_atoms(spark, d, pdb.GRAPH, serial=F.col("o_orderkey") % 5 + 1).select(*PLACE, "element")


@query(f"WITH {ATOMS} SELECT structure_id, serial, atom_name, {BLANK} AS chain, resseq, CASE WHEN element <> '' THEN element ELSE substr(regexp_replace(atom_name, '[0-9]', '', 'g'), 1, 2) END AS element FROM a WHERE c % 11 <> 0")
def q53_scan_lenient(spark, d):
    return model_atoms(spark, d, pdb.LENIENT, resseq=F.col("o_custkey") % 11 == 0).select("structure_id", "serial", "atom_name", "chain", "resseq", "element")


BONDS = """b AS (SELECT structure_id, serial AS p, unnest([(c % 10 + 1)::INT, ((c + 3) % 10 + 1)::INT]) AS q FROM a WHERE record = 'HETATM'),
bonds AS (SELECT DISTINCT structure_id, least(p, q) AS u, greatest(p, q) AS v FROM b WHERE p <> q)"""


def bond_lines(spark, d, form: str = "CONECT%5d%5d%5d"):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sid = F.concat(F.lit("model_"), F.floor(k / 10).cast("string"))
    rows = t(spark, d, "orders").where(k % 10 >= 6)
    return rows.select(sid.alias("structure_id"), (100 + k % 10).cast("int").alias("line_index"), F.format_string(form, k % 10 + 1, c % 10 + 1, (c + 3) % 10 + 1).alias("line"))


@query(f"WITH {ATOMS}, {BONDS} SELECT * FROM bonds")
def q54_conect_edges(spark, d):
    return pdb.conect_edges(bond_lines(spark, d))


@query(f"WITH {ATOMS}, {BONDS} SELECT * FROM bonds")
def q55_conect_loose(spark, d):
    return pdb.conect_edges(bond_lines(spark, d, "CONECT %d %d %d"))


@query("SELECT c_custkey, (c_custkey % 900)::INT AS rank, (c_custkey % 5 + 1)::INT AS model, (c_custkey % 3)::INT AS seed FROM customer")
def q56_file_metadata(spark, d):
    name = F.format_string("AB12_unrelaxed_rank_%03d_model_%d_seed_%03d", F.col("c_custkey") % 900, F.col("c_custkey") % 5 + 1, F.col("c_custkey") % 3)
    return t(spark, d, "customer").select("c_custkey", *[v.alias(k) for k, v in pdb.file_metadata(name).items()])


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE c_custkey END AS prediction FROM customer")
def q57_prediction_index(spark, d):
    k = F.col("c_custkey")
    forms = ["x_prediction_%d_9_rank_3", "pred-%d-rank_4", "a_model_%d", "%d_Chain_B_rank_2", "z_rank%d_", "q-%d", "T1_x9_%d_Chain", "none%d"]
    name = F.replace(pick(forms, k % 8), F.lit("%d"), k.cast("string"))
    found = F.when(k % 8 == 6, pdb.prediction_index(name, "T1")).otherwise(pdb.prediction_index(name))
    return t(spark, d, "customer").select("c_custkey", found.alias("prediction"))


@query("SELECT n_name || '.pdb' AS file, n_nationkey + 1 AS size, row_number() OVER (ORDER BY n_nationkey) AS input_order, 'structure' AS kind FROM nation")
def q58_listing(spark, d):
    path = shared.new_path(spark, "listing")
    for r in t(spark, d, "nation").collect():  # 25 rows at every scale
        shared.put(spark, f"{path}/{r.n_name}.pdb", b"x" * (r.n_nationkey + 1))
    kinds = tables.result_files(spark, path).select("file", "kind")
    return tables.files(spark, path, "*.pdb").join(kinds, "file").select("file", "size", "input_order", "kind")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, s_acctbal > 0 AS passed FROM supplier")
def q59_index_table(spark, d):
    path = shared.new_path(spark, "index")
    t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.when(F.col("s_acctbal") > 0, "Yes").otherwise("0.0").alias("passed")).write.option("header", True).csv(path)
    found = tables.first_existing(spark, [f"{path}-newer", path])
    return tables.csv(spark, found, "s_suppkey long, s_name string, s_acctbal double, passed string").withColumns({"s_acctbal": F.round("s_acctbal", 2), "passed": X.parse_bool(F.col("passed"))})


@query("""SELECT c_custkey % 200 AS resnr, upper(substr(c_mktsegment, 1, 3)) AS restype, CASE c_nationkey % 3 WHEN 0 THEN 'hydrogen_bonds' WHEN 1 THEN 'pi_stacks' ELSE 'metal_complexes' END AS kind,
    round((c_custkey % 40)::DOUBLE / 8, 3) AS dist, 'B' AS reschain FROM customer""")
def q60_xml_report(spark, d):
    path, n = shared.new_path(spark, "reports"), F.col("c_nationkey") % 3
    tag, distance = F.when(n == 0, "hydrogen_bond").when(n == 1, "pi_stack").otherwise("metal_complex"), F.when(n == 0, "dist_h-a").when(n == 1, "centdist").otherwise("dist")
    value = F.format_string("%.3f", (F.col("c_custkey") % 40) / 8)
    line = F.concat(F.lit("<"), tag, F.lit(' id="1"><resnr>'), (F.col("c_custkey") % 200).cast("string"), F.lit("</resnr><restype>"), F.upper(F.substring("c_mktsegment", 1, 3)), F.lit("</restype><reschain>B</reschain><"), distance, F.lit(">"), value, F.lit("</"), distance, F.lit("></"), tag, F.lit(">"))
    group = F.concat(F.when(n == 2, "metal_complexe").otherwise(tag), F.lit("s"))
    inside = F.concat(F.lit("<"), F.first("group"), F.lit(">"), F.array_join(F.collect_list("line"), "\n"), F.lit("</"), F.first("group"), F.lit(">"))
    one = F.concat(F.lit("<report><bindingsite><interactions>"), inside, F.lit("</interactions></bindingsite></report>"))  # a report for each nation
    t(spark, d, "customer").select("c_nationkey", line.alias("line"), group.alias("group")).groupBy("c_nationkey").agg(one.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return tables.plip_report(spark, path, "part-*").select("resnr", "restype", "kind", "dist", "reschain")


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS type, 'P' || l_partkey AS ligand, 'S' || l_suppkey AS protein, 'P' || l_partkey || ':A' AS ligand_node_key FROM lineitem")
def q33_key_value_lines(spark, d):
    path = shared.new_path(spark, "contacts")
    line = F.format_string("Type: %s\tLigand: P%d\tProtein: S%d\tLigandNodeKey: P%d:A\tAt: %d.%d", "l_returnflag", "l_partkey", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    t(spark, d, "lineitem").select(line.alias("value")).write.text(path)
    found = tables.interaction_lines(spark, path, "part-*", more=("At",))
    at = F.split("at", r"\.")
    return found.select(at[0].cast("long").alias("l_orderkey"), at[1].cast("int").alias("l_linenumber"), "type", "ligand", "protein", "ligand_node_key")


@query("SELECT r_name AS structure_id, r_regionkey AS u, 5 + n_nationkey AS v FROM nation JOIN region ON n_regionkey = r_regionkey")
def q62_graph_text(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("structure_id"), F.col("r_regionkey").alias("u"), (F.col("n_nationkey") + 5).alias("v"))
    vertices = n.select(F.col("u").alias("global_idx")).union(n.select("v")).distinct().withColumn("label", F.concat(F.lit("L"), F.col("global_idx").cast("string")))
    path = shared.new_path(spark, "graphs")
    for r in pdb.graph_text(n, vertices, n).collect():  # five graphs at every scale
        assert r.text.count("\nv ") == 30
        shared.put(spark, f"{path}/{r.structure_id}_final.txt", r.text.encode())
    return tables.graph_files(spark, path)


SCORES = """s AS (SELECT s_suppkey::INT AS position, ['A', 'S', 'H', 'D'][s_suppkey % 4 + 1] AS seq, ['ALA', 'SER', 'HIS', 'ASP'][s_suppkey % 4 + 1] AS resname, (s_suppkey + 100)::INT AS resseq,
    round((s_nationkey - 12)::DOUBLE / 8, 3) AS score, (s_nationkey % 9 + 1)::INT AS grade FROM supplier)"""


def score_lines(spark, d, site: bool = True):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    res, letter = pick(["ALA", "SER", "HIS", "ASP"], k % 4), pick(["A", "S", "H", "D"], k % 4)
    note = F.when(k % 2 == 0, F.format_string("%s:%d:B", res, k + 100)).otherwise(F.format_string("B:%s:%d", res, k + 100)) if site else F.lit("")
    extra = F.lit("-1.303, -1.135 9,9 ") if site else F.lit("")
    return t(spark, d, "supplier").select(F.format_string("  %d  %s  %s  %.3f  %d%s  %s%s  %s  %d/150  %s 98%%, V 2%%", k, letter, note, (n - 12) / 8, n % 9 + 1, F.when(n % 4 == 0, "*").otherwise(""), extra, pick(["b", "e"], k % 2), pick(["f", "s", ""], k % 3), n, letter).alias("line"))


NOTED = "CASE WHEN position % 2 = 0 THEN 'b' ELSE 'e' END AS burial, CASE position % 3 WHEN 0 THEN 'f' WHEN 1 THEN 's' END AS function, seq || ' 98%, V 2%' AS variety"


@query(f"WITH {SCORES} SELECT position, seq, resname, 'B' AS chain, resseq, score, grade, {NOTED}, resname || resseq || 'B' AS residue_key FROM s")
def q63_conservation_text(spark, d):
    return conservation.parsed(score_lines(spark, d)).select("position", "seq", "resname", "chain", "resseq", "score", "grade", "burial", "function", "variety", "residue_key")


@query(f"WITH {SCORES} SELECT position, seq, resname, 'A' AS chain, position AS resseq, score, grade, {NOTED} FROM s")
def q64_conservation_compact(spark, d):
    return conservation.parsed(score_lines(spark, d, False)).select("position", "seq", "resname", "chain", "resseq", "score", "grade", "burial", "function", "variety")


@query(f"WITH {SCORES} SELECT resname, 'C' AS chain, resseq, score, grade, resname || resseq || 'C' AS residue_key FROM s")
def q65_conservation_table(spark, d):
    k = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select((k + 100).alias("ResNum"), pick(["A", "S", "H", "D"], k % 4).alias("AA"), ((F.col("s_nationkey") - 12) / 8).alias("Score"), (F.col("s_nationkey") % 9 + 1).alias("Color"))
    return conservation.normalised(rows, "C").select("resname", "chain", "resseq", F.round("score", 3).alias("score"), "grade", "residue_key")


@query("SELECT (n_nationkey + 1)::INT AS position, 'ALA' AS resname, (n_nationkey + 11)::INT AS resseq, (n_regionkey + 1)::INT AS grade FROM nation")
def q66_conservation_archive(spark, d):
    text = "".join(f" {r.n_nationkey + 1} A ALA:{r.n_nationkey + 11}:B 0.5 {r.n_regionkey + 1} b f 9/9 A\n" for r in t(spark, d, "nation").collect())  # 25 rows at every scale
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("run/deep/other_grades.txt", "1 C CYS:1:A 0.1 1 b f 1/1 C\n")
        z.writestr("run/x_consurf_grades.txt", "head\n" + text)
    path = shared.put(spark, f"{shared.new_path(spark, 'archive')}.zip", data.getvalue())
    return conservation.load(spark, path).select("position", "resname", "resseq", "grade")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'exact' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'name' || s_suppkey END AS source_path FROM supplier""")
def q67_manifest_paths(spark, d):
    k = F.col("s_suppkey")
    text = lambda tag: F.concat(F.lit(tag), k.cast("string"))
    s = t(spark, d, "supplier")
    index = s.select("s_suppkey", F.concat(F.lit("out/"), text("f")).alias("path"), text("f").alias("file"))
    manifest = s.where(k % 3 == 0).select(F.concat(F.lit("out/"), text("f")).alias("output"), text("exact").alias("source"))
    manifest = manifest.union(s.where(k % 3 == 1).select(F.concat(F.lit("old/"), text("f")), text("name")))
    twice = s.where(k % 3 == 2).select(F.concat(F.lit("old/"), text("f")), F.explode(F.array(text("p"), text("q"))))
    return tables.source_paths(index, manifest.union(twice)).select("s_suppkey", "source_path")


@query("SELECT c_mktsegment AS reference_class, 'model_' || lpad((c_custkey + 5)::VARCHAR, greatest(4, length((c_custkey + 5)::VARCHAR))::INT, '0') AS structure_id, 'model_' || lpad((c_nationkey + 5)::VARCHAR, 2, '0') AS representative FROM customer WHERE c_nationkey % 4 <> 0")
def q68_class_manifest(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = t(spark, d, "customer").select(F.when(n % 4 != 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("  ").alias("Stable_Class"), F.concat(F.lit("model_"), F.lpad(k.cast("string"), F.greatest(F.lit(4), F.length(k.cast("string"))), "0")).alias("graph_id"), F.concat(F.lit("model_"), F.lpad(n.cast("string"), 2, "0")).alias("representative_id"))
    return tables.class_manifest(rows, 5)


@query(f"WITH {ATOMS} SELECT structure_id, round(avg(b_factor), 6) AS mean, avg(b_factor) >= 72.5 AS passed FROM a WHERE record = 'ATOM' AND atom_name = 'CA' GROUP BY 1")
def q69_config_quality(spark, d):
    path = shared.put(spark, f"{shared.new_path(spark, 'config')}.yaml", b"workflow_numbering: public\nstep01:\n  plddt_threshold: 72.5\nstep04:\n  radius: 6\n")
    return r6(workflow.quality(every_atom(spark, d), workflow.settings(tables.config(path, spark))).select("structure_id", "mean", "passed"), "mean")


@query("SELECT CASE WHEN n_regionkey < 2 THEN 'done' ELSE 'failed' END AS status, count(*) AS n_projects, count(DISTINCT n_regionkey) AS n_sites FROM nation GROUP BY 1")
def q70_batch_manifest(spark, d):
    lines = ["project,config,site"] + [f"{r.n_name},c{r.n_nationkey}.yaml,{r.n_regionkey}" for r in t(spark, d, "nation").collect()]  # 25 rows at every scale
    path = shared.put(spark, f"{shared.new_path(spark, 'batch')}.csv", "\n".join(lines).encode())
    rows = tables.batch_manifest(spark, path).withColumn("status", F.when(F.col("meta_site").cast("int") < 2, "done").otherwise("failed"))
    return workflow.batch_summary(rows).join(rows.groupBy("status").agg(F.count_distinct("meta_site").alias("n_sites")), "status")


@query("""WITH f AS (SELECT 'm' || c_custkey AS structure_id, unnest(['02_template_guided_docking', '03_clash_filter', 'other']) AS folder, c_nationkey FROM customer),
p AS (SELECT structure_id, 'run/' || folder || '/' || structure_id || CASE WHEN folder = 'other' THEN '_trimmed_complex.pdb' WHEN c_nationkey % 2 = 0 THEN '_complex.pdb' ELSE '_protonated.pdb' END AS path,
    CASE folder WHEN '02_template_guided_docking' THEN 5 WHEN '03_clash_filter' THEN 4 ELSE 999 END + CASE WHEN folder = 'other' THEN -2 WHEN c_nationkey % 2 = 0 THEN -1 ELSE 10 END AS score FROM f)
SELECT structure_id, arg_min(path, (score, length(path), path)) AS pdb, NULL::VARCHAR AS graph, 'no graph file' AS notes FROM p GROUP BY 1""")
def q40_export_index(spark, d):
    sid = F.concat(F.lit("m"), F.col("c_custkey").cast("string"))
    c = t(spark, d, "customer").select(sid.alias("structure_id"), "c_nationkey")
    name = F.when(F.col("folder") == "other", "_trimmed_complex.pdb").when(F.col("c_nationkey") % 2 == 0, "_complex.pdb").otherwise("_protonated.pdb")
    files = c.withColumn("folder", F.explode(F.array(*[F.lit(x) for x in ("02_template_guided_docking", "03_clash_filter", "other")]))).select(F.concat(F.lit("run/"), "folder", F.lit("/"), "structure_id", name).alias("path"))
    return sinks.export_index(c.select("structure_id"), sinks.file_index(files), ["pdb", "graph"])


LIGAND = "record = 'HETATM' AND resname <> 'HOH'"


@query(f"WITH {ATOMS} SELECT structure_id, resname, chain, resseq, count(*) AS n_atoms, string_agg(atom_name, ',' ORDER BY line_index) AS atom_names FROM a WHERE {LIGAND} GROUP BY 1, 2, 3, 4")
def q72_inspected_residues(spark, d):
    return interactions.inspected_residues(every_atom(spark, d).where(pdb.is_ligand()))


MODELS = "m AS (SELECT c_custkey AS k, ['AB12', 'cd34', 'target'][c_custkey % 3 + 1] || '_' || (c_custkey % 7) || CASE WHEN c_custkey % 4 = 0 THEN '_rank_' || lpad((c_custkey % 50)::VARCHAR, 3, '0') ELSE '' END || '_v' || c_custkey AS stem FROM customer)"


def models(spark, d):
    k = F.col("c_custkey")
    s = F.concat(pick(["AB12", "cd34", "target"], k % 3), F.lit("_"), (k % 7).cast("string"), F.when(k % 4 == 0, F.concat(F.lit("_rank_"), F.lpad((k % 50).cast("string"), 3, "0"))).otherwise(""), F.lit("_v"), k.cast("string"))
    path = F.concat(F.lit("in/"), s, F.lit(".pdb"))
    return t(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, path).otherwise(" ").alias("source_pdb"), F.when(k % 2 == 1, path).alias("pdb_path"), F.when(k % 5 == 0, "given").otherwise("").alias("structure_id"))


NATURAL = r"array_to_string(list_transform(regexp_extract_all(lower(stem) || '.pdb', '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 12, '0') ELSE x END), '')"


@query(f"WITH {MODELS} SELECT k AS c_custkey, stem || '.pdb' AS file, CASE WHEN k % 5 = 0 THEN 'given' ELSE stem END AS structure_id, row_number() OVER (ORDER BY encode({NATURAL})) AS input_order FROM m")
def q73_model_inputs(spark, d):
    return docking.model_inputs(models(spark, d)).select("c_custkey", "file", "structure_id", "input_order")


@query(f"""WITH {MODELS}, s AS (SELECT k, CASE k % 3 WHEN 0 THEN 'AB12' WHEN 1 THEN 'CD34' ELSE 'target' END || '_' || CASE WHEN k % 4 = 0 THEN k % 50 WHEN k % 3 < 2 THEN k % 7 ELSE k END AS name FROM m)
SELECT k AS c_custkey, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY k) > 1 THEN name || '_dup' || k ELSE name END AS short_id FROM s""")
def q74_output_names(spark, d):
    m = models(spark, d).select("c_custkey", F.col("c_custkey").alias("input_order"), F.regexp_replace(F.coalesce("pdb_path", "source_pdb"), "^in/", "").alias("file"))
    return docking.output_names(m).select("c_custkey", "short_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'a' || s_suppkey WHEN s_suppkey % 4 IN (1, 2) THEN 'p' || s_suppkey END AS score_path FROM supplier")
def q75_score_sources(spark, d):
    k = F.col("s_suppkey")
    text = lambda tag: F.concat(F.lit(tag), k.cast("string"))
    s = t(spark, d, "supplier")
    index = s.select("s_suppkey", text("a").alias("af2_pdb_path"), text(" p").alias("protein_pdb_path"), F.when(k % 4 == 2, text("a")).otherwise("c").alias("complex_path"))
    files = s.where(k % 4 == 0).select(text("a").alias("path")).union(s.where(k % 4 < 3).select(text("p"))).union(s.where(k % 4 == 2).select(text("a")))
    return docking.score_sources(index, files).select("s_suppkey", "score_path")


@query("SELECT 'model_' || s_suppkey AS structure_id, row_number() OVER (ORDER BY s_suppkey) AS input_order FROM supplier")
def q76_complex_records(spark, d):
    files = t(spark, d, "supplier").select(F.concat(F.lit("x/model_"), F.col("s_suppkey").cast("string"), F.lit("_trimmed_complex_complex.pdb")).alias("path"))
    return docking.complex_records(files).select("structure_id", "input_order")


@query("SELECT s_acctbal > 0 AS passed, count(*) AS n, min(s_name) AS first FROM supplier GROUP BY 1")
def q77_stage_tables(spark, d):
    path = shared.new_path(spark, "stage")
    rows = t(spark, d, "supplier").select(F.col("s_name").alias("structure_id"), (F.col("s_acctbal") > 0).alias("passed"), F.array("s_name").alias("names"))
    sinks.stage_tables(rows, path, csv=True)
    sinks.id_list(rows.where("passed"), f"{path}/ids")
    facts = sinks.report(rows, path, "stage")
    ids = spark.read.text(f"{path}/ids")
    back = spark.read.parquet(f"{path}/table").withColumn("passed", F.col("passed").cast("boolean"))
    listed = back.where("passed").join(ids, F.col("structure_id") == F.col("value")).select("passed", "structure_id").union(back.where("not passed").select("passed", "structure_id"))
    assert facts["n_passed"] == ids.count() and spark.read.option("header", True).csv(f"{path}/csv").count() == facts["n_structures"]
    return listed.groupBy("passed").agg(F.count("*").alias("n"), F.min("structure_id").alias("first"))


@query("SELECT n_regionkey AS edge_count, n_name || chr(9) || r_name || chr(9) || CASE WHEN n_nationkey % 3 = 0 THEN 'inf' WHEN n_nationkey % 3 = 1 THEN '2' ELSE '0.5' END AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def q78_pair_table(spark, d):
    path, k = shared.new_path(spark, "pairs"), F.col("n_nationkey") % 3
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_regionkey").alias("edge_count"), F.col("n_name").alias("leader"), F.col("r_name").alias("member"), F.when(k == 0, float("inf")).when(k == 1, 2.0).otherwise(0.5).alias("distance"))
    sinks.append_pairs(rows.where("edge_count < 2"), path)
    sinks.append_pairs(rows.where("edge_count >= 2"), path)
    return spark.read.parquet(path).select("edge_count", sinks.pair_line().alias("line"))


@query(f"WITH {ATOMS} SELECT structure_id, serial, atom_name, round(x + 0.125, 3) AS x, round(y * 2, 3) AS y, round(-z, 3) AS z, b_factor FROM a")
def q79_rewritten_coordinates(spark, d):
    at = {c: F.substring("line", a, 8).cast("double") for c, a in (("x", 31), ("y", 39), ("z", 47))}
    rows = model_lines(spark, d).withColumn("line", pdb.with_coordinates(F.col("line"), at["x"] + 0.125, at["y"] * 2, -at["z"]))
    text = pdb.file_text(rows)
    again = text.select("structure_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    return pdb.atoms(again, pdb.Dialect(guess_element=False)).select("structure_id", "serial", "atom_name", "x", "y", "z", "b_factor")


@query(f"""WITH {ATOMS} SELECT structure_id, (row_number() OVER (PARTITION BY structure_id ORDER BY line_index))::INT AS serial, CASE WHEN record = 'HETATM' THEN 'DRG' ELSE resname END AS resname,
    CASE WHEN record = 'HETATM' THEN 'L' ELSE chain END AS chain, CASE WHEN record = 'HETATM' THEN 900 ELSE resseq END AS resseq, x FROM a WHERE record = 'ATOM' OR resname <> 'HOH'""")
def q80_complex_lines(spark, d):
    rows = model_lines(spark, d)
    dry = ~F.substring("line", 18, 3).isin("HOH")
    out = sinks.complex_lines(rows.where(F.col("line").startswith("ATOM")), rows.where(F.col("line").startswith("HETATM") & dry), {"resname": "DRG", "chain": "L", "resseq": 900})
    return pdb.atoms(out, pdb.Dialect(guess_element=False)).select("structure_id", "serial", "resname", "chain", "resseq", "x")


@query(f"""WITH {ATOMS} SELECT k, resname || resseq || chain || icode AS residue_key, resname || resseq AS base, {{'ALA': 'A', 'SER': 'S', 'HIS': 'H', 'ASP': 'D'}}[resname] || resseq AS shown,
    {{'ALA': 'A', 'SER': 'S', 'HIS': 'H', 'ASP': 'D'}}[resname] AS letter, 'class-' || lpad(resseq::VARCHAR, 3, '0') AS class FROM a WHERE record = 'ATOM'""".replace("{'ALA': 'A', 'SER': 'S', 'HIS': 'H', 'ASP': 'D'}[resname]", "CASE resname WHEN 'ALA' THEN 'A' WHEN 'SER' THEN 'S' WHEN 'HIS' THEN 'H' ELSE 'D' END"))
def q81_residue_names(spark, d):
    a = every_atom(spark, d).where("record = 'ATOM'").withColumn("key", X.residue_key(*[F.col(c) for c in ("resname", "resseq", "chain", "icode")]))
    base = X.residue_base(F.col("key"))
    k = F.regexp_extract("structure_id", "([0-9]+)", 1).cast("long") * 10 + F.col("line_index")
    return a.select(k.alias("k"), F.col("key").alias("residue_key"), base.alias("base"), X.residue_display(base).alias("shown"), X.one_letter(F.col("resname")).alias("letter"), X.class_name(F.col("resseq"), "class", "-", 3).alias("class"))


NODE = "resname || ':' || CASE WHEN chain = '' THEN '_' ELSE chain END || ':' || resseq || icode || ':' || atom_name"


@query(f"""WITH {ATOMS}, n AS (SELECT *, {NODE} AS key, count(*) OVER (PARTITION BY structure_id, atom_name) > 1 AS again FROM a WHERE {LIGAND})
SELECT structure_id, serial, CASE WHEN row_number() OVER (PARTITION BY structure_id, key ORDER BY serial) > 1 THEN key || '@serial:' || serial ELSE key END AS node_key, atom_name AS label, atom_name || '@serial:' || serial AS by_serial,
    CASE WHEN again THEN resname || '_' || CASE WHEN chain = '' THEN '_' ELSE chain END || resseq || icode || '_' || atom_name ELSE atom_name END AS aware FROM n""")
def q82_ligand_nodes(spark, d):
    a = every_atom(spark, d).where(pdb.is_ligand())
    n = interactions.ligand_nodes(a)
    aware = interactions.ligand_nodes(a, "serial_atom_name", "duplicate_aware_atom_name").select("structure_id", "serial", F.col("node_key").alias("by_serial"), F.col("label").alias("aware"))
    return n.join(aware, ["structure_id", "serial"]).select("structure_id", "serial", "node_key", "label", "by_serial", "aware")


OWN_LABEL = "resname || '_' || CASE WHEN chain = '' THEN '_' ELSE chain END || resseq || icode || '_' || atom_name"


@query(f"""WITH {ATOMS} SELECT structure_id, serial, atom_name AS k_atom_name, atom_name || '@serial:' || serial AS k_serial_atom_name, {NODE} AS k_residue_atom_name, {NODE} || '@serial:' || serial AS k_residue_atom_name_serial,
    atom_name AS l_auto, {NODE} AS l_node_key, {OWN_LABEL} AS l_unique_residue_atom_name, CASE WHEN count(*) OVER (PARTITION BY structure_id, atom_name) > 1 THEN {OWN_LABEL} ELSE atom_name END AS l_atom_name_with_residue_for_duplicates,
    CASE WHEN element <> '' THEN element ELSE atom_name END AS l_element FROM a WHERE {LIGAND}""")
def q171_node_modes(spark, d):
    """Every mode of node keys and of labels."""
    a = every_atom(spark, d).where(pdb.is_ligand())
    c = {n: F.col(n) for n in ("resname", "chain", "resseq", "icode", "atom_name", "serial", "element")}
    place, repeated = (c["resname"], c["chain"], c["resseq"], c["icode"], c["atom_name"]), F.count("*").over(Window.partitionBy("structure_id", "atom_name")) > 1
    keys = [X.ligand_node_key(m, *place, c["serial"]).alias(f"k_{m}") for m in ("atom_name", "serial_atom_name", "residue_atom_name", "residue_atom_name_serial")]
    labels = [X.ligand_label(m, *place, c["element"], repeated).alias(f"l_{m}") for m in ("auto", "node_key", "unique_residue_atom_name", "atom_name_with_residue_for_duplicates", "element")]
    return a.select("structure_id", "serial", *keys, *labels)


@query("""SELECT p_partkey, [1.70, 1.55, 1.52, 1.75, 2.31, 1.70][p_partkey % 6 + 1]::DOUBLE AS r1, [1.70, 1.50, 1.52, 1.50, 1.50, 1.50][p_partkey % 6 + 1]::DOUBLE AS r2 FROM part""".replace("[1.70, 1.50, 1.52", "[1.70, 1.55, 1.52"))
def q83_radii(spark, d):
    element = pick(["C", " n", "o", "Cl", "CA", "XX"], F.col("p_partkey") % 6)
    return t(spark, d, "part").select("p_partkey", X.vdw_radius(element).alias("r1"), X.vdw_radius(element, "standard").alias("r2"))


@query(f"WITH {ATOMS} SELECT structure_id, serial FROM a WHERE record = 'HETATM' AND resname IN ('LIG', 'TMP') AND chain = 'B' AND resseq IN (3, 8, 21, 32) AND atom_name LIKE '%'")
def q84_selected_atoms(spark, d):
    spec = {"record": "hetatm", "resname": ["lig", "TMP"], "chain": "B", "resseq": [3, 8, 21, 32], "icode": None, "atom_name": "*"}
    return every_atom(spark, d).where(X.selector(spec)).select("structure_id", "serial")


@query(f"""WITH {HEAVY} SELECT 'clash protein' AS side, count(*) AS n, sum(k) AS total FROM a WHERE record = 'ATOM' UNION ALL SELECT 'clash ligand', count(*), sum(k) FROM a WHERE record = 'HETATM' AND resname = 'TMP'
UNION ALL SELECT 'sidechain', count(*), sum(k) FROM h WHERE record = 'ATOM' AND atom_name = 'CB' UNION ALL SELECT 'screened ligand', count(*), sum(k) FROM h WHERE record = 'HETATM' AND resname IN ('LIG', 'TMP')
UNION ALL SELECT 'graph ligand', count(*), sum(k) FROM a WHERE record = 'HETATM' AND resname = 'MG'""")
def q85_splits(spark, d):
    a = every_atom(spark, d).withColumn("k", F.regexp_extract("structure_id", "([0-9]+)", 1).cast("long") * 10 + F.col("line_index"))
    protein, ligand = pdb.clash_split(a, ("tmp",))
    side, screened = pdb.screening_split(a, "sidechain", exclude=("mg",))
    parts = {"clash protein": protein, "clash ligand": ligand, "sidechain": side, "screened ligand": screened, "graph ligand": pdb.graph_ligands(a, ("MG",))}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("side"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {ATOMS} SELECT structure_id, serial FROM a WHERE NOT ((resseq BETWEEN 1 AND 20 OR resseq BETWEEN 40 AND 45) AND chain IN ('A', 'B') AND record = 'ATOM')")
def q86_without_regions(spark, d):
    lines = model_lines(spark, d)
    return pdb.atoms(trimming.trimmed_lines(lines, X.residue_ranges("1-20, 40-45"), ["A", "B"]), pdb.Dialect(guess_element=False)).select("structure_id", "serial")


@query(f"""WITH {ATOMS}, {BONDS}, gone AS (SELECT structure_id, serial FROM a WHERE record = 'ATOM' AND resseq <= 25), kept AS (SELECT p.structure_id, p.p, p.q FROM (SELECT DISTINCT structure_id, p, q FROM b) p
    ANTI JOIN gone g ON g.structure_id = p.structure_id AND g.serial = p.q WHERE p <> q) SELECT DISTINCT structure_id, least(p, q) AS u, greatest(p, q) AS v FROM kept""")
def q87_trimmed_bonds(spark, d):
    lines = model_lines(spark, d).select("structure_id", "line_index", "line").union(bond_lines(spark, d))
    return pdb.conect_edges(trimming.trimmed_lines(lines, X.residue_ranges("1-25")))


@query(f"WITH {ATOMS} SELECT structure_id, serial FROM a WHERE NOT (resseq BETWEEN 10 AND 12 OR resseq = 30)")
def q88_residue_ranges(spark, d):
    return trimming.without_regions(every_atom(spark, d), X.residue_ranges("10-12,30")).select("structure_id", "serial")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'input' WHEN 1 THEN 'source_if_available' WHEN 2 THEN 'source_required' WHEN 3 THEN NULL ELSE 'source_if_available' END AS scope,
    CASE s_suppkey % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'vdw' WHEN 2 THEN 'standard' ELSE 'standard' END AS method FROM supplier""")
def q89_choices(spark, d):
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select("s_suppkey", settings.choice_column("score_scope", pick([" Legacy", "original", "full_length_required", "what", ""], k % 5)).alias("scope"), settings.choice_column("clash_method", pick(["article", "Current", "standard", None], k % 4)).alias("method"))


@query(f"""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 90 END AS rank FROM customer)
SELECT k AS c_custkey, row_number() OVER (ORDER BY rank NULLS LAST, k) AS output_rank FROM r""")
def q90_rank_jobs(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.format_string("m%d", k)).otherwise(F.format_string("m%d_rank_%d", k, k % 90))
    return workflow.ranked_models(t(spark, d, "customer").select("c_custkey", name.alias("structure_id"))).select("c_custkey", "output_rank")


RULES = [
    {"rule_id": "metal", "match": {"resname": "MG"}, "action": "keep_all"},
    {"rule_id": "core", "match": {"resname": "TMP", "chain": ["A", "B"]}, "action": "keep_only", "names": ["P2"], "preset": "dtmp_phosphate_core"},
    {"rule_id": "names", "match": {"resname": "LIG"}, "action": "remove_atom_names", "names": ["C1", "C3"]},
    {"rule_id": "rest", "match": {"resname": "HOH"}, "action": "remove_all"},
]
DECIDED = """e AS (SELECT *, CASE WHEN record = 'ATOM' THEN NULL WHEN resname = 'MG' THEN 'metal' WHEN resname = 'TMP' AND chain <> '' THEN 'core' WHEN resname = 'LIG' THEN 'names' WHEN resname = 'HOH' THEN 'rest' END AS rule_id,
    CASE WHEN record = 'ATOM' THEN true WHEN resname = 'MG' THEN true WHEN resname = 'TMP' AND chain <> '' THEN atom_name IN ('P2', 'P') WHEN resname = 'LIG' THEN atom_name NOT IN ('C1', 'C3') WHEN resname = 'HOH' THEN false ELSE true END AS keep_atom FROM a)"""


def decisions(spark, d):
    return trimming.decided(every_atom(spark, d).withColumn("is_ligand", F.col("record") == "HETATM"), RULES)


@query(f"WITH {ATOMS}, {DECIDED} SELECT structure_id, serial, rule_id, keep_atom FROM e")
def q91_trimming_rules(spark, d):
    return decisions(spark, d).select("structure_id", "serial", "rule_id", "keep_atom")


@query(f"""WITH {ATOMS}, {DECIDED} SELECT structure_id, resname, chain, resseq, count(*) AS n_atoms, count(*) FILTER (keep_atom) AS n_kept, bool_and(rule_id = 'core' AND NOT keep_atom) AS emptied FROM e WHERE record = 'HETATM' GROUP BY 1, 2, 3, 4""".replace("bool_and(rule_id = 'core' AND NOT keep_atom)", "coalesce(bool_and(rule_id = 'core' AND NOT keep_atom), false)"))
def q92_trimming_rollup(spark, d):
    found = decisions(spark, d)
    empty = trimming.empty_keep_only(found).select("structure_id", "resname", "chain", "resseq", F.lit(True).alias("emptied"))
    return trimming.residue_rollup(found).join(empty, ["structure_id", "resname", "chain", "resseq"], "left").withColumn("emptied", F.coalesce("emptied", F.lit(False)))


NEAR = """near AS (SELECT l.structure_id, l.line_index, min((l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) + (l.z - p.z) * (l.z - p.z)) AS d2 FROM a l JOIN a p ON p.structure_id = l.structure_id
    WHERE l.record = 'HETATM' AND p.record = 'ATOM' GROUP BY 1, 2)"""


@query(f"""WITH {ATOMS}, {NEAR}, e AS (SELECT a.*, CASE WHEN a.resname = 'TMP' THEN a.atom_name = 'P1' OR d2 <= 9 WHEN a.resname = 'LIG' THEN d2 <= 16 ELSE true END AS keep FROM a JOIN near USING (structure_id, line_index))
SELECT structure_id, n_ligand_atoms, n_kept, n_emptied, n_emptied = 0 AND n_kept > 0 AS passed FROM (SELECT structure_id, count(*) AS n_ligand_atoms, count(*) FILTER (keep) AS n_kept FROM e GROUP BY 1)
JOIN (SELECT structure_id, count(*) FILTER (gone) AS n_emptied FROM (SELECT structure_id, resname, chain, resseq, resname = 'TMP' AND NOT bool_or(keep) AS gone FROM e GROUP BY 1, 2, 3, 4) GROUP BY 1) USING (structure_id)""")
def q93_trimming_stage(spark, d):
    rules = [{"rule_id": "t", "match": {"resname": "TMP"}, "action": "keep_only", "names": ["P1"], "within": 3.0}, {"rule_id": "l", "match": {"resname": "LIG"}, "action": "keep_within_distance", "within": 4.0}]
    return trimming.trimmed_stage(every_atom(spark, d).withColumn("is_ligand", F.col("record") == "HETATM"), rules)[1]


@query(f"""WITH {ATOMS}, {DECIDED}, {BONDS}, j AS (SELECT bonds.structure_id, p.keep_atom AS ku, q.keep_atom AS kv FROM bonds JOIN e p ON p.structure_id = bonds.structure_id AND p.serial = u JOIN e q ON q.structure_id = bonds.structure_id AND q.serial = v)
SELECT structure_id, count(*) FILTER (ku AND kv) AS n_kept, count(*) FILTER (ku <> kv) AS n_cut FROM j GROUP BY 1""")
def q94_cut_bonds(spark, d):
    return trimming.cut_bonds(decisions(spark, d), pdb.conect_edges(bond_lines(spark, d)))


@query(f"""WITH RECURSIVE {ATOMS}, {DECIDED}, {BONDS}, kept AS (SELECT structure_id, serial FROM e WHERE record = 'HETATM' AND keep_atom),
w AS (SELECT bonds.structure_id AS s, u, v FROM bonds SEMI JOIN kept p ON p.structure_id = bonds.structure_id AND p.serial = bonds.u SEMI JOIN kept q ON q.structure_id = bonds.structure_id AND q.serial = bonds.v),
both_ways AS (SELECT s, u, v FROM w UNION SELECT s, v, u FROM w), r(s, node, label) AS (SELECT structure_id, serial, serial FROM kept UNION SELECT r.s, b.v, r.label FROM r JOIN both_ways b ON b.s = r.s AND b.u = r.node WHERE r.label < b.v)
SELECT s AS structure_id, count(DISTINCT label) AS n_components FROM (SELECT s, node, min(label) AS label FROM r GROUP BY 1, 2) GROUP BY 1""")
def q95_ligand_components(spark, d):
    return trimming.ligand_components(decisions(spark, d), pdb.conect_edges(bond_lines(spark, d)))


@query(f"""WITH {ATOMS}, {DECIDED}, {BONDS}, n AS (SELECT structure_id, serial, row_number() OVER (PARTITION BY structure_id ORDER BY line_index) AS new FROM e WHERE keep_atom),
w AS (SELECT bonds.structure_id, least(p.new, q.new) AS u, greatest(p.new, q.new) AS v FROM bonds JOIN n p ON p.structure_id = bonds.structure_id AND p.serial = u JOIN n q ON q.structure_id = bonds.structure_id AND q.serial = v),
x AS (SELECT structure_id, u AS serial, v AS other FROM w UNION ALL SELECT structure_id, v, u FROM w), y AS (SELECT *, (row_number() OVER (PARTITION BY structure_id, serial ORDER BY other) - 1) // 2 AS part FROM x)
SELECT structure_id, serial, part, 'CONECT' || lpad(serial::VARCHAR, 5, ' ') || string_agg(lpad(other::VARCHAR, 5, ' '), '' ORDER BY other) AS line FROM y GROUP BY 1, 2, 3""")
def q96_renumbered_bonds(spark, d):
    return trimming.conect_lines(trimming.renumbered(decisions(spark, d), pdb.conect_edges(bond_lines(spark, d)))[1], 2)


@query(f"""WITH {ATOMS}, l AS (SELECT *, substr(atom_name, 1, 1) AS el, row_number() OVER (PARTITION BY structure_id, atom_name ORDER BY line_index) AS n FROM a WHERE record = 'HETATM'),
u AS (SELECT *, max(substr(atom_name, 2)::INT) OVER (PARTITION BY structure_id, el) AS used, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id, el ORDER BY line_index) AS again FROM l)
SELECT structure_id, serial, CASE WHEN n = 1 THEN atom_name ELSE el || (used + again)::INT END AS new_name FROM u""")
def q97_unique_names(spark, d):
    a = every_atom(spark, d).where("record = 'HETATM'").withColumn("element", F.substring("atom_name", 1, 1))
    return trimming.unique_atom_names(a).select("structure_id", "serial", "new_name")


CA = "ca AS (SELECT *, (row_number() OVER (PARTITION BY structure_id ORDER BY line_index) - 1) AS ordinal FROM (SELECT * FROM a WHERE record = 'ATOM' AND atom_name = 'CA'))"


def chain_atoms(spark, d, size: int):
    """Residues of chains: ``size`` orders are the CA atoms of one structure, in order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    res = pick(["ALA", "SER", "HIS", "ASP"], c % 4)
    return t(spark, d, "orders").select(
        F.floor(k / size).cast("string").alias("structure_id"), F.lit("ATOM").alias("record"), F.lit("CA").alias("atom_name"), F.lit("A").alias("chain"), (k % size).cast("int").alias("resseq"), F.lit("").alias("icode"),
        res.alias("resname"), (k % size).cast("int").alias("line_index"), ((c % 64) / 8).alias("x"), ((k % 32) / 8).alias("y"), ((k + c) % 48 / 8).alias("z"),
    )


CHAIN = """r AS (SELECT (o_orderkey // 20)::VARCHAR AS structure_id, (o_orderkey % 20)::INT AS ordinal, ['ALA', 'SER', 'HIS', 'ASP'][o_custkey % 4 + 1] AS resname, (o_custkey % 64)::DOUBLE / 8 AS x, (o_orderkey % 32)::DOUBLE / 8 AS y,
    ((o_orderkey + o_custkey) % 48)::DOUBLE / 8 AS z FROM orders), tpl AS (SELECT * FROM r WHERE structure_id = '7')"""


@query(f"WITH {CHAIN} SELECT r.structure_id, r.ordinal, tpl.x AS mx, tpl.y AS my, tpl.z AS mz, r.x AS fx, r.y AS fy, r.z AS fz FROM r JOIN tpl USING (ordinal)")
def q98_match_by_order(spark, d):
    r = matching.residues(chain_atoms(spark, d, 20))
    return matching.by_order(r.where("structure_id = '7'"), r).withColumn("ordinal", F.col("ordinal").cast("int"))


@query(f"WITH {CHAIN} SELECT r.structure_id, r.ordinal, tpl.x AS mx, r.x AS fx FROM r JOIN tpl USING (ordinal)")
def q99_match_by_key(spark, d):
    r = matching.residues(chain_atoms(spark, d, 20))
    return matching.by_key(r.where("structure_id = '7'"), r).select("structure_id", F.col("ordinal").cast("int").alias("ordinal"), "mx", "fx")


@query(f"""WITH {CHAIN}, s AS (SELECT structure_id, string_agg(resname, '-' ORDER BY ordinal) AS seq FROM r GROUP BY 1)
SELECT s.structure_id, s.seq = w.seq AS compatible, CASE WHEN s.seq = w.seq THEN 'coordinate_matching' ELSE 'sequence_aware' END AS alignment FROM s CROSS JOIN (SELECT seq FROM s WHERE structure_id = '7') w""")
def q100_compatible(spark, d):
    r = matching.residues(chain_atoms(spark, d, 20))
    c = matching.compatible(r.where("structure_id = '7'"), r)
    return c.join(docking.alignment_modes(c, "auto", "general"), "structure_id")


@query(f"WITH {CHAIN} SELECT t.k::VARCHAR AS structure_id, 1.0::DOUBLE AS identity, 1.0::DOUBLE AS coverage, x AS mx, x + t.k AS fx FROM tpl CROSS JOIN (SELECT s_suppkey AS k FROM supplier) t")
def q101_match_by_sequence(spark, d):
    template = matching.residues(chain_atoms(spark, d, 20)).where("structure_id = '7'")
    copies = template.drop("structure_id").crossJoin(t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))  # twenty residues
    target = copies.withColumns({"structure_id": F.col("k").cast("string"), "x": F.col("x") + F.col("k"), "resseq": F.col("resseq") + 500})
    return matching.by_sequence(template, target).select("structure_id", "identity", "coverage", "mx", "fx")


@query("SELECT p_partkey, 3.0 * length(s) AS score, 1.0::DOUBLE AS identity, length(s) AS n_pairs FROM (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s FROM part)")
def q102_local_alignment(spark, d):
    from ..operators.seqalign import aligned_pairs

    s = F.upper(F.replace("p_name", F.lit(" ")))
    rows = t(spark, d, "part").select("p_partkey", s.alias("a"), F.concat(F.lit("1"), s, F.lit("23")).alias("b"))
    return aligned_pairs(rows, "a", "b", mode="local").select("p_partkey", "score", "identity", F.size("pairs").alias("n_pairs"))


@query("SELECT p_partkey, (2 * length(s) - 2)::DOUBLE AS score, length(s) AS n_pairs FROM (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s FROM part)")
def q43_sequence_align(spark, d):
    from ..operators.seqalign import aligned_pairs

    s = F.upper(F.replace("p_name", F.lit(" ")))
    rows = t(spark, d, "part").select("p_partkey", s.alias("a"), F.concat(s, F.lit("1")).alias("b"))
    return aligned_pairs(rows, "a", "b").select("p_partkey", "score", F.size("pairs").alias("n_pairs"))


@query("""WITH s AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s, length(replace(p_name, ' ', '')) AS n FROM part),
k AS (SELECT p_partkey, n, mode, p_partkey % 3 AS m, CASE mode WHEN 'global' THEN 2 ELSE 3 END AS hit, CASE mode WHEN 'global' THEN -1 ELSE -2 END AS miss, CASE mode WHEN 'global' THEN -2 ELSE -3 END AS gap FROM s CROSS JOIN (VALUES ('global'), ('local')) v(mode))
SELECT p_partkey, mode, CASE m WHEN 0 THEN hit * (n - 1) + miss WHEN 1 THEN hit * (n - 1) + gap ELSE hit * n + 2 * gap END::DOUBLE AS score, CASE m WHEN 1 THEN n - 1 ELSE n END AS n_pairs,
round(CASE m WHEN 0 THEN (n - 1)::DOUBLE / n ELSE 1 END, 9) AS identity FROM k""")
def q166_mutated_alignment(spark, d):
    """Part names against themselves with a letter in the middle replaced, one left out or two put in, globally and locally."""
    from ..operators.seqalign import aligned_pairs

    s = F.upper(F.replace("p_name", F.lit(" ")))
    half, k = F.floor(F.length(s) / 2).cast("int"), F.col("p_partkey") % 3
    head, tail = F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s))
    mutated = F.when(k == 0, F.concat(head, F.lit("#"), F.substring(tail, F.lit(2), F.length(s)))).when(k == 1, F.concat(head, F.substring(tail, F.lit(2), F.length(s)))).otherwise(F.concat(head, F.lit("##"), tail))
    rows, out = t(spark, d, "part").select("p_partkey", s.alias("a"), mutated.alias("b")), None
    for mode in ("global", "local"):
        found = aligned_pairs(rows, "a", "b", mode=mode).select("p_partkey", F.lit(mode).alias("mode"), "score", F.size("pairs").alias("n_pairs"), F.round("identity", 9).alias("identity"))
        out = found if out is None else out.unionByName(found)
    return out


SCORED = f"q AS (SELECT structure_id, avg(b_factor) AS mean FROM a WHERE record = 'ATOM' AND atom_name = 'CA' GROUP BY 1)"


@query(f"WITH {ATOMS}, {SCORED} (SELECT structure_id, 'best' AS chosen FROM q WHERE mean >= 60 ORDER BY mean DESC, regexp_extract(structure_id, '[0-9]+')::BIGINT LIMIT 1) UNION ALL (SELECT structure_id, 'first' FROM q WHERE mean >= 60 ORDER BY regexp_extract(structure_id, '[0-9]+')::BIGINT LIMIT 1)")
def q104_reference_model(spark, d):
    q = workflow.quality(every_atom(spark, d), workflow.Settings(min_global=60.0)).withColumn("input_order", F.regexp_extract("structure_id", "([0-9]+)", 1).cast("long"))
    best = docking.reference_model(q).select("structure_id", F.lit("best").alias("chosen"))
    return best.unionByName(docking.reference_model(q, "first_passed").select("structure_id", F.lit("first").alias("chosen")))


@query(f"WITH {ATOMS} SELECT structure_id, (regexp_extract(structure_id, '[0-9]+')::BIGINT + 1) AS input_order FROM (SELECT DISTINCT structure_id FROM a) ORDER BY 2 LIMIT 25")
def q105_first_structures(spark, d):
    ids = model_lines(spark, d).select("structure_id").distinct().withColumn("input_order", F.regexp_extract("structure_id", "([0-9]+)", 1).cast("long") + 1)
    return screening.first_structures(ids, 25)


@query(f"""WITH {ATOMS} SELECT structure_id, 1 AS group_index, 'cofactor' AS ligand_id, serial, row_number() OVER (PARTITION BY structure_id ORDER BY line_index) AS atom_index FROM a WHERE record = 'HETATM' AND resname = 'TMP'
UNION ALL SELECT structure_id, 2, 'ligand_2', serial, row_number() OVER (PARTITION BY structure_id ORDER BY line_index) FROM a WHERE record = 'HETATM' AND resname IN ('LIG', 'MG') AND chain = 'A'""")
def q106_ligand_groups(spark, d):
    a = every_atom(spark, d)
    return docking.ligand_groups(a, GROUPS).select("structure_id", "group_index", "ligand_id", "serial", "atom_index")


GROUPS = [{"id": "cofactor", "resname": "TMP"}, {"resname": ["LIG", "MG"], "chain": "A"}]


@query(f"""WITH {ATOMS}, g AS (SELECT structure_id, 1 AS g, serial, line_index FROM a WHERE record = 'HETATM' AND resname = 'TMP' UNION ALL SELECT structure_id, 2, serial, line_index FROM a WHERE record = 'HETATM' AND resname IN ('LIG', 'MG') AND chain = 'A')
SELECT structure_id, 1 AS group_index, serial, row_number() OVER (PARTITION BY structure_id ORDER BY g, line_index) AS atom_index FROM g""")
def q107_rigid_assembly(spark, d):
    a = every_atom(spark, d)
    return docking.rigid_assembly(docking.ligand_groups(a, GROUPS)).select("structure_id", "group_index", "serial", "atom_index")


@query(f"WITH {ATOMS} SELECT s.structure_id, 'p' AS side, count(*) AS n FROM a s WHERE record = 'ATOM' GROUP BY 1 UNION ALL SELECT structure_id, 'l', count(*) FROM a WHERE {LIGAND} GROUP BY 1")
def q108_template_split(spark, d):
    p, lig = docking.template_split(every_atom(spark, d))
    count = lambda df, s: df.groupBy("structure_id").agg(F.count("*").alias("n")).select("structure_id", F.lit(s).alias("side"), "n")
    return count(p, "p").unionByName(count(lig, "l"))


@query(f"""WITH {ATOMS}, f AS (SELECT structure_id, resname, min(line_index) AS seen FROM a WHERE record = 'HETATM' GROUP BY 1, 2)
SELECT (regexp_extract(structure_id, '[0-9]+')::INT + 1) AS docking_order, structure_id AS active, CASE WHEN regexp_extract(structure_id, '[0-9]+')::INT % 2 = 0 THEN 'raw/' || structure_id ELSE structure_id END AS source, 'before_docking_trim' AS branch, string_agg(resname, ';' ORDER BY seen) AS resnames FROM f GROUP BY structure_id""")
def q109_order_manifest(spark, d):
    n = F.regexp_extract("structure_id", "([0-9]+)", 1).cast("int")
    lig = every_atom(spark, d).where("record = 'HETATM'").select((n + 1).alias("docking_order"), F.col("structure_id").alias("active"), "line_index", "resname")
    trimmed = lig.where((F.col("docking_order") - 1) % 2 == 0).select("active", F.concat(F.lit("raw/"), "active").alias("source")).distinct()
    return docking.order_manifest(lig, trimmed)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x.' ELSE '' END || 'm' || c_custkey AS matched_id, c_nationkey FROM customer".replace("CASE WHEN c_custkey % 3 = 0 THEN 'x.' ELSE '' END || 'm' || c_custkey", "'m' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_complex_final' ELSE '' END"))
def q110_candidate_ids(spark, d):
    k = F.col("c_custkey")
    m = F.concat(F.lit("m"), k.cast("string"))
    records = t(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, m).otherwise(F.concat(F.lit("other"), k.cast("string"))).alias("structure_id"), F.concat(F.lit("out/"), m, F.lit("_trimmed_complex.pdb")).alias("path"))
    keyed = t(spark, d, "customer").select(F.concat(m, F.when(k % 3 == 0, "_complex_final").otherwise("")).alias("structure_id"), "c_nationkey")
    return docking.by_candidate_ids(records, keyed).select("c_custkey", "matched_id", "c_nationkey")
