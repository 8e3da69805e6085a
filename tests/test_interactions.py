"""Resolving contacts, node keys, stable labels and sinks."""

from pyspark.sql import functions as F

from confora.operators import interactions as I
from confora.operators import labels
from confora.sources import sinks


def test_nodes_bonds_and_cascade(spark):
    atoms = spark.createDataFrame(
        [("s", 1, "O1", "LIG", "A", 9, "", "O", 0.0, 0.0, 0.0), ("s", 2, "O1", "LIG", "A", 9, "", "O", 1.2, 0.0, 0.0), ("s", 3, "MG", "MG", "A", 10, "", "MG", 9.0, 0.0, 0.0)],
        "structure_id string, serial int, atom_name string, resname string, chain string, resseq int, icode string, element string, x double, y double, z double",
    )
    assert [r.node_key for r in I.ligand_nodes(atoms).orderBy("serial").collect()] == ["LIG:A:9:O1", "LIG:A:9:O1@serial:2", "MG:A:10:MG"]
    assert [r.label for r in I.ligand_nodes(atoms, label_mode="duplicate_aware_atom_name").orderBy("serial").collect()] == ["LIG_A9_O1", "LIG_A9_O1", "MG"]
    none = spark.createDataFrame([], "structure_id string, u int, v int")
    assert [(r.u, r.v, r.edge_type) for r in I.ligand_bonds(atoms, none).collect()] == [(1, 2, "distance")]
    c = spark.createDataFrame(
        [("s", 1, 2, [7], "LIG", "A", 9, 0.0, 0.0, 0.0), ("s", 2, 99, [98, 1], "LIG", "A", 9, 5.0, 0.0, 0.0), ("s", 3, None, [], "MG", "A", 10, 0.0, 0.0, 0.0), ("s", 4, None, [], "X", "A", 1, 1.1, 0.1, 0.0), ("s", 5, None, None, "X", "A", 1, 50.0, 0.0, 0.0)],
        "structure_id string, contact_id int, ligand_serial int, ligand_serials array<int>, resname string, chain string, resseq int, x double, y double, z double",
    )
    got = {r.contact_id: (r.serial, r.resolved_by) for r in I.resolved_contacts(c, atoms).collect()}
    assert got == {1: (2, "index"), 2: (1, "index_list"), 3: (3, "residue"), 4: (2, "coordinates"), 5: (None, "unresolved")}


def test_ordering_and_fallback(spark):
    e = spark.createDataFrame([("s", "B", 1), ("s", "A", 2), ("s", "B", 3)], "s string, n string, o int")
    assert I.ordered_nodes(e, "s", "n", "o").first().nodes == ["B", "A"]
    r = spark.createDataFrame([("A", 1), ("B", 1), ("C", 7)], "chain string, resseq int")
    v = spark.createDataFrame([("A", 1, 10.0), ("D", 1, 30.0)], "chain string, resseq int, v double")
    got = {x.chain: (x.v, x.match_mode) for x in I.scores_with_fallback(r, v, ["chain", "resseq"], ["resseq"], "v").collect()}
    assert got == {"A": (10.0, "exact"), "B": (20.0, "chain_insensitive"), "C": (None, "missing")}
    d = spark.createDataFrame([("m10", "R"), ("m9", "R"), ("m9", "R")], "structure_id string, residue string")
    assert I.residue_details(d).first().structures == ["m9", "m10"]


def test_stable_labels(spark):
    cur = spark.createDataFrame([("c1", "a", "a"), ("c1", "b", "a"), ("c2", "c", "c"), ("c3", "d", "d"), ("c3", "e", "d"), ("c3", "f", "d"), ("c3", "g", "d")], "class string, structure_id string, representative string")
    ref = spark.createDataFrame([("class_4", "a", "a"), ("class_4", "b", "a"), ("class_7", "d", "d"), ("class_7", "x", "d"), ("class_7", "y", "d"), ("class_9", "z", "z")], "reference_class string, structure_id string, representative string")
    got = {(r.current_class, r.reference_class): (r.assigned_class, r.match_type) for r in labels.stable_labels(cur, ref).collect()}
    assert got == {("c1", "class_4"): ("class_4", "exact_member_set"), ("c3", "class_7"): ("class_7", "reference_representative_retained"), ("c2", ""): ("class_10", "new_class_appended"), ("", "class_9"): ("", "reference_class_not_present")}
    out = labels.relabelled(cur.select("class", "structure_id"), labels.stable_labels(cur, ref))
    assert {r["class"] for r in out.collect()} == {"class_4", "class_7", "class_10"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", True, ["x", "y"]), ("b", False, [])], "structure_id string, passed boolean, l array<string>")
    sinks.stage_tables(df, f"{tmp_path}/s", csv=True)
    assert [r.structure_id for r in spark.read.parquet(f"{tmp_path}/s/table").where("passed = 'true'").collect()] == ["a"]
    assert sinks.report(df, f"{tmp_path}/s", "03", max_clashes=10)["n_failed"] == 1
    sinks.id_list(df.where("passed"), f"{tmp_path}/ids")
    assert [r.value for r in spark.read.text(f"{tmp_path}/ids").collect()] == ["a"]
    files = spark.createDataFrame([("a", "pdb", 2, "/x/long"), ("a", "pdb", 1, "/y")], "structure_id string, kind string, score int, path string")
    got = {r.structure_id: (r.pdb, r.notes) for r in sinks.export_index(df.select("structure_id"), files, ["pdb"]).collect()}
    assert got == {"a": ("/y", ""), "b": (None, "no pdb file")}
    p = spark.createDataFrame([("a", 5, "ATOM")], "structure_id string, line_index int, line string")
    lig = spark.createDataFrame([("a", 1, "HETATM")], "structure_id string, line_index int, line string")
    assert [r.line.split() for r in sinks.complex_lines(p, lig).orderBy("line_index").collect()] == [["ATOM", "1"], ["HETATM", "2"], ["END"]]
