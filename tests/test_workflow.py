"""The stage DAG, chemistry, trimming, placement and the streaming extension on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_structures import atom

from confora.operators import chemistry, placement, trimming
from confora.plans import workflow as W
from confora.sources import pdb
from confora.streaming import quality as S


def test_steps():
    assert W.select_steps("classify") == ["06", "07", "08"]
    assert W.select_steps("all", "step03", "5") == ["03", "04", "05"]
    with pytest.raises(ValueError):
        W.select_steps("none")


def frame(spark, rows):
    schema = "structure_id string, line_index int, record string, serial int, atom_name string, altloc string, resname string, chain string, resseq int, icode string, x double, y double, z double, occupancy double, b_factor double, element string"
    return spark.createDataFrame(rows, schema)


def a(s, i, name, res, seq, x, y=0.0, z=0.0, b=95.0, record="ATOM", el="C"):
    return (s, i, record, i, name, "", res, "A", seq, "", x, y, z, 1.0, b, el)


def test_stages(spark):
    rows = [a("s1", 1, "CA", "SER", 1, 0.0), a("s1", 2, "CB", "SER", 1, 1.5, b=10.0), a("s1", 3, "CA", "GLY", 2, 30.0, b=50.0), a("s1", 4, "C1", "LIG", 9, 4.0, record="HETATM"), a("s2", 1, "CA", "SER", 1, 0.0), a("s2", 2, "C1", "LIG", 9, 1.0, record="HETATM")]
    atoms, s = frame(spark, rows), W.Settings(max_clashes=0)
    assert {r.structure_id: (r.mean, r.passed) for r in W.quality(atoms, s).collect()} == {"s1": (72.5, False), "s2": (95.0, True)}
    _, v = W.clash_verdicts(atoms, s)
    assert {r.structure_id: (r.clash_count, r.passed) for r in v.collect()} == {"s1": (1, False), "s2": (1, False)}
    assert {r.structure_id: (r.mean, r.passed) for r in W.region_verdicts(atoms, s).collect()} == {"s1": (95.0, True), "s2": (95.0, True)}
    contacts = W.residue_contacts(atoms, s)
    edges = spark.createDataFrame([("s1", "LIG:C1", "SER1"), ("s2", "LIG:C1", "SER1")], "structure_id string, ligand string, residue string")
    cons = spark.createDataFrame([("SER1", 9), ("TRP5", 9)], "residue string, grade int")
    k = {r.residue: r.key for r in W.key_residues(contacts, edges, cons, atoms.select("structure_id").distinct(), s).collect()}
    assert k == {"SER1": True, "GLY2": False, "TRP5": False}
    kept = W.kept_structures(edges, ["SER1"], s).where("passed")
    assert [(r.structure_id, r.class_number, r.leader) for r in W.classes(edges, kept).orderBy("structure_id").collect()] == [("s1", 1, "s1"), ("s2", 1, "s1")]


def molecules(spark, **named):
    """Residues from text: bonds as ``A-B``, single atoms as ``A``; an atom's element are its capital letter, or the whole name of a metal. Rings are laid out flat, other atoms on a helix."""
    atoms, bonds, serial = [], [], 0
    for seq, (res, text) in enumerate(named.items(), 1):
        pairs = [x.split("-") for x in text.split()]
        names = list(dict.fromkeys(n for p in pairs for n in p))
        at = {n: serial + i for i, n in enumerate(names, 1)}
        serial += len(names)
        for n, i in at.items():
            turn = 2 * np.pi * (i - min(at.values())) / len(names)
            height = 0.0 if res.startswith("R") else 0.7 * i  # names of flat molecules begin with R
            row = list(a("s", i, n, res, seq, float(np.cos(turn)) + 40 * seq, float(np.sin(turn)), record="HETATM", el=n if len(names) == 1 and n in chemistry.METALS else n[0]))
            row[12] = height
            atoms.append(tuple(row))
        bonds += [("s", at[p[0]], at[p[1]]) for p in pairs if len(p) == 2]
    return frame(spark, atoms), spark.createDataFrame(bonds, "structure_id string, u int, v int")


def test_contact_units(spark):
    found = chemistry.contact_units(
        *molecules(
            spark,
            SUC="OA-CA OB-CA CA-CB CB-CC CC-CD CD-OC CD-OD",  # two carboxylates joined by two carbons
            TRI="PX-OXA PX-OXB PX-OXY PY-OXY PY-OYA PY-OYZ PZ-OYZ PZ-OZA PZ-OZB",  # three phosphates
            MSO="CM-SM SM-OM SM-ON SM-OP",
            DMS="CP-SP CQ-SP SP-OQ SP-OR",
            NET="CE-CF CF-NE NE-OE NE-OF",
            GUM="CG-NG CG-NH CG-NI NI-CH",
            RPY="NA-CA CA-CB CB-CC CC-CD CD-CE CE-NA",  # pyridine
            FUR="OQ-CQ CQ-CR CR-CS CS-CT CT-OQ CR-OR CS-OS",
            HEX="CA-CB CB-CC CC-CD CD-CE CE-CF",
            ZNC="ZN",
            AMM="NZ",
        )
    )
    rows = found.collect()
    u = {(r.resname, r.atom_name): r.unit for r in rows}
    together = lambda res, *names: {u[res, n] for n in names}
    assert together("SUC", "OA", "OB") == {"SUC carboxylate oxygen 1 unit"} and together("SUC", "OC", "OD") == {"SUC carboxylate oxygen 2 unit"}
    assert together("TRI", "PX", "OXA", "OXB") == {"TRI phosphate 1 unit"} and together("TRI", "PZ", "OZA", "OZB") == {"TRI phosphate 3 unit"}
    assert (u["TRI", "OXY"], u["TRI", "OYZ"]) == ("TRI phosphate 1–2 bridging oxygen", "TRI phosphate 2–3 bridging oxygen")
    assert together("MSO", "OM", "ON", "OP") == {"MSO sulfate/sulfonate oxygen unit"} and together("DMS", "OQ", "OR") == {"DMS sulfonyl oxygen unit"}
    assert together("NET", "OE", "OF") == {"NET nitro oxygen unit"} and together("GUM", "NG", "NH") == {"GUM delocalized nitrogen unit"}
    assert together("RPY", "CA", "CC", "CE") == {"RPY aromatic ring unit"} and u["RPY", "NA"] == "RPY NA site"
    assert together("FUR", "CQ", "CR", "CS", "CT") == {"FUR sugar-ring carbon unit"} and together("HEX", "CA", "CF") == {"HEX aliphatic carbon unit"}
    assert (u["ZNC", "ZN"], u["AMM", "NZ"]) == ("Zn2+ ion", "AMM NZ site")
    assert len({r.rule for r in rows}) == 12 and len(rows) == len(u)
    alone = {r.atom_name: r.unit for r in chemistry.contact_units(*molecules(spark, FOR="CX-OX CX-OY")).collect()}
    assert alone == {"CX": "CX site", "OX": "Carboxylate oxygen unit", "OY": "Carboxylate oxygen unit"}


def test_equivalence(spark):
    contacts = spark.createDataFrame([("a", "L:O1", "hydrogen_bond", "S1"), ("b", "L:O2", "salt_bridge", "S1"), ("c", "L:C1", "hydrophobic", "V2")], "structure_id string, atom_key string, type string, residue string")
    units = spark.createDataFrame([("L:O1", "oxygen"), ("L:O2", "oxygen")], "atom_key string, unit string")
    edges = chemistry.canonical_edges(contacts, units)
    assert {r.edge for r in edges.collect()} == {"oxygen | Polar contact | S1", "L:C1 | Hydrophobic contact | V2"}
    cl = spark.createDataFrame([("a", "class_1"), ("b", "class_2"), ("c", "class_3")], "structure_id string, class string")
    m = {r.structure_id: r.merged_class for r in chemistry.merged_classes(chemistry.class_signatures(edges, cl), cl).collect()}
    assert m == {"a": "class_1", "b": "class_1", "c": "class_2"}
    f = chemistry.edge_frequencies(edges, cl, common=0.6, rare=0.4)
    out = chemistry.candidates(edges.join(cl, "structure_id"), f, cl)
    assert {r["class"]: r.is_candidate for r in out.collect()} == {"class_1": True, "class_2": True, "class_3": False}


def test_trimming(spark):
    atoms = frame(spark, [a("s", 1, "CA", "SER", 1, 0.0), a("s", 2, "C1", "LIG", 9, 1.0, record="HETATM"), a("s", 3, "C2", "LIG", 9, 2.0, record="HETATM"), a("s", 4, "O1", "LIG", 9, 3.0, record="HETATM", el="O")]).withColumn("is_ligand", pdb.is_ligand())
    rules = [{"rule_id": "r1", "match": {"resname": "LIG"}, "action": "keep_only", "names": ["C1", "O1"]}, {"rule_id": "r2", "action": "remove_all"}]
    d = trimming.decided(atoms, rules)
    assert {r.atom_name: (r.keep_atom, r.rule_id) for r in d.collect()} == {"CA": (True, None), "C1": (True, "r1"), "C2": (False, "r1"), "O1": (True, "r1")}
    bonds = spark.createDataFrame([("s", 2, 3), ("s", 2, 4)], "structure_id string, u int, v int")
    _, b = trimming.renumbered(d, bonds)
    assert [(r.u, r.v) for r in b.collect()] == [(2, 3)]
    assert [(r.n_kept, r.n_cut) for r in trimming.cut_bonds(d, bonds).collect()] == [(1, 1)]
    assert "CONECT    2    3" in {r.line for r in trimming.conect_lines(b).collect()}
    bad = trimming.decided(atoms, [{"rule_id": "x", "action": "keep_only", "names": ["ZZ"]}])
    assert trimming.empty_keep_only(bad).first().atom_names == "C1,C2,O1"
    with pytest.raises(ValueError):
        trimming.decided(atoms, [{"rule_id": "x", "action": "keep_only"}])
    assert trimming.without_regions(atoms, [(9, 9)]).count() == 1
    with pytest.raises(Exception, match="nothing left"):
        trimming.without_regions(atoms, [(1, 9)]).collect()


def test_placement(spark):
    wall = np.array([[0.0, 0.0, 0.0]])
    moved, trace = placement.relieved(wall, np.array([[0.5, 0.0, 0.0], [1.9, 0.0, 0.0]]))
    assert placement.collisions(wall, moved, 2.0)[0] == 0 and trace
    again, _ = placement.relieved(wall, np.array([[0.5, 0.0, 0.0], [1.9, 0.0, 0.0]]))
    assert (moved == again).all()
    t = spark.createDataFrame([("s", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [10.0, 0.0, 0.0])], "structure_id string, rotation array<double>, translation array<double>")
    p = spark.createDataFrame([("s", 0.0, 0.0, 0.0)], "structure_id string, x double, y double, z double")
    lig = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0)], "group_index int, atom_index int, x double, y double, z double")
    atoms, tr, audit = placement.placed(t, p, lig)
    assert [tuple(r)[3:] for r in atoms.collect()] == [(11.0, 2.0, 3.0)] and tr.count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m1.pdb").write_text(atom(1, "CA", "ALA", "A", 1, 0.0, b=70.0) + "\n" + atom(2, "CA", "ALA", "A", 2, 0.0, b=90.0) + "\n")
    q = S.score_arrivals(S.model_stream(spark, f"file://{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").select("structure_id", "mean").collect() == [("m1", 80.0)]
    e = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 01:10:00", 3.0)], "t string, value double").select(F.to_timestamp("t").alias("ts"), "value")
    assert sorted((r.n, r.total) for r in S.windowed(e, "1 hour").collect()) == [(1, 3.0), (2, 3.0)]


def test_components_cover_every_edge_with_whole_keys(spark, tmp_path):
    """Orders 1 and 5001 are two nodes, and rows of any quantity and discount are edges."""
    from confora.plans import catalog

    rows = [(1, 10, 50, 0.0), (1, 11, 3, 0.05), (5001, 12, 50, 0.0), (5001, 13, 7, 0.1), (7, 13, 20, 0.0), (9, 14, 1, 0.02)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity int, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {n: n for o, s, _, _ in rows for n in (f"O{o}", f"S{s}")}
    for _ in want:
        for o, s, _, _ in rows:
            want[f"O{o}"] = want[f"S{s}"] = min(want[f"O{o}"], want[f"S{s}"])
    got = {r.node: r.component for r in catalog.QUERIES["q38_connected_components"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(got.values())) == 3


def test_classes_where_labels_repeat(spark):
    from confora.operators.leaders import leader_classes

    labels = {"a": "C1", "b": "C1", "r": "R1", "s": "S1"}
    rows = [(1, [("a", "r")], 1), (2, [("b", "r")], 1), (3, [("a", "s")], 1)]
    g = spark.createDataFrame(rows, "id int, edges array<struct<u:string,v:string>>, edge_count int")
    led = lambda t: {(r.id, r.leader) for r in leader_classes(g, "id", labels, [F.col("id")], t).collect()}
    assert led(1.0) == {(1, 1), (2, 1), (3, 3)} and led(3.0) == {(1, 1), (2, 1), (3, 1)}
    nodes = spark.createDataFrame(list(labels.items()), "node_key string, label string")
    edges = spark.createDataFrame([("s1", "a", "r"), ("s2", "b", "r"), ("s3", "a", "s"), ("s4", "a", "r"), ("s4", "b", "r")], "structure_id string, ligand string, residue string")
    found = lambda *x: {(r.structure_id, r.class_number, r.leader) for r in W.classes(edges, edges.select("structure_id").distinct(), *x).collect()}
    assert found(nodes) == {("s4", 1, "s4"), ("s1", 2, "s1"), ("s2", 2, "s1"), ("s3", 3, "s3")}
    assert found(nodes, 3.0) == {("s4", 1, "s4"), ("s1", 2, "s1"), ("s2", 2, "s1"), ("s3", 2, "s1")}
    assert len(found(nodes.withColumn("label", F.col("node_key")))) == len(found()) == 4
    assert {n for _, n, _ in found(nodes.withColumn("label", F.col("node_key")))} == {1, 2, 3, 4}
