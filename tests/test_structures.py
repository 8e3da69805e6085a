"""Structure files, conservation scores, geometry and graphs on small fixtures with known answers."""

import gzip
import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from confora.functions import expressions as X
from confora.operators import graphs, proximity, scores, screening
from confora.operators.seqalign import align
from confora.operators.superpose import kabsch, rmsd
from confora.sources import conservation, pdb, tables


def atom(serial, name, resname, chain, resseq, x, y=0.0, z=0.0, b=90.0, record="ATOM", element="", altloc=" "):
    return f"{record:<6}{serial:>5} {name:^4}{altloc}{resname:>3} {chain}{resseq:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{b:6.2f}          {element:>2}"


@pytest.fixture()
def complexes(spark, tmp_path):
    rows = [atom(i, "CA", "ALA", "A", i, i, b=b, element="C") for i, b in ((1, 50), (2, 50), (3, 90), (4, 90))]
    rows += [atom(5, "C1", "LIG", "A", 501, 4.0, 1.0, record="HETATM", element="C"), atom(6, "O1", "LIG", "A", 501, 4.0, 2.2, record="HETATM", element="O"), "CONECT    5    6", "CONECT    6    5", "END"]
    (tmp_path / "m_rank_002_model_3_seed_7.pdb").write_text("\n".join(rows) + "\n")
    return pdb.lines(spark, f"file://{tmp_path}")


def test_quality_and_threshold(complexes):
    a = pdb.atoms(complexes, pdb.STRICT).where("atom_name = 'CA'")
    s = scores.score_summary(a, ["structure_id"], "b_factor").first()
    assert (s.mean, s.n_values) == (70.0, 4)


def test_strict_raises_and_lenient_skips(spark):
    bad = spark.createDataFrame([("s", "f", 0, "ATOM      1  CA  ALA A   x       1.0     1.0     1.0  1.00 50.00")], "structure_id string, file string, line_index int, line string")
    assert pdb.atoms(bad, pdb.LENIENT).count() == 0
    with pytest.raises(Exception, match="bad atom line"):
        pdb.atoms(bad, pdb.STRICT).collect()


def test_bonds_names_and_rewrite(spark, complexes):
    assert [tuple(r)[1:] for r in pdb.conect_edges(complexes).collect()] == [(5, 6)]
    sid = F.col("structure_id")
    m = complexes.select(*[v.alias(k) for k, v in pdb.file_metadata(sid).items()], pdb.prediction_index(sid).alias("i")).first()
    assert (m["rank"], m.model, m.seed, m.i) == (2, 3, 7, 3)
    moved = complexes.where("line like 'ATOM%'").select(pdb.with_coordinates(F.col("line"), F.lit(-1.5), F.lit(2.0), F.lit(1234.5678)).alias("line")).first()[0]
    assert (moved[30:54], moved[:30], len(moved)) == ("  -1.500   2.0001234.568", atom(1, "CA", "ALA", "A", 1, 1)[:30], 78)


def test_clash_boundary_is_strict(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.7)], "s int, x double, y double, z double, radius double")
    lig = spark.createDataFrame([(1, 2.899, 0.0, 0.0, 1.7), (1, 2.9, 0.0, 0.0, 1.7)], "s int, x double, y double, z double, radius double")
    c = proximity.overlaps(proximity.structure_join(p, lig, ["s"]), 0.5).select("clash", F.col("r.x").alias("rx")).orderBy("rx").collect()
    assert [r.clash for r in c] == [True, False]


def test_voxel_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(150, 3)) * 3, rng.normal(size=(120, 3)) * 3
    frame = lambda m: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(m)], "i int, x double, y double, z double")
    found = {(r.a, r.b) for r in proximity.voxel_join(frame(a), frame(b), 1.3).select(F.col("l.i").alias("a"), F.col("r.i").alias("b")).collect()}
    d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert found == {tuple(map(int, x)) for x in np.argwhere(d2 <= 1.3**2)}


def test_region_thresholds_are_strict(spark):
    rows = spark.createDataFrame([("a", 1, "CA", 90.0), ("b", 1, "CB", 91.0), ("b", 1, "N", 93.0)], "s string, r int, atom string, v double")
    out = {r.s: (r.mean, r.passed) for r in scores.region_summary(rows, ["s"], ["r"], "v", F.col("atom") == "CA").collect()}
    assert out == {"a": (90.0, False), "b": (92.0, True)}
    assert scores.region_summary(rows, ["s"], ["r"], "v", F.col("atom") == "CA", strict=False).where("s = 'a'").first().passed


def test_region_p10_at_its_threshold(spark):
    """A p10 of 52 is not above 52: the steps between two values are the ones of numpy's percentile, with groups in a buffer and refined."""
    groups = {"a": [51.0, 56.0, 79.0], "b": [50.0, 70.0], "c": [51.0, 61.0], "d": [49.0, 59.0, 60.0, 80.0], "e": [52.0], "f": [51.0, 56.5, 79.0]}
    rows = spark.createDataFrame([(s, i, "CA", v) for s, vs in groups.items() for i, v in enumerate(vs)], "s string, r int, atom string, v double")
    out = {r.s: (r.p10, r.passed) for r in scores.region_summary(rows, ["s"], ["r"], "v", F.col("atom") == "CA", 50.0, 52.0).collect()}
    assert out == {s: (float(np.percentile(v, 10)), s == "f") for s, v in groups.items()}
    rng = np.random.default_rng(4)
    groups = {i: [float(x) for x in (rng.integers(50, 99, n) if i % 2 else rng.normal(60, 9, n))] for i, n in enumerate(rng.integers(1, 40, 200))}
    rows = spark.createDataFrame([(i, x) for i, v in groups.items() for x in v] + [(900, None)], "s int, v double")
    for hot in (None, 10):
        p10 = {r.s: r.p10 for r in scores.score_summary(rows, ["s"], "v", hot=hot).collect()}
        assert p10 == {i: float(np.percentile(v, 10)) for i, v in groups.items()} | {900: None}


def test_set_types_and_filters(spark):
    e = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (2, "A"), (2, "B"), (3, "B"), (3, "A"), (3, "A")], "s int, n string")
    sets = screening.node_sets(e, "s", "n")
    types = {r.type_number: (r.nodes, r.n_structures) for r in screening.set_types(sets, "s").collect()}
    assert types == {1: (["A", "B", "C"], 1), 2: (["A", "B"], 2)}
    assert screening.structure_filter(sets, ["A", "C"]).where("passed").count() == 1
    assert screening.structure_filter(sets, ["A", "C"], "any").where("passed").count() == 3
    assert screening.structure_filter(sets, []).where("passed").count() == 0


def test_leader_clustering(spark):
    from confora.operators.leaders import leader_classes

    g = spark.createDataFrame([(1, [(0, 1)], 1), (2, [(0, 1)], 1), (3, [(0, 2)], 1), (4, [(0, 1), (0, 2)], 2)], "id int, edges array<struct<u:int,v:int>>, edge_count int")
    out = leader_classes(g, "id", {0: "a", 1: "b", 2: "c"}, [F.col("id")])
    assert {(r.id, r.leader) for r in out.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "u int, v int")
    assert {r.node: r.component for r in graphs.components(e).collect()} == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_kabsch_and_alignment():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    y = x @ q + 5
    r, t = kabsch(x, y)
    assert rmsd(x @ r + t, y) < 1e-9 and np.linalg.det(r) == pytest.approx(1)
    assert align("ACDEG", "CDE", "local", 3, -2, -3) == (9.0, [(1, 0), (2, 1), (3, 2)])
    assert align("ABC", "ABC")[0] == 6.0


def test_names(spark):
    d = spark.createDataFrame([("model_09", "ASN317", " a b%c ")], "n string, r string, g string")
    row = d.select(X.shift_last_integer(F.col("n"), 2), X.natural_key(F.col("n")), X.residue_display(F.col("r")), X.graph_token(F.col("g")), X.last_integer(F.lit("none"))).first()
    assert tuple(row) == ("model_11", "model_000000000009", "N317", "a_b_c", 10**12)
    assert X.residue_ranges("1-3, 9") == [(1, 3), (9, 9)]
    for wrong in ("9-1", "", "a"):
        with pytest.raises(ValueError):
            X.residue_ranges(wrong)


GRADES = """ 1 M - -0.5 5 -0.6,-0.4 5,5 e 10/150 M 98%
 18 C CYS:134:A -1.190 9* -1.303, -1.135 9,9 b s 96/150 C 98%
"""


def test_grade_containers(spark, tmp_path):
    plain = gzip.compress(GRADES.encode())
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("deep/x_consurf_grades.txt", GRADES)
        f.writestr("notes_grades.txt", "no")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("consurf_grades.txt")
        info.size = len(GRADES.encode())
        f.addfile(info, io.BytesIO(GRADES.encode()))
    assert {conservation.grade_text(x) for x in (plain, z.getvalue(), t.getvalue(), GRADES.encode())} == {GRADES}
    (tmp_path / "g.gz").write_bytes(t.getvalue())
    assert [r.residue_key for r in conservation.load(spark, f"file://{tmp_path}/g.gz").collect()] == ["CYS134A"]


def test_archives_of_a_folder(spark, tmp_path):
    """Many proteins at once, in archives of several kinds; each file decides for itself whether rows without a residue count; one without a table fails the read."""
    import io
    import tarfile
    import zipfile

    import pytest

    note, plain = " 1 C CYS:1:A 0.5 9 b f 9/9 C\n 2 A - 0.5 8 b f 9/9 A\n", " 1 K 0.1 3 e f 1/2 K\n 2 A 0.1 4 e f 1/2 A\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/consurf_grades.txt", note)
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("grades.txt")
        info.size = len(plain)
        t.addfile(info, io.BytesIO(plain.encode()))
    (tmp_path / "c.grades").write_text(note)
    got = {(r.file, r.residue_key, r.grade) for r in conservation.load_folder(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.zip", "CYS1A", 9), ("b.tar.gz", "LYS1A", 3), ("b.tar.gz", "ALA2A", 4), ("c.grades", "CYS1A", 9)}
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("readme.txt", "x")
    with pytest.raises(Exception, match="no grade table"):
        conservation.load_folder(spark, f"file://{tmp_path}", "d.zip").count()


def test_mapping_rejects_conflicts(spark):
    res = spark.createDataFrame([("CYS", "A", 1, "", "CYS1A")], "resname string, chain string, resseq int, icode string, residue_key string")
    rows = spark.createDataFrame([(1, "C", "CYS", "A", 11, "", 0.0, 9, "x"), (2, "C", "CYS", "A", 11, "", 0.0, 8, "x")], conservation.SCHEMA)
    out = conservation.mapped(conservation.keyed(rows), res, offsets={"A": -10}).collect()
    assert [(r.status, r.target_key) for r in out] == [("conflict", None)] * 2


def test_reports(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<report><bindingsite><interactions><hydrogen_bonds><hydrogen_bond id='1'><resnr>10</resnr><restype>SER</restype><reschain>A</reschain><dist_h-a>2.1</dist_h-a></hydrogen_bond></hydrogen_bonds><pi_stacks/></interactions></bindingsite></report>")
    (tmp_path / "b.txt").write_text("Type: hbond\tLigand: O1\tProtein: SER10A\tLigandNodeKey: LIG:A:501:O1\n")
    r = tables.plip_report(spark, f"file://{tmp_path}").first()
    assert (r.kind, r.resnr, r.restype, r.dist) == ("hydrogen_bonds", 10, "SER", 2.1)
    assert tables.interaction_lines(spark, f"file://{tmp_path}").first().ligand_node_key == "LIG:A:501:O1"
    assert tables.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/a.xml"]).endswith("a.xml")
    df = spark.createDataFrame([("c1", "m_3", "m_3")], "Class string, structure_id string, representative_id string")
    assert tables.class_manifest(df, 4).first().structure_id == "m_7"
