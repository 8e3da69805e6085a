"""A project from its configuration, end to end: placement into models, filters, screening, classes, candidates; resumption and batches."""

import pytest
from test_structures import atom

from confora.__main__ import parser
from confora.plans import runner, workflow
from confora.sources import sinks


def line(i, name, res, seq, xyz, record="ATOM", b=95.0):
    text = atom(i, name, res, "A", seq, 0.0, b=b)
    return f"{record:<6}" + text[6:30] + "%8.3f%8.3f%8.3f" % xyz + text[54:]


PLACES = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0), (0.0, 4.0, 4.0)]
NAMES = ["SER", "HIS", "ASP", "GLY"]


def model(shift, b=95.0):
    return [line(i + 1, "CA", n, i + 1, (x + shift, y, z), b=b) for i, (n, (x, y, z)) in enumerate(zip(NAMES, PLACES, strict=True))]


@pytest.fixture
def project(tmp_path):
    models, contacts = tmp_path / "models", tmp_path / "contacts"
    models.mkdir(), contacts.mkdir()
    for k, (shift, b) in enumerate([(0.0, 95.0), (10.0, 96.0), (20.0, 97.0), (30.0, 20.0)], 1):
        (models / f"m_{k}.pdb").write_text("\n".join(model(shift, b)) + "\n")
        second = "Type: salt_bridge\tLigand: LIG1\tProtein: ASP3A\tLigandNodeKey: LIG:A:9:C1\n" if k == 3 else ""
        (contacts / f"m_{k}_interaction_output.txt").write_text(f"Type: hbond\tLigand: LIG1\tProtein: SER1A\tLigandNodeKey: LIG:A:9:C1\n{second}")
    (tmp_path / "template.pdb").write_text("\n".join([*model(-50.0), line(9, "C1", "LIG", 9, (-47.0, 0.0, 3.0), "HETATM"), line(10, "O", "HOH", 10, (-40.0, 0.0, 0.0), "HETATM")]) + "\n")
    (tmp_path / "grades.txt").write_text("".join(f" {i} {x} {n}:{i}:A 0.5 9 b f 9/9 {x}\n" for i, (x, n) in enumerate(zip("SHDG", NAMES, strict=True), 1)))
    (tmp_path / "config.yaml").write_text(
        f"project: {{target_id: T, output_root: {tmp_path}/out}}\nworkflow_numbering: public\n"
        f"inputs: {{models: {models}, template: {tmp_path}/template.pdb, conservation: {tmp_path}/grades.txt, interactions: {contacts}}}\n"
        "step02: {ligands: [{id: drug, resname: LIG}]}\nstep04: {radius: 6, min_mean: 50, min_p10: 50}\nstep06: {distance_cutoff: 5, min_frequency: 0.5, min_occurrence: 0.5}\nstep08: {rare: 0.4}\n"
    )
    return tmp_path


def test_project(spark, project):
    config = f"{project}/config.yaml"
    assert runner.preflight(spark, config).count() == 0
    done = runner.run(spark, config)
    assert done == [(s, "done") for s in workflow.STEPS]
    out = f"{project}/out"
    table = lambda step, name: spark.read.parquet(f"{out}/{runner.FOLDERS[step]}/{name}")
    assert {r.structure_id: r.passed for r in table("01", "verdicts").collect()} == {"m_1": True, "m_2": True, "m_3": True, "m_4": False}
    placed = {r.structure_id: (round(r.x, 3), round(r.y, 3), round(r.z, 3)) for r in table("02", "atoms").where("resname = 'LIG'").collect()}
    assert placed == {"m_1": (3.0, 0.0, 3.0), "m_2": (13.0, 0.0, 3.0), "m_3": (23.0, 0.0, 3.0)}
    assert {r.structure_id: r.passed for r in table("03", "verdicts").collect()} == {"m_1": True, "m_2": True, "m_3": True}
    assert [r.residue for r in table("06", "residues").where("key").collect()] == ["SER1"]
    assert {(r.structure_id, r.class_number) for r in table("07", "classes").collect()} == {("m_3", 1), ("m_1", 2), ("m_2", 2)}
    assert {(r.label, r.representative, r.is_candidate) for r in table("09", "summary").collect()} == {("Class 1", "m_1", True), ("Class 2", "m_3", False)}
    assert runner.run(spark, config, "classify") == [(s, "kept") for s in ("06", "07", "08")]
    assert runner.run(spark, config, "all", "07", "07", force=True) == [("07", "done")]
    assert spark.read.text(f"{out}/{runner.FOLDERS['03']}/report_json", wholetext=True).count() == 1


def test_batch_and_init(spark, project):
    (project / "bad.yaml").write_text("project: {target_id: B}\ninputs: {}\n")
    (project / "batch.csv").write_text(f"project,config,site\ngood,{project}/config.yaml,x\nbad,{project}/bad.yaml,y\n")
    got = {r.project: (r.status, r.meta_site, r.failed_step) for r in runner.batch(spark, f"{project}/batch.csv", "prepare").collect()}
    assert got == {"good": ("done", "x", None), "bad": ("failed", "y", "01")}
    assert {r.message for r in runner.preflight(spark, f"{project}/bad.yaml").collect()} == {"missing models", "missing template", "missing conservation"}
    path = runner.init(spark, f"{project}/new.yaml", "N", str(project))
    assert runner.Project(spark, runner.tables.config(path, spark)).settings.min_global == 75
    with pytest.raises(FileExistsError):
        runner.init(spark, path, "N", "x")
    assert parser().parse_args(["step03", "--config", "c"]).command == "step03"


def test_packed_structures(spark, tmp_path):
    texts = spark.createDataFrame([(f"m_{i}", f"ATOM {i}\nEND") for i in range(50)], "structure_id string, text string")
    sinks.packed_structures(texts, f"{tmp_path}/packed", 7)
    assert [r.text for r in sinks.packed_structure(spark, f"{tmp_path}/packed", "m_31").collect()] == ["ATOM 31\nEND"]
    assert spark.read.parquet(f"{tmp_path}/packed").count() == 50


def test_exported_files(spark, project):
    """Bytes as they are, names as stated, files of one name apart, and a source that is gone."""
    (project / "blob.pdb").write_bytes(bytes(range(256)) * 5000)
    (project / "m_1").mkdir(), (project / "m_2").mkdir()
    for m in ("m_1", "m_2"):
        (project / m / "report.xml").write_text(f"<{m}/>")
    pdb, report = (lambda n: f"{project}/models/{n}.pdb"), (lambda n: f"{project}/{n}/report.xml")
    rows = [("c1", "m_1", pdb("m_1"), report("m_1")), ("c2", "m_2", f"file:{project}/blob.pdb", report("m_2")), ("c1", "m_3", pdb("gone"), None), ("", "m_4", pdb("m_4"), None), ("c2", "m_5", f"{project}/models/../blob.pdb", None)]
    index = spark.createDataFrame(rows, "class string, structure_id string, pdb string, plip_report_xml string")
    made = {(r.structure_id, r.kind): (r.target.removeprefix(f"{project}/export/"), r.bytes, r.status) for r in sinks.exported_files(spark, index, ["pdb", "plip_report_xml"], f"{project}/export").collect()}
    assert made["m_1", "plip_report_xml"][0] == "plip_reports/c1/m_1_report.xml" and made["m_3", "pdb"][1:] == (None, "source not found")
    assert made["m_4", "pdb"][0] == "complexes/unclassified/m_4.pdb" and made["m_2", "pdb"] == ("complexes/c2/m_2_blob.pdb", 1_280_000, "copied") and made["m_5", "pdb"][0] == "complexes/c2/m_5_blob.pdb"
    assert (project / "export/complexes/c2/m_2_blob.pdb").read_bytes() == (project / "blob.pdb").read_bytes()
    files = sorted(str(f.relative_to(project / "export")) for f in (project / "export").rglob("*") if f.is_file() and "manifest" not in str(f))
    assert files == sorted(t for t, _, state in made.values() if state == "copied")
    again = sinks.exported_files(spark, index.limit(0), ["pdb"], f"{project}/none")
    assert again.collect() == []


def test_shifted_conservation_and_changed_settings(spark, project):
    """Grades under another chain and numbering reach the same residues; a new threshold runs only the later steps, a forced step all after it."""
    config, out = f"{project}/config.yaml", f"{project}/out"
    (project / "grades.txt").write_text("".join(f" {i} {x} {n}:{i + 300}:Q 0.5 9 b f 9/9 {x}\n" for i, (x, n) in enumerate(zip("SHDG", NAMES, strict=True), 1)))
    assert dict(runner.run(spark, config)) == dict.fromkeys(workflow.STEPS, "done")
    residues = lambda: sorted(r.residue for r in spark.read.parquet(f"{out}/{runner.FOLDERS['06']}/residues").where("key").collect())
    assert residues() == ["SER1"]
    mapping = spark.read.parquet(f"{out}/{runner.FOLDERS['06']}/conservation")
    assert {(r.resseq, r.target_key, r.method) for r in mapping.collect()} == {(301, "SER1A", "sequence_alignment"), (302, "HIS2A", "sequence_alignment"), (303, "ASP3A", "sequence_alignment"), (304, "GLY4A", "sequence_alignment")}
    assert set(dict(runner.run(spark, config)).values()) == {"kept"}
    text = (project / "config.yaml").read_text()
    (project / "config.yaml").write_text(text.replace("min_frequency: 0.5", "min_frequency: 0.45"))
    assert dict(runner.run(spark, config)) == {s: "kept" if s < "06" else "done" for s in workflow.STEPS}
    assert runner.run(spark, config, "all", "03", "03", force=True) == [("03", "done")]
    assert dict(runner.run(spark, config)) == {s: "kept" if s < "04" else "done" for s in workflow.STEPS}
    p = runner.Project(spark, runner.tables.config(config, spark))
    assert all(p.done(s, p.key(s)) for s in workflow.STEPS)
    (project / "contacts" / "m_1_interaction_output.txt").write_text("Type: hbond\tLigand: LIG1\tProtein: SER1A\tLigandNodeKey: LIG:A:9:C1\nType: hbond\tLigand: LIG1\tProtein: ASP3A\tLigandNodeKey: LIG:A:9:C1\n")
    assert {s for s in workflow.STEPS if not p.done(s, p.key(s))} == {"05"}  # and, once that has run, all after it


def test_units_by_default(spark, project):
    """Without configured units, the two oxygens of a carboxylate that most structures agree on are one unit, and their classes merge; the candidates' files are copied."""
    acid = [line(9, "C1", "LIG", 9, (-47.0, 0.0, 3.0), "HETATM"), line(10, "O1", "LIG", 9, (-46.4, 1.05, 3.0), "HETATM"), line(11, "O2", "LIG", 9, (-46.4, -1.05, 3.0), "HETATM")]
    (project / "template.pdb").write_text("\n".join([*model(-50.0), *acid]) + "\n")
    for k, atom_name in ((1, "O1"), (2, "O2"), (3, "O1")):
        (project / "contacts" / f"m_{k}_interaction_output.txt").write_text(f"Type: hbond\tLigand: LIG1\tProtein: SER1A\tLigandNodeKey: LIG:A:9:{atom_name}\n")
    config, out = f"{project}/config.yaml", f"{project}/out"
    text = (project / "config.yaml").read_text().replace("step02: {", "step02: {avoid_clashes: false, ").replace("step04:", "step03: {max_clashes: 99}\nstep04:")
    (project / "config.yaml").write_text(text)
    table = lambda step, name: spark.read.parquet(f"{out}/{runner.FOLDERS[step]}/{name}")
    runner.run(spark, config)
    assert len({r["class_number"] for r in table("07", "classes").collect()}) == 2
    assert {r.merged_class for r in table("08", "classes").collect()} == {"class_1"}
    assert {(r.atom_key, r.unit_source) for r in table("08", "layers").collect()} == {("LIG:A:9:O1", "universal"), ("LIG:A:9:O2", "universal")}
    kept = {r.structure_id: r.status for r in spark.read.parquet(f"{out}/{runner.FOLDERS['09']}/candidate_exports/manifest").where("kind = 'pdb'").collect()}
    assert kept == dict.fromkeys(("m_1", "m_2", "m_3"), "copied")
    assert (project / "out" / runner.FOLDERS["09"] / "candidate_exports" / "complexes" / "class_1" / "m_1.pdb").read_text() == (project / "models" / "m_1.pdb").read_text()
    (project / "config.yaml").write_text(text.replace("step08: {", "step08: {unit_policy: manual, "))
    assert dict(runner.run(spark, config))["08"] == "done" and {r.merged_class for r in table("08", "classes").collect()} == {"class_1", "class_2"}


def test_preparation_options(spark, project):
    """Scores of full-length sources, residues that go, all on one reference, ligand atoms cut by rule, and the labels of an earlier run."""
    (project / "sources").mkdir()
    for k, b in ((1, 96.0), (2, 40.0), (4, 99.0)):
        (project / "sources" / f"full_{k}.pdb").write_text("\n".join(model(0.0, b)) + "\n")
    (project / "manifest.csv").write_text("output,source\n" + "".join(f"{project}/models/m_{k}.pdb,{project}/sources/full_{k}.pdb\n" for k in (1, 2, 4)))
    (project / "old.csv").write_text("class,structure_id\nclass_7,m_1\n")
    ligand = [line(9, "C1", "LIG", 9, (-47.0, 0.0, 3.0), "HETATM"), line(10, "C2", "LIG", 9, (-46.0, 0.0, 4.5), "HETATM")]
    (project / "template.pdb").write_text("\n".join([*model(-50.0), *ligand]) + "\n")
    text = (project / "config.yaml").read_text()
    text = text.replace("inputs: {", f"inputs: {{manifest: {project}/manifest.csv, sources: {project}/sources, reference_classes: {project}/old.csv, ").replace(
        "step02:", 'step01: {plddt_filter_scope: original, remove_residues: "4", alignment: {enabled: true, reference: first_passed, min_matched_atoms: 3}}\nligand_trimming: {rules: [{rule_id: core, match: {resname: LIG}, action: keep_only, names: [C1]}]}\nstep02:')
    (project / "config.yaml").write_text(text)
    config, out = f"{project}/config.yaml", f"{project}/out"
    table = lambda step, name: spark.read.parquet(f"{out}/{runner.FOLDERS[step]}/{name}")
    runner.run(spark, config, "all", last="07")
    assert {r.structure_id: (r.passed, r.score_scope, r["mean"]) for r in table("01", "verdicts").collect()} == {"m_1": (True, "source", 96.0), "m_2": (False, "source", 40.0), "m_3": (True, "input", 97.0), "m_4": (True, "source", 99.0)}
    assert {r.resseq for r in table("01", "atoms").collect()} == {1, 2, 3}
    first = {(r.structure_id, r.resseq): (round(r.x, 3), round(r.y, 3), round(r.z, 3)) for r in table("01", "aligned").collect()}
    assert {k: v for k, v in first.items()} == {(s, i + 1): p for s in ("m_1", "m_3", "m_4") for i, p in enumerate(PLACES[:3])}
    assert {(r.atom_name, r.keep_atom, r.rule_id) for r in table("03", "decisions").collect()} == {("C1", True, "core"), ("C2", False, "core")}
    assert {r.atom_name for r in table("03", "trimmed").where("record = 'HETATM'").collect()} == {"C1"}
    assert {(r["class"], r.structure_id) for r in table("07", "stable_classes").collect()} >= {("class_7", "m_1")}
    required = text.replace("plddt_filter_scope: original", "plddt_filter_scope: source_required")
    (project / "config.yaml").write_text(required)
    runner.run(spark, config, "all", last="01")
    assert {r.structure_id: (r.passed, r.score_scope) for r in table("01", "verdicts").collect()}["m_3"] == (False, "source_unavailable")
    (project / "config.yaml").write_text(text.replace("ligand_trimming: {", "ligand_trimming: {timing: before_docking, "))
    runner.run(spark, config, "all", last="02")
    assert {r.atom_name for r in table("02", "atoms").where("record = 'HETATM'").collect()} == {"C1"}
    with pytest.raises(ValueError):
        runner.score_scope("best")


def contact(group, tag, resnr, restype, **leaves):
    inner = "".join(f"<{k}>{v}</{k}>" for k, v in {"resnr": resnr, "restype": restype, "reschain": "A", "restype_lig": "LIG", "resnr_lig": 9, "reschain_lig": "A", **leaves}.items())
    return f'<{group}><{tag} id="1">{inner}</{tag}></{group}>'


def test_reports_give_the_same_graph(spark, project):
    """Contacts of XML reports, their ligand atoms found by index, by list, as the residue's only atom and by coordinates, make the graph that text lines make."""
    config, out = f"{project}/config.yaml", f"{project}/out"
    runner.run(spark, config, "all", last="05")
    table = lambda name: spark.read.parquet(f"{out}/{runner.FOLDERS['05']}/{name}")
    edges = lambda: sorted({(r.structure_id, r.ligand, r.residue) for r in table("edges").collect()})
    text, blueprint = edges(), sorted((r.global_idx, r.node_key) for r in table("blueprint").collect())
    place = "<x>{}</x><y>0.0</y><z>3.1</z>"
    reports = {
        "m_1": contact("hydrogen_bonds", "hydrogen_bond", 1, "SER", protisdon="True", donoridx=1, acceptoridx=9, dist_a=3.0),
        "m_2": contact("pi_stacks", "pi_stack", 1, "SER", lig_idx_list="<idx>77</idx><idx>9</idx>", centdist=4.0),
        "m_3": contact("hydrophobic_interactions", "hydrophobic_interaction", 1, "SER", restype_lig="UNL", ligcarbonidx=400, ligcoo=place.format(23.0)) + contact("salt_bridges", "salt_bridge", 3, "ASP"),
        "m_4": contact("salt_bridges", "salt_bridge", 1, "SER"),
    }
    for name, inner in reports.items():
        (project / "reports" / name).mkdir(parents=True)
        (project / "reports" / name / "report.xml").write_text(f"<report><bindingsite><identifiers/><interactions>{inner}</interactions></bindingsite></report>")
    (project / "config.yaml").write_text((project / "config.yaml").read_text().replace(f"interactions: {project}/contacts", f"interactions: {project}/reports, interaction_pattern: '*.xml'"))
    assert runner.run(spark, config, "all", last="05")[-1] == ("05", "done")
    assert edges() == text and sorted((r.global_idx, r.node_key) for r in table("blueprint").collect()) == blueprint
    assert {r.resolved_by for r in table("resolved").collect()} == {"index", "index_list", "coordinates", "residue"}


def test_findings_before_a_run(spark, project):
    """Residues that differ, grades that cover too little or collide, and steps that disagree on names."""
    from confora.plans import preflight as P

    config = f"{project}/config.yaml"
    tell = lambda: sorted((r.severity, r.message) for r in runner.preflight(spark, config).collect())
    assert tell() == []
    (project / "grades.txt").write_text("".join(f" {i} {x} {n}:{i}:A 0.5 9 b f 9/9 {x}\n" for i, (x, n) in enumerate(zip("SHD", NAMES), 1)))
    text = (project / "config.yaml").read_text()
    (project / "config.yaml").write_text(text.replace("step04: {", "step04: {catalytic_region: {ligand_resnames: [LIG]}, ").replace("step06: {", "step06: {ligand: {include_resnames: [LIG, MG]}, "))
    assert tell() == [("error", "conservation covers 75.0 % of residues, below 90.0 %"), ("warning", "ligand names differ: step05: LIG; step07: LIG, MG")]
    (project / "models" / "m_2.pdb").write_text("\n".join([line(1, "CA", "TRP", 1, (0.0, 0.0, 0.0)), line(2, "CA", "TRP", 2, (4.0, 0.0, 0.0))]) + "\n")
    assert any(s == "error" and m.startswith("m_2: too little of the template aligns") for s, m in tell())
    (project / "config.yaml").write_text(text.replace("step02: {", "step02: {alignment_mode: legacy, "))
    assert any(m.startswith("m_2: exact placement is unsafe") for _, m in tell())
    mapping = spark.createDataFrame([("p", "A1", "conflict"), ("p", "A1", "conflict"), ("p", "A2", "mapped"), ("q", None, "missing")], "project string, target_key string, status string")
    targets = spark.createDataFrame([("p", "A1"), ("p", "A2"), ("q", "A1"), ("r", "A1")], "project string, residue_key string")
    rows = sorted((r.project, r.severity, r.message[:30]) for r in P.conservation_gaps(mapping, targets, 0.9, low_is_error=False).collect())
    assert rows == [("p", "error", "2 conservation rows share a re"), ("p", "warning", "conservation covers 50.0 % of "), ("q", "warning", "no conservation row maps to an"), ("r", "warning", "no conservation row maps to an")]
