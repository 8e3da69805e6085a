"""A project from its configuration: the steps chained over tables of the shared store, resumable, and batches of projects.

A step reads the tables of earlier ones and writes its own under ``<output_root>/<folder>``. It ends with a marker that names the settings and input files it
was made with and the run of the step before it, and is skipped only while all of these are the same: a changed threshold or file, or a step that was
forced, makes the later steps run again. Every table holds all structures of the project; verdicts partition it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import residue_base, residue_base_of, residue_ranges
from ..functions.settings import choice, structure_id
from ..operators import chemistry, docking, graphs, interactions, matching, placement, screening, trimming
from ..operators import labels as labels_of
from ..operators.superpose import superpose
from ..sources import conservation, pdb, shared, sinks, tables
from . import preflight as flight
from . import workflow

#: The folder of each step.
FOLDERS = {
    "01": "01_af2_prepare", "02": "02_template_guided_docking", "03": "03_clash_filter", "04": "04_catalytic_region_plddt_qc", "05": "05_plip_interaction_graphs",
    "06": "06_key_residue_screening", "07": "07_ged_classification", "08": "08_chemical_equivalence", "09": "09_class_visualization",
}
#: The sections of the configuration and the inputs that a step depends on, besides the steps before it.
DEPENDS = {
    "01": (["step01"], ["models", "pattern", "manifest", "sources"]), "02": (["step02", "workflow", "ligand_trimming"], ["template"]), "03": (["step03", "ligand_trimming"], []), "04": (["step05"], []), "05": ([], ["interactions", "interaction_pattern"]),
    "06": (["step07"], ["conservation"]), "07": (["step08"], ["reference_classes"]), "08": (["step09"], []), "09": (["export"], []),
}
#: Projects of a batch that run at a time.
SIDE_BY_SIDE = 4
#: A configuration to start from.
TEMPLATE = """project:
  target_id: {name}
  output_root: {root}
inputs:
  models: {root}/models        # structure files; complexes already, if there is no template
  pattern: "*.pdb"
  template:                    # a complex whose ligands are placed into the models
  conservation:                # grade text, archive or table
  interactions:                # folder of interaction reports: lines "Type: ...<tab>Ligand: ...<tab>Protein: ..."
workflow_numbering: public
step01: {{plddt_threshold: 75}}
step02: {{alignment_mode: auto, ligands: []}}
step03: {{max_clashes: 10, delta: 0.5}}
step04: {{radius: 6, min_mean: 90, min_p10: 80}}
step06: {{distance_cutoff: 5, min_frequency: 0.8, min_grade: 8, min_occurrence: 0.8, require_key_residues: all}}
step07: {{ged_threshold: 1.0}}
step08: {{common: 0.8, rare: 0.1, signature_policy: most_common}}
"""


#: Spellings of where a model's score is taken from.
SCORE_SCOPES = {
    "input": ("input", "legacy", "current", "trimmed"), "source_if_available": ("source_if_available", "source", "original", "full_length"), "source_required": ("source_required", "full_length_required"),
}


def score_scope(text: str) -> str:
    found = [k for k, names in SCORE_SCOPES.items() if str(text).strip().lower() in names]
    if not found:
        raise ValueError(f"unknown score scope {text!r}: one of {', '.join(SCORE_SCOPES)}")
    return found[0]


class Project:
    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config, self.settings = spark, config, workflow.settings(config)
        self.inputs = config.get("inputs") or {}
        project = config.get("project") or {}
        self.name = str(project.get("target_id", "target"))
        self.root = str(project.get("output_root") or f"results/{self.name}").rstrip("/")

    def path(self, step: str, table: str) -> str:
        return f"{self.root}/{FOLDERS[step]}/{table}"

    def read(self, step: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(step, table))

    def write(self, df: DataFrame, step: str, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(step, table))
        return self.read(step, table)

    def section(self, name: str) -> dict:
        return self.config.get(name) or {}

    def atoms(self, path: str, pattern: str = "*") -> DataFrame:
        return pdb.atoms(pdb.lines(self.spark, path, pattern), pdb.LENIENT)

    def checks(self) -> list[DataFrame]:
        """Findings about inputs that are there: whether models align with the template, what conservation covers, and whether steps agree on ligand names."""
        models = self.atoms(self.inputs["models"], self.inputs.get("pattern", "*.pdb")).where("record = 'ATOM'")
        named, out = lambda df: df.withColumn("project", F.lit(self.name)), []
        if self.inputs.get("template"):
            own = self.section("step02")
            general = own.get("general_alignment") or {}
            t, m = matching.residues(self.atoms(self.inputs["template"])), matching.residues(models)
            best = matching.by_sequence(t, m, 0.0).groupBy("structure_id").agg(F.min("identity").alias("identity"), F.min("coverage").alias("coverage"))
            told = {"mode": str(own.get("alignment_mode") or "auto").lower(), "allow_unsafe": bool(own.get("allow_unsafe_legacy_alignment")), "min_identity": float(general.get("min_sequence_identity", 0.3)), "min_coverage": float(general.get("min_alignment_coverage", 0.5))}
            rows = matching.compatible(t, m).join(best, "structure_id", "left").withColumns({k: F.lit(v) for k, v in told.items()})
            out.append(flight.unsafe_alignments(named(rows)))
        if self.inputs.get("conservation"):
            own = (self.section("step07").get("conservation") or {}).get("mapping") or {}
            targets = conservation.keyed(models.select(F.upper("resname").alias("resname"), "chain", "resseq", "icode").distinct())
            mapping = conservation.mapped(conservation.load(self.spark, self.inputs["conservation"]), targets, own.get("offsets"), own.get("chain_map"))
            flags = bool(own.get("fail_on_low_target_coverage", True)), bool(own.get("fail_on_mapping_conflict", True))
            out.append(flight.conservation_gaps(named(mapping), named(targets), float(own.get("min_target_coverage", 0.90)), *flags))
        steps = {"step05": (self.section("step05").get("catalytic_region") or {}).get("ligand_resnames"), "step07": (self.section("step07").get("ligand") or {}).get("include_resnames")}
        told = [(self.name, s, n) for s, names in steps.items() for n in names or []]
        out.append(flight.differing_names(self.spark.createDataFrame(told, "project string, step string, resname string")))
        return out

    def passed(self, step: str) -> DataFrame:
        return self.read(step, "verdicts").where("passed").select("structure_id")

    # steps
    def step_01(self) -> None:
        """Models, less the residues that are to go, with the verdict on their own or their sources' scores; and, if asked for, all that passed on one reference."""
        own = self.section("step01")
        atoms = self.atoms(self.inputs["models"], self.inputs.get("pattern", "*.pdb"))
        if own.get("remove_residues"):
            chains = own.get("remove_chains")
            atoms = trimming.without_regions(atoms, residue_ranges(str(own["remove_residues"])), [chains] if isinstance(chains, str) else chains)
        atoms = self.write(atoms, "01", "atoms")
        scored = workflow.quality(atoms, self.settings)
        scope = score_scope(own.get("plddt_filter_scope", "input"))
        if scope == "input":
            scored = scored.withColumn("score_scope", F.lit("input"))
        else:
            scored = self.scored_by_source(scored, scope)
        index = self.write(workflow.ranked_models(scored).withColumnRenamed("output_rank", "input_order"), "01", "verdicts")
        aligned = own.get("alignment") or {}
        if aligned.get("enabled"):
            self.align(atoms, index, str(aligned.get("reference", "auto_best_plddt")), int(aligned.get("min_matched_atoms", 50)))

    def scored_by_source(self, scored: DataFrame, scope: str) -> DataFrame:
        """``scored`` with the summary and verdict of each structure's source file, which a manifest (output, source) names; its own where there is none, or a failure if sources are required."""
        manifest = self.spark.read.option("header", "true").csv(self.inputs["manifest"]).select(F.trim("output").alias("output"), F.trim("source").alias("source"))
        at = tables.files(self.spark, self.inputs["models"], self.inputs.get("pattern", "*.pdb")).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "file")
        index = tables.source_paths(at, manifest).select(structure_id("file").alias("structure_id"), F.regexp_extract("source_path", "([^/]*)$", 1).alias("source_file"))
        lines = pdb.lines(self.spark, self.inputs["sources"], self.inputs.get("pattern", "*.pdb"))
        full = workflow.quality(pdb.atoms(lines, pdb.LENIENT), self.settings).withColumnRenamed("structure_id", "source_id")
        names = index.select("structure_id", F.regexp_replace("source_file", r"\.[^.]*$", "").alias("source_id"))
        kept = [c for c in scored.columns if c != "structure_id"]
        both = scored.join(names, "structure_id", "left").join(full.select("source_id", *[F.col(c).alias(f"__{c}") for c in kept]), "source_id", "left")
        found = F.col("__passed").isNotNull()
        own = F.lit(scope == "source_if_available")
        chosen = [F.when(found | ~own, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in kept if c != "passed"]
        passed = F.when(found, F.col("__passed")).otherwise(own & F.col("passed"))
        return both.select("structure_id", *chosen, passed.alias("passed"), F.when(found, "source").when(own, "input").otherwise("source_unavailable").alias("score_scope"))

    def align(self, atoms: DataFrame, index: DataFrame, choose: str, least: int) -> None:
        """Structures that passed, turned onto the reference by their common CA atoms."""
        best = docking.reference_model(index.withColumn("model", F.col("structure_id")), choose).select("structure_id")
        passed = atoms.join(index.where("passed").select("structure_id"), "structure_id", "left_semi")
        pairs = matching.by_key(matching.residues(atoms.join(best, "structure_id", "left_semi")), matching.residues(passed))
        side = lambda s: pairs.select("structure_id", "ordinal", *[F.col(f"{s}{c}").alias(c) for c in "xyz"])
        turns = self.write(superpose(side("f"), side("m"), ["structure_id"], ["ordinal"], least), "01", "alignment")
        turned = passed.join(turns.where("status = 'ok'").select("structure_id", "rotation", "translation"), "structure_id")
        at = lambda k: sum((F.col(c) * F.get("rotation", F.lit(3 * i + k)) for i, c in enumerate("xyz")), F.get("translation", F.lit(k)))
        new = turned.select(*[c for c in passed.columns if c not in "xyz"], *[at(k).alias(f"__{c}") for k, c in enumerate("xyz")])
        self.write(new.withColumnsRenamed({f"__{c}": c for c in "xyz"}).select(*passed.columns), "01", "aligned")

    def trimming_rules(self, timing: str) -> list[dict] | None:
        """The rules of the optional ligand trimming, if it runs at this time."""
        own = self.section("ligand_trimming")
        if not own or not own.get("enabled", True) or own.get("timing", "after_clash_filter") != timing:
            return None
        return list(own.get("rules") or [])

    def step_02(self) -> None:
        """Complexes: the models that passed, with the template's ligands where there is a template."""
        models = self.read("01", "atoms").join(self.passed("01"), "structure_id", "left_semi")
        if not self.inputs.get("template"):
            self.write(models, "02", "atoms")
            return
        own = self.section("step02")
        template = self.atoms(self.inputs["template"])
        t, m = matching.residues(template), matching.residues(models)
        compatible = matching.compatible(t, m)
        modes = docking.alignment_modes(compatible, own.get("alignment_mode", "auto"), choice("profile", self.section("workflow").get("profile")), bool(own.get("allow_unsafe_legacy_alignment")))
        xyz = [f"{s}{c}" for s in "mf" for c in "xyz"]
        of = lambda mode: modes.where(F.col("alignment") == mode).select("structure_id")
        pairs = matching.by_order(t, m.join(of("coordinate_matching"), "structure_id", "left_semi")).select("structure_id", *xyz)
        pairs = pairs.unionByName(matching.by_sequence(t, m.join(of("sequence_aware"), "structure_id", "left_semi")).select("structure_id", *xyz))
        pairs = shared.written(pairs.withColumn("k", F.monotonically_increasing_id()), "pairs")
        side = lambda s: pairs.select("structure_id", "k", *[F.col(f"{s}{c}").alias(c) for c in "xyz"])
        transforms = superpose(side("m"), side("f"), ["structure_id"], ["k"])
        self.write(transforms, "02", "transforms")
        groups = own.get("ligands") or [{"record": "HETATM"}]
        lig = docking.ligand_groups(template, groups)
        if empty := docking.empty_groups(lig, groups, template).collect():  # configured groups
            raise ValueError(f"ligand groups without atoms: {[r.group_index for r in empty]}")
        if (rules := self.trimming_rules("before_docking")) is not None:
            cut = trimming.trimmed_stage(lig.withColumn("is_ligand", F.lit(True)), rules, None, "before_docking", self.section("ligand_trimming").get("default", "keep"))[0]
            lig = cut.where("keep_atom").select(*lig.columns)
        protein = models.where("record = 'ATOM'")
        atoms, trace, audit = placement.placed(transforms.where("status = 'ok'"), protein, lig.select("group_index", "atom_index", "x", "y", "z"), avoid=bool(own.get("avoid_clashes", True)), assembly=bool(own.get("rigid_assembly")))
        self.write(trace, "02", "trace")
        self.write(audit, "02", "audit")
        named = lig.drop("structure_id", "x", "y", "z", "ligand_id").withColumn("line_index", F.col("line_index") + 10_000_000)
        made = atoms.join(named, ["group_index", "atom_index"]).select(*models.columns)
        self.write(protein.unionByName(made), "02", "atoms")

    def step_03(self) -> None:
        pairs, verdicts = workflow.clash_verdicts(self.read("02", "atoms"), self.settings)
        self.write(pairs, "03", "pairs")
        rules = self.trimming_rules("after_clash_filter")
        if rules is None:
            self.write(verdicts, "03", "verdicts")
            return
        atoms = self.read("02", "atoms").withColumn("is_ligand", pdb.is_ligand())
        decisions, left = trimming.trimmed_stage(atoms, rules, verdicts.where("passed"), "after_clash_filter", self.section("ligand_trimming").get("default", "keep"))
        self.write(decisions.where("keep_atom").select(*self.read("02", "atoms").columns), "03", "trimmed")
        self.write(decisions.where("is_ligand").select("structure_id", "serial", "atom_name", "resname", "keep_atom", "rule_id", "reason"), "03", "decisions")
        left = left.select("structure_id", "n_ligand_atoms", "n_kept", "n_emptied", F.col("passed").alias("__trimmed"))
        out = verdicts.join(left, "structure_id", "left").withColumn("passed", F.col("passed") & F.coalesce("__trimmed", F.lit(False))).drop("__trimmed")
        self.write(out, "03", "verdicts")

    def complexes(self, after: str) -> DataFrame:
        """Atoms of the structures that passed a step, after the optional trimming."""
        trimmed = self.trimming_rules("after_clash_filter") is not None
        return (self.read("03", "trimmed") if trimmed else self.read("02", "atoms")).join(self.passed(after), "structure_id", "left_semi")

    def step_04(self) -> None:
        self.write(workflow.region_verdicts(self.complexes("03"), self.settings), "04", "verdicts")

    def reported_edges(self, pattern: str) -> DataFrame:
        """(structure_id, ligand, residue, type) of XML reports, whose ligand atoms are resolved among those of the complexes. ``report.xml`` belongs to the structure its folder is named after."""
        rows = tables.plip_report(self.spark, self.inputs["interactions"], pattern)
        owner = F.when(F.col("file").isin("report.xml"), F.col("folder")).otherwise(F.regexp_replace("file", "_report", ""))
        rows = rows.withColumn("structure_id", structure_id(owner)).join(self.passed("04"), "structure_id", "left_semi")
        rows = shared.written(rows.withColumn("contact_id", F.monotonically_increasing_id()), "contacts")
        records = rows.select("structure_id", "contact_id", "ligand_serial", "ligand_serials", F.col("restype_lig").alias("resname"), F.col("reschain_lig").alias("chain"), F.col("resnr_lig").alias("resseq"), "x", "y", "z")
        ligands = self.complexes("04").where(pdb.is_ligand())
        found = self.write(interactions.resolved_contacts(records, ligands).select("structure_id", "contact_id", "serial", "resolved_by"), "05", "resolved")
        nodes = interactions.ligand_nodes(ligands).select("structure_id", "serial", "node_key")
        told = rows.select("structure_id", "contact_id", residue_base_of(F.col("restype"), F.col("resnr"), F.lit("")).alias("residue"), F.col("kind").alias("type"))
        return found.where("serial is not null").join(nodes, ["structure_id", "serial"]).join(told, ["structure_id", "contact_id"]).select("structure_id", F.col("node_key").alias("ligand"), "residue", "type")

    def step_05(self) -> None:
        """Contacts of the structures that passed and the graph nodes of all."""
        if not self.inputs.get("interactions"):
            raise ValueError("step 05 needs inputs.interactions")
        pattern = self.inputs.get("interaction_pattern", "*.txt")
        if pattern.lower().endswith(".xml"):
            edges = self.reported_edges(pattern)
        else:
            rows = tables.interaction_lines(self.spark, self.inputs["interactions"], pattern)
            sid = structure_id(F.regexp_replace("file", "_interaction_output", ""))
            edges = rows.select(sid.alias("structure_id"), F.coalesce(F.nullif("ligand_node_key", F.lit("")), "ligand").alias("ligand"), residue_base(F.col("protein")).alias("residue"), "type").where("residue is not null")
        self.write(interactions.ligand_bonds(self.complexes("04").where(pdb.is_ligand()), self.spark.createDataFrame([], "structure_id string, u int, v int")), "05", "bonds")
        edges = self.write(edges.join(self.passed("04"), "structure_id", "left_semi"), "05", "edges")
        nodes = edges.select(F.col("ligand").alias("node_key"), F.lit(0).alias("kind")).union(edges.select("residue", F.lit(1))).distinct()
        number = F.regexp_extract("node_key", "(-?[0-9]+)", 1).try_cast("int")
        self.write(graphs.blueprint(nodes, ["kind", F.when(F.col("kind") == 1, number), "node_key"]), "05", "blueprint")

    def residues(self, structures: DataFrame) -> DataFrame:
        """The distinct residues of the structures' proteins."""
        atoms = self.read("02", "atoms").where("record = 'ATOM'").join(structures, "structure_id", "left_semi")
        return conservation.keyed(atoms.select(F.upper("resname").alias("resname"), "chain", "resseq", "icode").distinct())

    def step_06(self) -> None:
        contacts = self.write(workflow.residue_contacts(self.complexes("04"), self.settings), "06", "contacts")
        edges, structures = self.read("05", "edges"), self.passed("04")
        scores = conservation.load(self.spark, self.inputs["conservation"]) if self.inputs.get("conservation") else None
        if scores is None:
            raise ValueError("step 06 needs inputs.conservation")
        own = (self.section("step07").get("conservation") or {}).get("mapping") or {}
        mapping = conservation.mapped(scores, self.residues(structures), own.get("offsets"), own.get("chain_map"), float(own.get("min_sequence_identity", 0.70)), float(own.get("min_target_coverage", 0.50)))
        mapping = self.write(mapping, "06", "conservation")
        graded = mapping.where("status = 'mapped'").select(residue_base(F.col("target_key")).alias("residue"), "grade")
        keys = self.write(workflow.key_residues(contacts, edges, graded, structures, self.settings), "06", "residues")
        names = [r.residue for r in keys.where("key").select("residue").distinct().orderBy("residue").collect()]  # residues of one protein
        sets = screening.contact_sets(structures, contacts.where(F.col("distance") <= self.settings.contact_cutoff), edges, self.section("step07").get("contact_definition", "graph"))
        kept = screening.filter_reason(screening.structure_filter(sets, names, self.settings.required_mode), names, self.settings.required_mode)
        self.write(kept, "06", "verdicts")
        self.write(screening.set_types(sets, "structure_id"), "06", "types")

    def step_07(self) -> None:
        labels = self.read("05", "blueprint").select("node_key", F.col("node_key").alias("label"))
        threshold = float(self.section("step08").get("ged_threshold", 1.0))
        classes = self.write(workflow.classes(self.read("05", "edges"), self.passed("06"), labels, threshold), "07", "classes")
        if self.inputs.get("reference_classes"):  # the labels of an earlier run
            own = self.section("step08").get("stable_labels") or {}
            reference = tables.class_manifest(self.spark.read.option("header", "true").csv(self.inputs["reference_classes"]), int(own.get("structure_offset", 0)))
            current = classes.select(F.concat(F.lit("class_"), F.col("class_number").cast("string")).alias("class"), "structure_id", F.col("leader").alias("representative"))
            told = self.write(labels_of.stable_labels(current, reference, float(own.get("minimum_jaccard", 0.5))), "07", "labels")
            self.write(labels_of.relabelled(current, told), "07", "stable_classes")

    def step_08(self) -> None:
        own = self.section("step09")
        edges = self.read("05", "edges").join(self.passed("06"), "structure_id", "left_semi").withColumnRenamed("ligand", "atom_key")
        manual = own.get("manual_ligand_units") or {}
        units = self.spark.createDataFrame(list(manual.items()), "atom_key string, unit string")
        if own.get("unit_policy", "auto") != "manual":  # what most structures agree on, under the configured units
            ligand = self.complexes("06").where(pdb.is_ligand())
            found = chemistry.contact_units(ligand, self.spark.createDataFrame([], "structure_id string, u int, v int"))
            agreed = self.write(chemistry.consensus_units(found, float(own.get("unit_consensus", 0.80))), "08", "units")
            agreed = agreed.where("decision = 'apply' and rule != 'individual_atom'").select(F.concat_ws(":", "resname", "chain", F.col("resseq").cast("string"), "atom_name").alias("atom_key"), "unit")
            units = chemistry.layered_units(edges.select("atom_key").distinct(), [("manual", units), ("universal", agreed)])
            units = self.write(units, "08", "layers").where("unit_source != 'unmapped'").select("atom_key", "unit")
        canonical = self.write(chemistry.canonical_edges(edges, units, own.get("interaction_type_map")), "08", "edges")
        if self.inputs.get("reference_classes"):
            classes = self.read("07", "stable_classes").select("structure_id", "class")
        else:
            classes = self.read("07", "classes").select("structure_id", F.concat(F.lit("class_"), F.col("class_number").cast("string")).alias("class"))
        merged = self.write(chemistry.merged_classes(chemistry.class_signatures(canonical, classes, own.get("signature_policy", "most_common")), classes), "08", "classes")
        frequencies = self.write(chemistry.edge_frequencies(canonical, self.passed("06"), float(own.get("common", 0.8)), float(own.get("rare", 0.1))), "08", "frequencies")
        by_class = merged.select("merged_class", F.explode(F.split("signature", "; ")).alias("edge")).distinct().withColumnRenamed("merged_class", "class")
        self.write(chemistry.candidates(by_class, frequencies, merged.select(F.col("merged_class").alias("class"))), "08", "verdicts")

    def step_09(self) -> None:
        paths = self.passed("06").withColumn("path", F.concat(F.lit(f"{self.path('02', 'atoms')}#"), "structure_id"))
        self.write(chemistry.class_visuals(self.read("08", "classes").select("structure_id", "merged_class"), self.read("08", "verdicts"), paths), "09", "summary")
        self.export()

    def export(self) -> None:
        """The candidates' structure and interaction files, copied by class with a manifest."""
        own = self.section("export")
        if not own.get("enabled", True):
            return
        chosen = self.read("08", "classes").join(self.read("08", "verdicts").where("is_candidate").select(F.col("class").alias("merged_class")), "merged_class", "left_semi")
        found = tables.files(self.spark, self.inputs["models"], self.inputs.get("pattern", "*.pdb")).select("path")
        if self.inputs.get("interactions"):
            found = found.unionByName(tables.files(self.spark, self.inputs["interactions"], self.inputs.get("interaction_pattern", "*.txt")).select("path"))
        kinds = ["pdb", "interaction"]
        index = sinks.export_index(chosen.select("structure_id", F.col("merged_class").alias("class")), sinks.file_index(found), kinds)
        index = self.write(index, "09", "export_index")
        sinks.exported_files(self.spark, index, kinds, self.path("09", "candidate_exports"))

    def fingerprint(self, given: str | None) -> list:
        """What tells whether an input has changed: its files' number, size and newest time, and a hash of their names."""
        if not given or not tables.exists(self.spark, str(given)):
            return [given]
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(given))  # the listing only
        each = F.xxhash64("path", "length", F.col("modificationTime").cast("string")).cast("decimal(38,0)")
        return [given, *map(str, files.agg(F.count("*"), F.sum("length"), F.sum(each)).first())]

    def marker(self, step: str) -> str:
        return f"{self.root}/{FOLDERS[step]}/_done"

    def key(self, step: str) -> str:
        """A digest of what the step depends on, which includes the run of the step before it."""
        sections, inputs = DEPENDS[step]
        before = FOLDERS.keys() & {f"{int(step) - 1:02d}"}
        chain = [shared.get(self.spark, self.marker(s)) for s in before]
        told = [[self.section(s) for s in sections], [self.fingerprint(self.inputs.get(i)) if i not in ("pattern", "interaction_pattern") else self.inputs.get(i) for i in inputs], chain]
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def done(self, step: str, key: str) -> bool:
        return (shared.get(self.spark, self.marker(step)) or "").split(" ")[0] == key

    def run(self, steps: Iterable[str], force: bool = False) -> list[tuple[str, str]]:
        """(step, done or kept) of each step."""
        out = []
        for step in steps:
            key = self.key(step)
            if self.done(step, key) and not force:
                out.append((step, "kept"))
                continue
            getattr(self, f"step_{step}")()
            if tables.exists(self.spark, self.path(step, "verdicts")) and "passed" in self.read(step, "verdicts").columns:
                sinks.report(self.read(step, "verdicts"), f"{self.root}/{FOLDERS[step]}", f"{self.name} step {step}")
            shared.put(self.spark, self.marker(step), f"{key} {uuid.uuid4().hex}".encode())  # last, so that a step that stopped runs again
            out.append((step, "done"))
        return out


def run(spark: SparkSession, config_path: str, stage: str = "all", first: str | None = None, last: str | None = None, force: bool = False) -> list[tuple[str, str]]:
    return Project(spark, tables.config(config_path, spark)).run(workflow.select_steps(stage, first, last), force)


def preflight(spark: SparkSession, config_path: str) -> DataFrame:
    """(severity, project, message) of what is missing before a run."""
    p = Project(spark, tables.config(config_path, spark))
    given = lambda k: str(p.inputs.get(k) or "")
    row = (p.name, given("models"), given("template") or given("models"), given("conservation"))
    issues = flight.missing_inputs(spark, spark.createDataFrame([row], "project string, models string, template string, ligands string"))
    issues = shared.written(issues.withColumn("message", F.replace("message", F.lit("ligands"), F.lit("conservation"))), "missing")
    if not issues.isEmpty():
        return issues
    return flight.report(issues, *p.checks())


def batch(spark: SparkSession, manifest: str, stage: str = "all") -> DataFrame:
    """(project, config, status, message, failed_step, meta_...) of a manifest's projects, ``SIDE_BY_SIDE`` at a time; a failure stops only its own."""
    rows = tables.batch_manifest(spark, manifest)

    def one(r) -> tuple:
        at = "configuration"
        try:
            project = Project(spark, tables.config(r["config"], spark))
            for at in workflow.select_steps(stage):
                project.run([at])
            return (*r, "done", "", None)
        except Exception as e:  # noqa: BLE001  the batch goes on, and the table says what failed and where
            return (*r, "failed", str(e) or type(e).__name__, at)

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # Spark runs the jobs of several threads; each project's steps stay in order
        out = list(pool.map(one, rows.collect()))  # a row per project
    schema = ", ".join(f"`{c}` string" for c in rows.columns) + ", status string, message string, failed_step string"
    return spark.createDataFrame(out, schema)


def init(spark: SparkSession, path: str, name: str, root: str) -> str:
    """A new configuration at ``path``; an existing one is an error."""
    if tables.exists(spark, path):
        raise FileExistsError(path)
    return shared.put(spark, path, TEMPLATE.format(name=name, root=root).encode())
