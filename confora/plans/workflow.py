"""The stages as one DAG of DataFrames over all targets, stage selection, preflight checks and batches."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import RADII, residue_base_of, vdw_radius
from ..operators import graphs, proximity, scores, screening
from ..operators.leaders import leader_classes
from ..operators.ordering import globally_numbered
from ..sources import pdb
from .preflight import missing_inputs

STEPS = [f"{i:02d}" for i in range(1, 10)]
#: Named slices of the steps.
STAGES = {
    "prepare": ("01", "04"), "interactions": ("05", "05"), "classify": ("06", "08"), "visualize": ("09", "09"), "analysis": ("05", "09"), "all": ("01", "09"),
}


def step_number(text: str) -> str:
    digits = "".join(c for c in str(text) if c.isdigit())
    if not digits or f"{int(digits):02d}" not in STEPS:
        raise ValueError(f"unknown step {text!r}")
    return f"{int(digits):02d}"


def select_steps(stage: str = "all", first: str | None = None, last: str | None = None) -> list[str]:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}: one of {', '.join(STAGES)}")
    lo, hi = STAGES[stage]
    lo, hi = max(lo, step_number(first)) if first else lo, min(hi, step_number(last)) if last else hi
    return [s for s in STEPS if lo <= s <= hi]


@dataclass(frozen=True)
class Settings:
    min_global: float = 75.0
    max_clashes: int = 10
    delta: float = 0.5
    radii: str = "standard"
    region_radius: float = 6.0
    min_region_mean: float = 90.0
    min_region_p10: float = 80.0
    contact_cutoff: float = 5.0
    min_frequency: float = 0.80
    min_grade: int = 8
    min_occurrence: float = 0.80
    required_mode: str = "all"
    extra: dict = field(default_factory=dict)


#: Where a configuration keeps each setting.
PLACES = {
    "min_global": ("step01", "plddt_threshold"), "max_clashes": ("step03", "max_clashes"), "delta": ("step03", "delta"), "region_radius": ("step05", "radius"), "min_region_mean": ("step05", "min_mean"),
    "min_region_p10": ("step05", "min_p10"), "contact_cutoff": ("step07", "distance_cutoff"), "min_frequency": ("step07", "min_frequency"), "min_grade": ("step07", "min_grade"),
    "min_occurrence": ("step07", "min_occurrence"), "required_mode": ("step07", "require_key_residues"),
}


def settings(config: dict) -> Settings:
    """The settings that a configuration gives (``tables.config``); the rest keep their defaults."""
    found = {k: (config.get(step) or {}).get(name) for k, (step, name) in PLACES.items()}
    kinds = {f.name: f.type for f in fields(Settings)}
    cast = {"float": float, "int": int, "str": str}
    return Settings(**{k: cast[kinds[k]](v) for k, v in found.items() if v is not None}, extra=config)


def quality(atoms: DataFrame, s: Settings) -> DataFrame:
    """Step 01: score summary per structure over CA atoms, over all atoms where a structure has none, and its verdict."""
    p = atoms.where("record = 'ATOM'")
    return scores.score_summary(p, ["structure_id"], "b_factor", F.upper("atom_name") == "CA").withColumn("passed", F.col("mean") >= s.min_global)


def sides(atoms: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(protein atoms, ligand atoms) without hydrogens, with radii."""
    heavy = atoms.where(~((F.upper("element") == "H") | F.upper("atom_name").startswith("H"))).withColumn("radius", vdw_radius(F.col("element"), s.radii))
    return heavy.where("record = 'ATOM'"), heavy.where(pdb.is_ligand())


def clash_verdicts(atoms: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Step 03: (clashing pairs, verdict per structure)."""
    protein, ligand = sides(atoms, s)
    reach = max(0.1, 2 * max(RADII[s.radii].values()) - s.delta)  # no radius sum of the table is larger
    pairs = proximity.overlaps(proximity.voxel_join(protein, ligand, reach, ["structure_id"]), s.delta).where("clash")
    pairs = pairs.select(F.col("l.structure_id").alias("structure_id"), F.col("l.serial").alias("protein_serial"), F.col("r.serial").alias("ligand_serial"), "distance", "overlap")
    return pairs, proximity.clash_summary(atoms, pairs, "structure_id", s.max_clashes)


def region_verdicts(atoms: DataFrame, s: Settings) -> DataFrame:
    """Step 04: quality of residues with any atom within the radius of a ligand atom."""
    protein, ligand = sides(atoms, s)
    key = ["structure_id", "chain", "resseq", "icode"]
    near = proximity.voxel_join(protein, ligand, s.region_radius, ["structure_id"]).select(*[F.col(f"l.{k}").alias(k) for k in key]).distinct()
    return scores.region_summary(protein.join(near, key, "left_semi"), ["structure_id"], ["chain", "resseq", "icode"], "b_factor", F.upper("atom_name") == "CA", s.min_region_mean, s.min_region_p10)


def residue_contacts(atoms: DataFrame, s: Settings) -> DataFrame:
    """(structure_id, residue, distance): least distance of each residue to any ligand atom."""
    protein, ligand = sides(atoms, s)
    p = protein.withColumn("residue", residue_base_of(F.col("resname"), F.col("resseq"), F.col("icode")))
    near = proximity.nearest_in_rings(p, ligand, ["structure_id"], ["residue"], "serial")
    return near.select("structure_id", "residue", F.col("min_distance").alias("distance"))


def key_residues(contacts: DataFrame, edges: DataFrame, conservation: DataFrame, structures: DataFrame, s: Settings) -> DataFrame:
    """Step 06: residues with conservation, contact frequency and graph occurrence; ``key`` where all three hold.

    Conservation rows of residues that no structure has are appended as unselected fillers.
    """
    f = screening.residue_frequency(contacts, structures, "structure_id", "residue", F.col("distance") <= s.contact_cutoff, "distance")
    o = screening.graph_occurrence(edges, structures, "structure_id", "residue").select("residue", "occurrence")
    c = conservation.select("residue", "grade").dropDuplicates(["residue"])
    out = f.join(o, "residue", "left").join(c, "residue", "left")
    filler = c.join(f.select("residue"), "residue", "left_anti")
    out = out.unionByName(filler, allowMissingColumns=True)
    holds = (F.col("grade") >= s.min_grade) & (F.col("frequency") >= s.min_frequency) & (F.col("occurrence") >= s.min_occurrence)
    return out.withColumn("key", F.coalesce(holds, F.lit(False)))


def kept_structures(edges: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    return screening.structure_filter(screening.node_sets(edges, "structure_id", "residue"), keys, s.required_mode)


def classes(edges: DataFrame, kept: DataFrame, nodes: DataFrame | None = None, threshold: float = 1.0) -> DataFrame:
    """Step 07: (structure_id, class_number, leader) of kept structures, graphs below ``threshold`` of edit distance to the leader in one class.

    Without ``nodes`` the ends of edges are taken for distinct labels. ``nodes`` (node_key, label) is the blueprint, and
    ends of edges are its keys: where labels repeat, or the threshold is above 1, exact distances decide instead of equal edges.
    """
    e = edges.join(kept.select("structure_id"), "structure_id", "left_semi")
    if nodes is None and threshold > 1:
        raise ValueError("a threshold above 1 needs the blueprint's nodes")
    if nodes is not None:
        labels = {r.node_key: r.label for r in nodes.select("node_key", "label").distinct().collect()}  # a blueprint
        if threshold > 1 or len(set(labels.values())) < len(labels):
            ends = F.struct(F.least("ligand", "residue").alias("u"), F.greatest("ligand", "residue").alias("v"))
            g = e.groupBy("structure_id").agg(F.array_sort(F.collect_set(ends)).alias("edges")).withColumn("edge_count", F.size("edges"))
            led = leader_classes(g, "structure_id", labels, graphs.ordered(g, "structure_id"), threshold)
            numbers = led.select("edge_count", "leader").distinct().withColumn("class_number", F.row_number().over(Window.orderBy(*graphs.graph_order(led, "leader"))))
            return led.join(numbers, ["edge_count", "leader"]).select("structure_id", "class_number", "leader", "edge_count")
    sig = graphs.edge_signatures(e, "structure_id", "ligand", "residue")
    return sig.join(graphs.signature_classes(sig, "structure_id"), ["edge_count", "signature"]).select("structure_id", "class_number", "leader", "edge_count")


def preflight(spark: SparkSession, projects: DataFrame) -> DataFrame:
    """(severity, project, message) for missing inputs. ``projects`` has project, models, template, ligands; a row per project."""
    return missing_inputs(spark, projects)


def batch_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n_projects"))


def ranked_models(index: DataFrame) -> DataFrame:
    """Contiguous ranks: files with a rank first, by it, then the rest in natural order."""
    from ..functions.expressions import natural_key

    rank = pdb.file_metadata(F.col("structure_id"))["rank"]
    return globally_numbered(index, rank.isNull(), rank, natural_key(F.col("structure_id")), name="output_rank")
