"""Before and around placement: inputs, names, references, ligand groups, alignment modes, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import first_number, natural_key, selector, token_number
from ..functions.settings import choice, stem, structure_id
from ..sources.pdb import is_ligand, is_water
from .ordering import globally_numbered

#: Columns that may hold a model's path, the preferred one first, and those of its score source.
MODEL_COLUMNS = ("source_pdb", "source_pdb_path", "original_pdb_path", "af2_pdb_path", "input_pdb", "input_pdb_path", "pdb_path", "standardized_pdb_path", "aligned_pdb_path", "source_path")
SCORE_COLUMNS = ("af2_pdb_path", "af2_model_pdb_path", "standardized_pdb_path", "protein_pdb_path", "input_protein_pdb_path", "source_pdb_path", "model_pdb_path")


def first_filled(df: DataFrame, names: Sequence[str], usable: Column | None = None) -> Column:
    """The first of the columns that the table has, not blank; null if there is none."""
    found = [F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def numbered(df: DataFrame, *order: Column, name: str = "input_order") -> DataFrame:
    """A contiguous number from 1 over the whole index."""
    return globally_numbered(df, *order, name=name)


def model_inputs(index: DataFrame, preferred: str = "source_pdb") -> DataFrame:
    """An index with model (its path), file, structure_id and input_order in natural order of the file names. Rows without any path are left out."""
    path = first_filled(index, [preferred, *[c for c in MODEL_COLUMNS if c != preferred]])
    rows = index.withColumn("model", path).where("model is not null").withColumn("file", F.regexp_replace("model", r"^.*/", ""))
    own = F.when(F.col("structure_id") != "", F.col("structure_id")) if "structure_id" in index.columns else F.lit(None).cast("string")
    rows = rows.withColumn("structure_id", F.coalesce(own, stem(F.col("model"))))
    return numbered(rows, natural_key(F.col("file")), F.col("file"), F.col("model"))


def score_sources(index: DataFrame, files: DataFrame, complex_column: str = "complex_path") -> DataFrame:
    """An index with score_path: of its model columns the first that names an existing file (``files``: path) which is not the complex itself."""
    out, found = index, []
    there = files.select("path").distinct()
    for k, c in enumerate(c for c in SCORE_COLUMNS if c in index.columns):
        name = f"__{k}"
        out = out.join(there.select(F.col("path").alias(name)), F.trim(F.col(c)) == F.col(name), "left")
        found.append(F.when(F.col(name) != F.col(complex_column), F.col(name)))
    return out.select(*index.columns, (F.coalesce(*found) if found else F.lit(None).cast("string")).alias("score_path"))


#: Words that a model's rank follows in its file name.
RANK_WORDS = ("rank", "af2rank")


def output_names(models: DataFrame) -> DataFrame:
    """Adds short_id, ``<code>_<rank>`` from the tokens of a model's file stem: the first one (a code if it has four letters or digits), and the number that goes with a rank, else
    that right behind a code, else the input order. A name that is taken gets ``_dup`` and the input_order."""
    tokens = F.split(stem(F.col("file")), "[_.-]")
    first = F.get(tokens, F.lit(0))
    is_code = first.rlike("^[A-Za-z0-9]{4}$")
    token = F.regexp_replace(F.when(is_code, F.upper(first)).otherwise(first), "[^A-Za-z0-9]+", "_")
    rank = F.coalesce(first_number(F.transform(tokens, F.lower), *RANK_WORDS), F.when(is_code, token_number(F.get(tokens, F.lit(1))))).cast("long")
    rank = F.coalesce(rank, F.col("input_order").cast("long"))
    out = models.withColumn("__s", F.concat_ws("_", F.when(token != "", token).otherwise("model"), rank.cast("string")))
    again = F.row_number().over(Window.partitionBy("__s").orderBy("input_order")) > 1
    return out.withColumn("short_id", F.when(again, F.concat("__s", F.lit("_dup"), F.col("input_order").cast("string"))).otherwise(F.col("__s"))).drop("__s")


def reference_model(scored: DataFrame, choose: str = "auto_best_plddt") -> DataFrame:
    """The one reference row: the passed model of best mean score (ties: the first), the first passed model, or the model at a path."""
    passed = scored.where("passed")
    if choose == "auto_best_plddt":
        return passed.orderBy(F.desc("mean"), "input_order").limit(1)
    if choose == "first_passed":
        return passed.orderBy("input_order").limit(1)
    return scored.where(F.col("model") == choose).limit(1)


def alignment_modes(compatibility: DataFrame, mode: str = "auto", profile: str = "standard", allow_unsafe: bool = False) -> DataFrame:
    """(structure_id, alignment): how each structure is aligned. ``auto`` keeps coordinate matching except for incompatible structures
    of the general profile; asked for explicitly, it raises when run on incompatible structures unless that is allowed."""
    mode, profile = choice("alignment", mode), choice("profile", profile)
    if mode == "sequence_aware":
        return compatibility.select("structure_id", F.lit(mode).alias("alignment"))
    if mode == "auto":
        other = F.lit("sequence_aware") if profile == "general" else F.lit("coordinate_matching")
        return compatibility.select("structure_id", F.when(F.col("compatible"), "coordinate_matching").otherwise(other).alias("alignment"))
    checked = F.assert_true(F.col("compatible") | F.lit(allow_unsafe), F.concat("structure_id", F.lit(" is not compatible: use sequence_aware")))
    return compatibility.where(F.coalesce(checked.cast("boolean"), F.lit(True))).select("structure_id", F.lit(mode).alias("alignment"))


def template_split(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(protein atoms, ligand atoms) of templates."""
    return atoms.where("record = 'ATOM'"), atoms.where(is_ligand())


def ligand_groups(template: DataFrame, groups: Sequence[dict], files: DataFrame | None = None) -> DataFrame:
    """Ligand atoms with group_index (from 1, in order), ligand_id and atom_index. A group is a selector, on the template's HETATM
    records or, with ``source: file``, on any atoms of ``files``; water never counts. An atom is in every group that selects it."""
    out = None
    for k, g in enumerate(groups, 1):
        source = str(g.get("source", "template_hetatm"))
        if source not in ("template_hetatm", "file"):
            raise ValueError(f"unknown source of ligand group {k}: {source!r}")
        rows = template.where("record = 'HETATM'") if source == "template_hetatm" else files
        spec = {c: g[c] for c in ("resname", "chain", "resseq", "icode", "atom_name") if c in g}
        part = rows.where(~is_water() & selector(spec)).withColumns({"group_index": F.lit(k), "ligand_id": F.lit(str(g.get("id", f"ligand_{k}")))})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no ligand groups")
    return out.withColumn("atom_index", F.row_number().over(Window.partitionBy("structure_id", "group_index").orderBy("line_index")))


def empty_groups(selected: DataFrame, groups: Sequence[dict], structures: DataFrame) -> DataFrame:
    """(structure_id, group_index) of groups that select nothing."""
    every = structures.select("structure_id").distinct().withColumn("group_index", F.explode(F.array(*[F.lit(k) for k in range(1, len(groups) + 1)])))
    return every.join(selected.select("structure_id", "group_index").distinct(), ["structure_id", "group_index"], "left_anti")


def rigid_assembly(selected: DataFrame) -> DataFrame:
    """All groups as one body: group 1, atoms numbered through in order of their groups."""
    order = Window.partitionBy("structure_id").orderBy("group_index", "atom_index")
    return selected.withColumn("atom_index", F.row_number().over(order)).withColumn("group_index", F.lit(1))


def order_manifest(ligands: DataFrame, trimmed: DataFrame | None = None) -> DataFrame:
    """(docking_order, source, active, branch, resnames): ligand files in order, with their residue names in order of first appearance.

    ``ligands``: (docking_order, active, line_index, resname), a row per atom. ``trimmed`` (active, source) names the files that trimmed ones were made of."""
    first = ligands.groupBy("docking_order", "active", "resname").agg(F.min("line_index").alias("at"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "resname"))), lambda r: r["resname"]), ";")
    rows = first.groupBy("docking_order", "active").agg(names.alias("resnames"))
    if trimmed is None:
        return rows.select("docking_order", F.col("active").alias("source"), "active", F.lit("untrimmed_input").alias("branch"), "resnames")
    rows = rows.join(trimmed.select("active", "source"), "active", "left")
    return rows.select("docking_order", F.coalesce("source", "active").alias("source"), "active", F.lit("before_docking_trim").alias("branch"), "resnames")


def by_candidate_ids(records: DataFrame, keyed: DataFrame, stage: str = "classify") -> DataFrame:
    """``records`` (structure_id, path) joined with ``keyed`` (structure_id and more) on any of: the id, the path's stem, and both normalised.

    Both sides are reduced to the normalised id, of which the others are finer spellings, so one equi-join finds what any candidate finds."""
    left = records.withColumn("__n", F.array_distinct(F.array(structure_id(F.col("structure_id"), stage), structure_id(F.col("path"), stage))))
    left = left.withColumn("__n", F.explode("__n"))
    right = keyed.withColumn("__n", structure_id(F.col("structure_id"), stage)).withColumnRenamed("structure_id", "matched_id")
    return left.join(right, "__n").drop("__n").distinct()


def complex_records(files: DataFrame) -> DataFrame:
    """(structure_id, path) of complex files, in natural order: the stage that trims takes them from a folder."""
    return numbered(files.select(structure_id(F.col("path")).alias("structure_id"), "path"), natural_key(F.col("path")), F.col("path"))
