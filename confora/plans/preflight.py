"""What would go wrong in a run, as one table of findings: (severity, project, message).

Each check is a join or an aggregation over rows of all projects, and the report is their union. Only the listing of folders that a manifest names is asked of the
store by the driver, a call for each folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

INPUTS = ("models", "template", "ligands")


def findings(rows: DataFrame, severity, message) -> DataFrame:
    return rows.select((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "project", message.alias("message"))


def missing_inputs(spark: SparkSession, projects: DataFrame) -> DataFrame:
    """Inputs that are blank, and paths (separated by semicolons) that do not exist. ``projects`` has project, models, template, ligands; a row per project."""
    value = lambda name: F.col(name) if name in projects.columns else F.lit(None).cast("string")
    given = projects.select("project", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("value")) for n in INPUTS])).alias("i")).select("project", "i.*")
    blank = F.coalesce("value", F.lit("")) == ""
    paths = given.where(~blank).select("project", "name", F.explode(F.split("value", ";")).alias("path"))
    bare = F.regexp_replace("path", "/+$", "")
    folder = F.when(~F.contains(bare, F.lit("/")), ".").otherwise(F.coalesce(F.nullif(F.regexp_extract(bare, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("/")))
    paths = paths.withColumns({"folder": folder, "entry": F.regexp_extract(bare, "([^/]*)$", 1)})
    folders = [r.folder for r in paths.select("folder").distinct().collect()]  # of a manifest
    there = spark.createDataFrame([(f, n) for f in folders for n in tables.names_in(spark, f)], "folder string, entry string")
    lost = paths.join(there, ["folder", "entry"], "left_anti")
    return findings(given.where(blank), "error", F.concat(F.lit("missing "), "name")).unionByName(findings(lost, "error", F.concat("name", F.lit(" not found: "), "path")))


def unsafe_alignments(structures: DataFrame) -> DataFrame:
    """``structures`` (project, structure_id, mode, compatible, allow_unsafe, identity, coverage, min_identity, min_coverage): exact placement needs equal residues; others need a good enough alignment."""
    exact = F.col("mode").isin("coordinate_matching", "dock_py_exact", "legacy", "original")
    by_sequence = F.col("mode").isin("sequence_aware", "general") | ~F.col("compatible")
    poor = (F.coalesce("identity", F.lit(0.0)) < F.col("min_identity")) | (F.coalesce("coverage", F.lit(0.0)) < F.col("min_coverage"))
    percent = lambda c: F.format_string("%.3f", F.coalesce(F.col(c), F.lit(0.0)))
    bad_exact = findings(structures.where(exact & ~F.col("compatible") & ~F.col("allow_unsafe")), "error", F.concat("structure_id", F.lit(": exact placement is unsafe, residues differ from the template")))
    bad_sequence = findings(structures.where(~exact & by_sequence & poor), "error", F.concat("structure_id", F.lit(": too little of the template aligns (identity="), percent("identity"), F.lit("; coverage="), percent("coverage"), F.lit(")")))
    return bad_exact.unionByName(bad_sequence)


def conservation_gaps(mapping: DataFrame, targets: DataFrame, min_coverage: float = 0.90, low_is_error: bool = True, conflict_is_error: bool = True) -> DataFrame:
    """``mapping`` (project, target_key, status) of conservation rows, ``targets`` (project, residue_key): conflicting rows, residues without a grade, and nothing mapped at all."""
    rows = mapping.groupBy("project").agg(F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_distinct(F.when(F.col("status") == "mapped", F.col("target_key"))).alias("mapped"))
    size = targets.groupBy("project").agg(F.count_distinct("residue_key").alias("n"))
    both = size.join(rows, "project", "left").na.fill(0, ["conflicts", "mapped"]).withColumn("coverage", F.col("mapped") / F.col("n"))
    kind = lambda error: "error" if error else "warning"
    conflict = findings(both.where("conflicts > 0"), kind(conflict_is_error), F.concat(F.col("conflicts").cast("string"), F.lit(" conservation rows share a residue")))
    low = findings(both.where((F.col("coverage") < min_coverage) & (F.col("mapped") > 0)), kind(low_is_error), F.concat(F.lit("conservation covers "), F.format_string("%.1f", F.col("coverage") * 100), F.lit(f" % of residues, below {min_coverage * 100:.1f} %")))
    none = findings(both.where("mapped = 0"), kind(low_is_error), F.lit("no conservation row maps to any residue"))
    return conflict.unionByName(low).unionByName(none)


def differing_names(names: DataFrame) -> DataFrame:
    """``names`` (project, step, resname): ligand names that some steps of a project are told and others are not."""
    sets = names.where("resname is not null").groupBy("project", "step").agg(F.array_join(F.array_sort(F.collect_set("resname")), ", ").alias("names"))
    per = sets.groupBy("project").agg(F.count_distinct("names").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "names"))), lambda s: F.concat(s["step"], F.lit(": "), s["names"])), "; ").alias("told"))
    return findings(per.where("n > 1"), "warning", F.concat(F.lit("ligand names differ: "), "told"))


def report(*checks: DataFrame) -> DataFrame:
    """All findings of the checks, errors first within a project by sorting ``severity``."""
    return reduce(DataFrame.unionByName, checks)
