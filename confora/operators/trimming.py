"""Atom selection by rule lists, with trace, guard, renumbering and an audit of cut bonds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import first_rule, in_ranges, selector
from .graphs import components
from .proximity import voxel_join


#: Atom names of common ligand parts.
PRESETS = {
    "atp_triphosphate_core": "PA O1A O2A O3A PB O1B O2B O3B PG O1G O2G O3G O5' C5' O5* C5*",
    "adp_diphosphate_core": "PA O1A O2A O3A PB O1B O2B O3B O5' C5' O5* C5*",
    "amp_phosphate_core": "P O1P O2P O3P OP1 OP2 OP3 PA O1A O2A O3A O5' C5' O5* C5*",
    "dtmp_phosphate_core": "P O1P O2P O3P OP1 OP2 OP3 O5' C5' O5* C5*",
    "generic_phosphate_atoms": "P PA PB PG O1P O2P O3P OP1 OP2 OP3 O1A O2A O3A O1B O2B O3B O1G O2G O3G",
    "common_metal_atoms": "MG MN ZN FE FE2 CA NA K CO NI CU",
}


def preset_names(rule: dict) -> list[str]:
    """The rule's own names and those of its presets, each once; an unknown preset raises."""
    out = [n.upper() for n in rule.get("names", [])]
    for p in [rule["preset"]] if isinstance(rule.get("preset"), str) else rule.get("preset", []):
        if p not in PRESETS:
            raise ValueError(f"unknown preset {p!r}")
        out += PRESETS[p].split()
    return list(dict.fromkeys(out))


def with_distances(atoms: DataFrame, reach: float) -> DataFrame:
    """Adds d2, the least squared distance of a ligand atom to a protein atom of its structure, where it is within ``reach``; else null."""
    key = ["structure_id", "line_index"]
    near = voxel_join(atoms.where("is_ligand"), atoms.where("record = 'ATOM'"), reach, ["structure_id"])
    near = near.groupBy(*[F.col(f"l.{k}").alias(k) for k in key]).agg(F.min("d2").alias("d2"))
    return atoms.join(near, key, "left")


def decided(atoms: DataFrame, rules: list[dict], default: str = "keep") -> DataFrame:
    """Adds keep_atom, rule_id and reason; the first rule that matches a ligand atom decides, other atoms stay.

    A rule has ``rule_id``, a ``match`` selector and an ``action``: keep_all, remove_all,
    remove_atom_names, keep_only (with ``names`` or a ``preset``, and optionally ``within``: either is enough) or
    keep_within_distance (``within`` alone); distances are those of ``with_distances``.
    """
    if default not in ("keep", "remove"):
        raise ValueError(f"unknown default action: {default!r}")
    compiled, reasons = [], []
    for r in rules:
        names = preset_names(r)
        here = F.upper("atom_name").isin(names) if names else F.lit(False)
        if r.get("within") is not None:
            here = here | F.coalesce(F.col("d2") <= float(r["within"]) ** 2, F.lit(False))
        action = r["action"]
        if action == "keep_within_distance" and r.get("within") is None:
            raise ValueError(f"rule {r['rule_id']!r} has no distance")
        if action == "keep_only" and not names and r.get("within") is None:
            raise ValueError(f"rule {r['rule_id']!r} keeps only atoms but names none")
        keep = {"keep_all": F.lit(True), "remove_all": F.lit(False), "remove_atom_names": ~here, "keep_only": here, "keep_within_distance": here}.get(action)
        if keep is None:
            raise ValueError(f"unknown action {action!r} in rule {r['rule_id']!r}")
        compiled.append((r["rule_id"], selector(r.get("match", {})), keep))
        reasons.append(F.when(selector(r.get("match", {})), F.lit(f"rule_{action}")))
    keep, rule = first_rule(compiled, F.lit(default == "keep"))
    ligand = F.col("is_ligand")
    reason = F.coalesce(*reasons, F.lit(f"default_{default}")) if reasons else F.lit(f"default_{default}")
    return atoms.select("*", F.when(ligand, keep).otherwise(True).alias("keep_atom"), F.when(ligand, rule).alias("rule_id"), F.when(ligand, reason).otherwise("not_a_ligand").alias("reason"))


def empty_keep_only(decisions: DataFrame) -> DataFrame:
    """Residues that a keep_only rule matched and emptied, with the names it found there."""
    g = decisions.where("reason = 'rule_keep_only'").groupBy("structure_id", "rule_id", "resname", "chain", "resseq")
    return g.agg(F.bool_or("keep_atom").alias("any"), F.array_join(F.array_sort(F.collect_set("atom_name")), ",").alias("atom_names")).where("not any").drop("any")


def residue_rollup(decisions: DataFrame) -> DataFrame:
    return decisions.where("is_ligand").groupBy("structure_id", "resname", "chain", "resseq").agg(F.count("*").alias("n_atoms"), F.count(F.when(F.col("keep_atom"), 1)).alias("n_kept"))


def renumbered(decisions: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept atoms with new serials in file order, bonds between kept atoms under the new serials)."""
    kept = decisions.where("keep_atom").withColumn("new_serial", F.row_number().over(Window.partitionBy("structure_id").orderBy("line_index")))
    ids = kept.select("structure_id", "serial", "new_serial")
    b = bonds.join(ids.select("structure_id", F.col("serial").alias("u"), F.col("new_serial").alias("nu")), ["structure_id", "u"]).join(ids.select("structure_id", F.col("serial").alias("v"), F.col("new_serial").alias("nv")), ["structure_id", "v"])
    return kept, b.select("structure_id", F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))


def conect_lines(bonds: DataFrame, per_line: int = 4) -> DataFrame:
    """(structure_id, serial, part, line): bond records, at most ``per_line`` neighbours each."""
    both = bonds.select("structure_id", F.col("u").alias("serial"), F.col("v").alias("other")).union(bonds.select("structure_id", "v", "u"))
    k = F.row_number().over(Window.partitionBy("structure_id", "serial").orderBy("other")) - 1
    g = both.withColumn("part", F.floor(k / per_line)).groupBy("structure_id", "serial", "part").agg(F.array_sort(F.collect_list("other")).alias("others"))
    return g.select("structure_id", "serial", "part", F.concat(F.lit("CONECT"), F.lpad(F.col("serial").cast("string"), 5, " "), F.array_join(F.transform("others", lambda o: F.lpad(o.cast("string"), 5, " ")), "")).alias("line"))


def cut_bonds(decisions: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, n_kept, n_cut): bonds whose ends both stay, and those that lose one end."""
    k = decisions.select("structure_id", "serial", "keep_atom")
    j = bonds.join(k.select("structure_id", F.col("serial").alias("u"), F.col("keep_atom").alias("ku")), ["structure_id", "u"]).join(k.select("structure_id", F.col("serial").alias("v"), F.col("keep_atom").alias("kv")), ["structure_id", "v"])
    return j.groupBy("structure_id").agg(F.count(F.when(F.col("ku") & F.col("kv"), 1)).alias("n_kept"), F.count(F.when(F.col("ku") != F.col("kv"), 1)).alias("n_cut"))


def ligand_components(decisions: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, n_components): connected parts of the kept ligand atoms, single atoms too."""
    node = lambda c: F.concat_ws("|", "structure_id", F.col(c).cast("string"))
    kept = decisions.where("is_ligand and keep_atom").select("structure_id", "serial")
    own = bonds.join(kept.withColumnRenamed("serial", "u"), ["structure_id", "u"]).join(kept.withColumnRenamed("serial", "v"), ["structure_id", "v"])
    parts = components(own.select(node("u").alias("u"), node("v").alias("v")))
    rows = kept.withColumn("node", node("serial")).join(parts, "node", "left")
    return rows.groupBy("structure_id").agg(F.count_distinct(F.coalesce("component", "node")).alias("n_components"))


def trimmed_lines(lines: DataFrame, ranges: list[tuple[int, int]], chains: list[str] | None = None) -> DataFrame:
    """Lines of structure files less the atoms of ``ranges``, numbers kept, and less CONECT entries to atoms that went; a bond line without
    partners goes. A structure of which no atom is left raises when run."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    atom = F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM")
    gone = F.col("line").startswith("ATOM") & in_ranges(cut(23, 4).try_cast("int"), ranges)
    if chains:
        gone = gone & cut(22, 1).isin(chains)
    rows = lines.withColumns({"__atom": atom, "__gone": F.coalesce(atom & gone, F.lit(False)), "__serial": F.when(atom, cut(7, 5).try_cast("int"))})
    by = rows.groupBy("structure_id").agg(
        F.count(F.when(F.col("__atom"), 1)).alias("__n"), F.count(F.when(F.col("__gone"), 1)).alias("__k"), F.collect_set(F.when(F.col("__gone"), F.col("__serial"))).alias("__out")
    )
    rows = rows.where("not __gone").join(by, "structure_id")
    some = F.assert_true((F.col("__n") == 0) | (F.col("__k") < F.col("__n")), F.concat(F.lit("nothing left of "), "structure_id"))
    rows = rows.where(F.coalesce(some.cast("boolean"), F.lit(True)))
    numbers = F.transform(F.regexp_extract_all(F.substring("line", 7, 500), F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))
    left = F.filter(numbers, lambda x: ~F.array_contains("__out", x))
    bond = F.concat(F.lit("CONECT"), F.array_join(F.transform(left, lambda x: F.lpad(x.cast("string"), 5, " ")), ""))
    is_bond = F.col("line").startswith("CONECT")
    keeps = ~is_bond | ((F.size(left) > 1) & ~F.array_contains("__out", F.get(numbers, F.lit(0))))
    return rows.where(keeps).select("structure_id", "line_index", F.when(is_bond & (F.size(left) < F.size(numbers)), bond).otherwise(F.col("line")).alias("line"))


#: When the optional trimming runs.
TIMINGS = ("before_docking", "after_clash_filter")


def trimmed_stage(atoms: DataFrame, rules: list[dict], kept: DataFrame | None = None, timing: str = "after_clash_filter", default: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(decisions, roll-up per structure with its verdict) of a whole index: all structures, or those in ``kept``; before docking there is no protein to measure from."""
    if timing not in TIMINGS:
        raise ValueError(f"unknown timing {timing!r}")
    reach = [float(r["within"]) for r in rules if r.get("within") is not None]
    if reach and timing == "before_docking":
        raise ValueError("distance rules need a placed ligand")
    rows = atoms.join(kept.select("structure_id").distinct(), "structure_id", "left_semi") if kept is not None else atoms
    d = decided(with_distances(rows, max(reach)) if reach else rows, rules, default)
    emptied = empty_keep_only(d).groupBy("structure_id").agg(F.count("*").alias("n_emptied"))
    out = d.groupBy("structure_id").agg(F.count(F.when(F.col("is_ligand"), 1)).alias("n_ligand_atoms"), F.count(F.when(F.col("is_ligand") & F.col("keep_atom"), 1)).alias("n_kept"))
    out = out.join(emptied, "structure_id", "left").withColumn("n_emptied", F.coalesce("n_emptied", F.lit(0)))
    return d, out.withColumn("passed", (F.col("n_emptied") == 0) & (F.col("n_kept") > 0))


def without_regions(atoms: DataFrame, ranges: list[tuple[int, int]], chains: list[str] | None = None) -> DataFrame:
    """Structures less the residues of ``ranges``, numbers kept; removing everything of a structure raises when run."""
    gone = in_ranges(F.col("resseq"), ranges)
    if chains:
        gone = gone & F.col("chain").isin(chains)
    left = F.sum(F.when(~gone, 1).otherwise(0)).over(Window.partitionBy("structure_id"))
    out = atoms.withColumn("__gone", gone).withColumn("__left", left)
    return out.where(F.coalesce(F.assert_true(F.col("__left") > 0, F.concat(F.lit("nothing left of "), "structure_id")).cast("boolean"), F.lit(True))).where("not __gone").drop("__gone", "__left")


def unique_atom_names(atoms: DataFrame) -> DataFrame:
    """Adds new_name: a name used again within a structure's ligands becomes its element and the next free number."""
    first = F.row_number().over(Window.partitionBy("structure_id", "atom_name").orderBy("line_index"))
    a = atoms.withColumn("__k", first)
    used = F.max(F.coalesce(F.regexp_extract("atom_name", r"([0-9]+)$", 1).try_cast("int"), F.lit(0))).over(Window.partitionBy("structure_id", "element"))
    again = F.sum(F.when(F.col("__k") > 1, 1).otherwise(0)).over(Window.partitionBy("structure_id", "element").orderBy("line_index"))
    return a.withColumn("__u", used).withColumn("__n", again).withColumn("new_name", F.when(F.col("__k") == 1, F.col("atom_name")).otherwise(F.concat("element", (F.col("__u") + F.col("__n")).cast("string")))).drop("__k", "__u", "__n")
