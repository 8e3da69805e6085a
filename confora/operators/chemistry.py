"""Contact units of ligands and chemical equivalence of interaction classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import interaction_type, last_integer, natural_key, supertype
from ..sources.shared import written

#: Metals as single-atom components, with their charge, and residue names shown differently.
METALS = {"MG": "Mg2+", "ZN": "Zn2+", "CA": "Ca2+", "MN": "Mn2+", "FE": "Fe2+", "CU": "Cu2+", "CO": "Co2+", "NI": "Ni2+", "NA": "Na+", "K": "K+"}
SHOWN = {"TMP": "dTMP"}


def small_rings(adjacency: dict[int, set[int]], largest: int = 8) -> list[tuple[int, ...]]:
    """Shortest cycle through each bond, up to ``largest`` atoms, each once."""
    found = set()
    for u in adjacency:
        for v in adjacency[u]:
            if u < v:
                paths, seen = [(u,)], {u}
                while paths and len(paths[0]) < largest:
                    nxt = []
                    for p in paths:
                        for w in sorted(adjacency[p[-1]]):
                            if len(p) == 1 and w == v:
                                continue
                            if w == v:
                                found.add(tuple(sorted((*p, v))))
                                nxt = []
                                break
                            if w not in seen:
                                seen.add(w)
                                nxt.append((*p, w))
                        else:
                            continue
                        break
                    paths = nxt
    return sorted(found)


def planar(xyz: np.ndarray, tolerance: float = 0.25) -> bool:
    centred = xyz - xyz.mean(axis=0)
    return bool(np.sqrt((np.linalg.svd(centred)[1][-1] ** 2) / len(xyz)) <= tolerance)


def component_units(atoms: pd.DataFrame, bonds: set[tuple[int, int]]) -> list[tuple[int, str, str, str]]:
    """(serial, rule, core of the name, position) of one component's heavy atoms; every atom gets one unit."""
    order = atoms["serial"].tolist()
    el, name = dict(zip(order, atoms["element"], strict=True)), dict(zip(order, atoms["atom_name"], strict=True))
    xyz = dict(zip(order, atoms[["x", "y", "z"]].to_numpy(float), strict=True))
    adj: dict[int, set[int]] = {s: set() for s in order}
    for u, v in bonds:
        if u in adj and v in adj:
            adj[u].add(v), adj[v].add(u)
    rings = small_rings(adj)
    in_ring = {a for r in rings for a in r}
    out: dict[int, tuple[str, str, str]] = {}

    def put(serials, rule, core, position=""):
        for s in serials:
            out.setdefault(s, (rule, core, position))

    ends = lambda c, e: [n for n in sorted(adj[c]) if el[n] == e and len(adj[n]) == 1]
    if len(order) == 1 and el[order[0]] in METALS:
        return [(order[0], "metal_ion", f"{METALS[el[order[0]]]} ion", "")]
    groups: dict[str, list] = {}
    phosphorus = [s for s in order if el[s] == "P"]
    for s in order:
        if el[s] == "O" and len(p := [n for n in sorted(adj[s]) if el[n] == "P"]) == 2:
            i, j = sorted(phosphorus.index(x) + 1 for x in p)
            put([s], "phosphate_bridging_oxygen", f"phosphate {i}–{j} bridging oxygen")
    for s in phosphorus:
        groups.setdefault("phosphate", []).append([s, *[n for n in sorted(adj[s]) if el[n] == "O" and n not in out]])
    for s in order:
        if el[s] == "C" and len(o := ends(s, "O")) == 2:
            groups.setdefault("carboxylate oxygen", []).append(o)
        elif el[s] == "S" and len(o := ends(s, "O")) >= 3:
            groups.setdefault("sulfate/sulfonate oxygen", []).append(o)
        elif el[s] == "S" and len(o) == 2:
            groups.setdefault("sulfonyl oxygen", []).append(o)
        elif el[s] == "N" and len(o := ends(s, "O")) == 2:
            groups.setdefault("nitro oxygen", []).append(o)
        elif el[s] == "C" and s not in in_ring and len(n := ends(s, "N")) >= 2:
            groups.setdefault("delocalized nitrogen", []).append(n)
            out.setdefault(s, ("individual_atom", f"{name[s]} site", ""))
    for r in rings:
        kinds = [el[a] for a in r]
        if len(r) in (5, 6) and kinds.count("O") == 1 and kinds.count("C") == len(r) - 1 and any(el[n] in "ON" for a in r if el[a] == "C" for n in adj[a] - set(r)):
            groups.setdefault("sugar-ring carbon", []).append([a for a in r if el[a] == "C"])
        elif len(r) in (5, 6) and all(k in ("C", "N", "O", "S") for k in kinds) and kinds.count("C") >= 3 and planar(np.array([xyz[a] for a in r])):
            fused = next((g for g in groups.get("aromatic ring", []) if set(g) & set(r)), None)
            carbon = [a for a in r if el[a] == "C"]
            fused.extend(a for a in carbon if a not in fused) if fused is not None else groups.setdefault("aromatic ring", []).append(carbon)
    chain, seen = [s for s in order if el[s] == "C" and s not in in_ring and s not in out], set()
    for s in chain:
        if s not in seen:
            part, todo = [], [s]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a), part.append(a)
                    todo += [n for n in adj[a] if n in chain]
            if len(part) > 1:
                groups.setdefault("aliphatic carbon", []).append(sorted(part))
    for core, members in groups.items():
        for k, serials in enumerate(members, 1):
            put(serials, core.replace(" ", "_").replace("/", "_").replace("-", "_"), f"{core} {k} unit" if len(members) > 1 else f"{core} unit", str(k) if len(members) > 1 else "")
    for s in order:
        put([s], "individual_atom", f"{name[s]} site")
    return [(s, *out[s]) for s in order]


UNITS = "structure_id string, resname string, chain string, resseq int, atom_name string, unit string, rule string, evidence string"


def contact_units(atoms: DataFrame, bonds: DataFrame, covalent: float = 1.9) -> DataFrame:
    """A unit for every ligand heavy atom. ``atoms`` are ligand atoms, ``bonds`` (structure_id, u, v) by serial.

    Components without any listed bond take bonds from distances up to ``covalent``. One structure's
    ligands (tens of atoms) are a group; rings need a graph search, which is why this is a grouped function.
    """
    packed = bonds.groupBy("structure_id").agg(F.collect_set(F.struct("u", "v")).alias("bonds"))
    heavy = atoms.where(~F.upper("element").isin("H", "D")).join(packed, "structure_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chain", "resseq", "serial"])
        listed = {(b["u"], b["v"]) for b in (pdf["bonds"].iloc[0] if pdf["bonds"].iloc[0] is not None else [])}
        parts, rows = list(pdf.groupby(["resname", "chain", "resseq"], sort=False)), []
        for (res, chain, seq), part in parts:
            own = {(u, v) for u, v in listed if u in set(part["serial"]) and v in set(part["serial"])}
            evidence = "listed_bonds"
            if not own and len(part) > 1:
                p, s = part[["x", "y", "z"]].to_numpy(float), part["serial"].tolist()
                d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
                own, evidence = {(s[i], s[j]) for i, j in zip(*np.nonzero((d <= covalent) & (d > 0)), strict=True) if i < j}, "local_geometry_covalent_cutoff"
            names = dict(zip(part["serial"], part["atom_name"], strict=True))
            for serial, rule, core, _ in component_units(part, own):
                plain = rule == "metal_ion" or len(parts) == 1
                unit = core if rule == "metal_ion" else (core[:1].upper() + core[1:] if plain and rule != "individual_atom" else core if plain else f"{SHOWN.get(res, res)} {core}")
                if len(parts) == 1 and res in SHOWN and rule != "individual_atom":
                    unit = f"{SHOWN[res]} {core}"
                rows.append((pdf["structure_id"].iloc[0], res, chain, int(seq), names[serial], unit, rule, evidence))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")])

    return heavy.select("structure_id", "serial", "atom_name", "resname", "chain", "resseq", F.upper("element").alias("element"), "x", "y", "z", "bonds").groupBy("structure_id").applyInPandas(run, UNITS)


def consensus_units(units: DataFrame, fraction: float = 0.80) -> DataFrame:
    """(resname, chain, resseq, atom_name, unit, rule, support, decision): groups that recur in enough ligand-bearing structures; others fall back to single sites."""
    key = ["resname", "chain", "resseq", "atom_name"]
    n = units.agg(F.count_distinct("structure_id").alias("n"))
    support = units.groupBy(*key, "unit", "rule").agg(F.count_distinct("structure_id").alias("k")).crossJoin(F.broadcast(n)).withColumn("support", F.col("k") / F.col("n"))
    best = support.groupBy(*key).agg(F.max_by(F.struct("unit", "rule", "support"), F.struct("support", "unit")).alias("b")).select(*key, "b.*")
    applied = F.col("support") >= fraction
    return best.withColumn("unit", F.when(applied, F.col("unit")).otherwise(F.concat("atom_name", F.lit(" site")))).withColumn("decision", F.when(applied, "apply").otherwise("below_consensus"))


def accepted_units(proposals: DataFrame, accepted: list[str], rejected: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(proposals with status proposed, accepted or rejected; accepted and rejected ids that match nothing). A rejection outweighs an acceptance."""
    wanted = {x: "accepted" for x in accepted} | {x: "rejected" for x in rejected}
    ids = proposals.sparkSession.createDataFrame(list(wanted.items()), "proposal_id string, __s string")
    out = proposals.join(F.broadcast(ids), "proposal_id", "left").withColumn("status", F.coalesce("__s", F.lit("proposed"))).drop("__s")  # a configured list
    return out, ids.join(proposals.select("proposal_id"), "proposal_id", "left_anti").select("proposal_id", F.col("__s").alias("asked"))


def proposals(units: DataFrame, fraction: float = 0.80) -> DataFrame:
    """(proposal_id, resname, rule, unit, atoms, support): groups of a residue's atoms that recur in enough structures, to be accepted by id."""
    group = units.where("rule != 'individual_atom'").groupBy("structure_id", "resname", "chain", "resseq", "unit", "rule").agg(F.array_sort(F.collect_set("atom_name")).alias("atoms"))
    n = units.agg(F.count_distinct("structure_id").alias("n"))
    s = group.groupBy("resname", "rule", "unit", "atoms").agg(F.count_distinct("structure_id").alias("k")).crossJoin(F.broadcast(n)).withColumn("support", F.col("k") / F.col("n"))  # one row
    name = F.upper(F.concat_ws("_", "resname", "rule", F.array_join("atoms", "_")))
    return s.where(F.col("support") >= fraction).select(name.alias("proposal_id"), "resname", "rule", "unit", F.array_join("atoms", ";").alias("atoms"), "support")


def substrate_inventory(atoms: DataFrame, smiles: dict[str, str] | None = None) -> DataFrame:
    """(resname, n_structures, atom_names, elements, smiles, smiles_status): heavy atoms of every ligand over all structures. Given SMILES are passed on, not validated."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    heavy = atoms.where(~F.upper("element").isin("H", "D"))
    out = heavy.groupBy("resname").agg(F.count_distinct("structure_id").alias("n_structures"), joined("atom_name").alias("atom_names"), joined(F.upper("element")).alias("elements"))
    given = F.element_at(F.create_map(*[F.lit(x) for kv in smiles.items() for x in kv]), F.col("resname")) if smiles else F.lit(None).cast("string")
    return out.withColumn("smiles", given).withColumn("smiles_status", F.when(F.col("smiles").isNull(), "not_given").otherwise("not_validated"))


def layered_units(atoms: DataFrame, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The unit of each atom key from the first layer that has one, and which layer it was; else the bare key."""
    out, units, sources = atoms, [], []
    for name, df in layers:
        out = out.join(df.select("atom_key", F.col("unit").alias(f"__{name}")), "atom_key", "left")
        units.append(F.col(f"__{name}"))
        sources.append(F.when(F.col(f"__{name}").isNotNull(), name))
    return out.select(*atoms.columns, F.coalesce(*units, F.regexp_replace("atom_key", ":", "_")).alias("unit"), F.coalesce(*sources, F.lit("unmapped")).alias("unit_source"))


def canonical_edges(interactions: DataFrame, units: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(structure_id, edge): unit, supertype and residue of every contact, each once per structure."""
    u = units.select("atom_key", "unit").dropDuplicates(["atom_key"])
    j = interactions.join(u, "atom_key", "left").withColumn("unit", F.coalesce("unit", "atom_key"))
    return j.select("structure_id", F.concat_ws(" | ", "unit", supertype(interaction_type(F.col("type")), overrides), "residue").alias("edge")).distinct()


def class_signatures(edges: DataFrame, classes: DataFrame, policy: str = "most_common") -> DataFrame:
    """(class, signature): of the members' edge sets the most common one (ties: the smallest text), or their intersection."""
    sets = classes.join(edges, "structure_id", "left").groupBy("class", "structure_id").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    if policy == "intersection":
        n = sets.groupBy("class").agg(F.count("*").alias("n"))
        shared = sets.select("class", F.explode("edges").alias("edge")).groupBy("class", "edge").count().join(n, "class").where("count = n")
        out = shared.groupBy("class").agg(F.array_join(F.array_sort(F.collect_set("edge")), "; ").alias("signature"))
        return n.select("class").join(out, "class", "left").select("class", F.coalesce("signature", F.lit("")).alias("signature"))
    counted = sets.groupBy("class", F.array_join("edges", "; ").alias("signature")).count()
    w = Window.partitionBy("class").orderBy(F.desc("count"), "signature")
    return counted.withColumn("k", F.row_number().over(w)).where("k = 1").select("class", "signature")


def split_classes(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(structure_id, class, split): members of a class with unequal edge sets get classes of their own, ``<class>.<k>`` by size and then signature;
    a class whose members agree keeps its name."""
    sets = classes.join(edges, "structure_id", "left").groupBy("class", "structure_id").agg(F.array_join(F.array_sort(F.collect_set("edge")), "; ").alias("signature"))
    each = sets.groupBy("class", "signature").agg(F.count("*").alias("n"))
    k, many = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "signature")), F.count("*").over(Window.partitionBy("class")) > 1
    each = each.withColumn("split", F.when(many, F.concat_ws(".", "class", k.cast("string"))).otherwise(F.col("class")))
    return sets.join(each.select("class", "signature", "split"), ["class", "signature"]).select("structure_id", "class", "split")


def class_visuals(merged: DataFrame, verdicts: DataFrame, paths: DataFrame) -> DataFrame:
    """(merged_class, label, representative, n_structures, structure_ids, is_candidate, representative_path): a row per merged class, in order of its number.

    ``merged`` (structure_id, merged_class), ``verdicts`` (class, is_candidate), ``paths`` (structure_id, path)."""
    order = F.struct(last_integer(F.col("structure_id")).alias("n"), natural_key(F.col("structure_id")).alias("k"), "structure_id")
    ids = F.transform(F.array_sort(F.collect_list(order)), lambda r: r["structure_id"])
    g = merged.groupBy("merged_class").agg(ids.alias("ids"), F.count("*").alias("n_structures"))
    g = g.withColumn("representative", F.get("ids", F.lit(0)))
    out = g.join(verdicts.select(F.col("class").alias("merged_class"), "is_candidate"), "merged_class", "left").join(paths.select(F.col("structure_id").alias("representative"), F.col("path").alias("representative_path")), "representative", "left")
    label = F.replace(F.col("merged_class"), F.lit("class_"), F.lit("Class "))
    return out.select("merged_class", label.alias("label"), "representative", "n_structures", F.array_join("ids", ";").alias("structure_ids"), F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"), "representative_path")


def merged_classes(signatures: DataFrame, classes: DataFrame) -> DataFrame:
    """(structure_id, class, merged_class): classes of equal signature merge and are numbered from 1 by size, then signature."""
    signatures = written(signatures, "signatures")  # a row for each class, used twice
    s = classes.join(signatures, "class")
    g = s.groupBy("signature").agg(F.count("*").alias("n"))
    g = g.withColumn("merged_class", F.concat(F.lit("class_"), F.row_number().over(Window.orderBy(F.desc("n"), "signature")).cast("string")))
    return s.join(g.drop("n"), "signature").select("structure_id", "class", "merged_class", "signature")


def edge_frequencies(edges: DataFrame, structures: DataFrame, common: float = 0.80, rare: float = 0.10) -> DataFrame:
    """(edge, n, total, frequency, category): in how many of the ``structures`` each edge occurs. Distinct counts are plain counts over (edge, structure), reduced map-side first."""
    f = edges.select("edge", "structure_id").distinct().groupBy("edge").agg(F.count("structure_id").alias("n")).crossJoin(F.broadcast(structures.agg(F.count_distinct("structure_id").alias("total"))))
    f = f.withColumn("frequency", F.col("n") / F.col("total"))
    return f.withColumn("category", F.when(F.col("frequency") >= common, "common").when(F.col("frequency") <= rare, "rare").otherwise("other"))


def candidates(class_edges: DataFrame, frequencies: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, n_common_edges_missing, n_rare_edges_present, is_candidate): a candidate has every common edge and no rare one."""
    total = frequencies.agg(F.count(F.when(F.col("category") == "common", 1)).alias("need"))
    c = class_edges.join(frequencies.select("edge", "category"), "edge").groupBy("class").agg(F.count(F.when(F.col("category") == "common", 1)).alias("have"), F.count(F.when(F.col("category") == "rare", 1)).alias("rare"))
    out = classes.select("class").distinct().join(c, "class", "left").crossJoin(F.broadcast(total))
    out = out.select("class", (F.col("need") - F.coalesce("have", F.lit(0))).alias("n_common_edges_missing"), F.coalesce("rare", F.lit(0)).alias("n_rare_edges_present"))
    return out.withColumn("is_candidate", (F.col("n_common_edges_missing") == 0) & (F.col("n_rare_edges_present") == 0))


def topology_audit(nodes: DataFrame, bonds: DataFrame, contacts: DataFrame) -> DataFrame:
    """(structure_id, n_unattached, status): contact endpoints without a covalent neighbour in a ligand of several atoms."""
    ends = bonds.select("structure_id", F.col("u").alias("node")).union(bonds.select("structure_id", "v")).distinct()
    multi = nodes.withColumn("n", F.count("*").over(Window.partitionBy("structure_id", "component"))).where("n > 1")
    loose = contacts.select("structure_id", "node").distinct().join(multi.select("structure_id", "node"), ["structure_id", "node"]).join(ends, ["structure_id", "node"], "left_anti")
    c = loose.groupBy("structure_id").agg(F.count("*").alias("n"))
    return nodes.select("structure_id").distinct().join(c, "structure_id", "left").select("structure_id", F.coalesce("n", F.lit(0)).alias("n_unattached"), F.when(F.col("n") > 0, "warning").otherwise("ok").alias("status"))
