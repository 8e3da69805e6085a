"""From contact records to graph nodes and edges: resolving ligand atoms, inventories, bonds, ordered nodes, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ligand_label, ligand_node_key, natural_key


def ligand_inventory(given: DataFrame, processed: DataFrame, source: str = "input") -> DataFrame:
    """Ligand atoms of the given file, of the processed one, or of both (by serial, the given one first)."""
    if source == "processed":
        return processed
    if source == "input":
        return given
    if source != "union":
        raise ValueError(f"unknown inventory source {source!r}")
    return given.unionByName(processed.join(given.select("structure_id", "serial"), ["structure_id", "serial"], "left_anti"))


#: Ligand atoms are listed by residue name, chain, number, insertion code, atom name and serial.
ATOM_ORDER = ("resname", "chain", "resseq", "icode", "atom_name", "serial")


def ordered_atoms(atoms: DataFrame) -> DataFrame:
    """Adds atom_number, the place of a ligand atom in its structure's list."""
    return atoms.withColumn("atom_number", F.row_number().over(Window.partitionBy("structure_id").orderBy(*ATOM_ORDER)))


def inspected_residues(atoms: DataFrame) -> DataFrame:
    """(structure_id, resname, chain, resseq, n_atoms, atom_names) of ligand residues, names in file order: what a trimming rule is written from."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "atom_name"))), lambda r: r["atom_name"]), ",")
    return atoms.groupBy("structure_id", "resname", "chain", "resseq").agg(F.count("*").alias("n_atoms"), names.alias("atom_names"))


def ligand_nodes(atoms: DataFrame, key_mode: str = "residue_atom_name", label_mode: str = "auto") -> DataFrame:
    """Adds node_key and label. A key used again gets ``@serial:`` and its serial; the label is left as it is."""
    c = {n: F.col(n) for n in ("resname", "chain", "resseq", "icode", "atom_name", "serial", "element")}
    place = (c["resname"], c["chain"], c["resseq"], c["icode"], c["atom_name"])
    again = F.row_number().over(Window.partitionBy("structure_id", "__key").orderBy("serial")) > 1
    out = atoms.withColumn("__key", ligand_node_key(key_mode, *place, c["serial"]))
    out = out.withColumn("node_key", F.when(again, F.concat("__key", F.lit("@serial:"), F.col("serial").cast("string"))).otherwise(F.col("__key")))
    repeated = F.count("*").over(Window.partitionBy("structure_id", "atom_name")) > 1
    return out.withColumn("label", ligand_label(label_mode, *place, c["element"], repeated)).drop("__key")


#: Covalent radii of elements in ligands (in angstrom) and how many neighbours an atom may have. Metals are left out: their contacts are no bonds.
COVALENT_RADII = {"H": 0.31, "D": 0.31, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "SI": 1.11, "P": 1.07, "S": 1.05, "CL": 1.02, "AS": 1.19, "SE": 1.20, "BR": 1.20, "I": 1.39}
NEIGHBOURS = {"H": 1, "D": 1, "B": 4, "C": 4, "N": 4, "O": 2, "F": 1, "SI": 4, "P": 5, "S": 6, "CL": 4, "AS": 5, "SE": 6, "BR": 1, "I": 3}
#: What a bond may be longer than its radii, and what two atoms must be apart to be two.
SLACK, APART = 0.45, 0.4


def guessed_bonds(atoms: DataFrame, key: list[str], slack: float = SLACK) -> DataFrame:
    """(key, u, v): bonds by distance between atoms of one residue. Two atoms may be bonded within the sum of their covalent radii and ``slack``; each keeps no more than its
    element's number of neighbours, the nearest ones (ties: the lower serial), and a bond holds if both ends keep it. Where the element is blank, the atom's name tells it."""
    letters = F.upper(F.regexp_replace("atom_name", "[^A-Za-z]", ""))
    element = F.when(F.trim("element") != "", F.upper(F.trim("element"))).otherwise(F.substring(letters, 1, 1))
    table = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("el"))
    a = atoms.withColumn("el", element).withColumns({"r": table(COVALENT_RADII), "most": table(NEIGHBOURS)}).where("r is not null").select(*key, "serial", "x", "y", "z", "r", "most", "el")
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    pairs = a.alias("a").join(a.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]).where(F.col("a.serial") != F.col("b.serial"))
    both_h = F.col("a.el").isin("H", "D") & F.col("b.el").isin("H", "D")
    pairs = pairs.withColumn("d", d).where((F.col("d") >= APART) & (F.col("d") <= F.col("a.r") + F.col("b.r") + slack) & ~both_h)
    own = Window.partitionBy(*[F.col(f"a.{k}") for k in key], F.col("a.serial")).orderBy("d", F.col("b.serial"))
    kept = pairs.withColumn("place", F.row_number().over(own)).where(F.col("place") <= F.col("a.most"))
    ends = kept.select(*[F.col(f"a.{k}").alias(k) for k in key], F.least("a.serial", "b.serial").alias("u"), F.greatest("a.serial", "b.serial").alias("v"))
    return ends.groupBy(*key, "u", "v").agg(F.count("*").alias("n")).where("n = 2").drop("n")  # kept from both ends


def ligand_bonds(atoms: DataFrame, listed: DataFrame, slack: float = SLACK) -> DataFrame:
    """(structure_id, u, v, edge_type): listed bonds between ligand atoms; residues without any get bonds from distances."""
    ids = atoms.select("structure_id", "serial", "resname", "chain", "resseq")
    end = lambda s: ids.select("structure_id", F.col("serial").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("resname", "chain", "resseq")])
    known = listed.join(end("u"), ["structure_id", "u"]).join(end("v"), ["structure_id", "v"])
    first = known.select("structure_id", "u", "v", F.lit("listed").alias("edge_type"))
    has = known.select("structure_id", F.col("u_resname").alias("resname"), F.col("u_chain").alias("chain"), F.col("u_resseq").alias("resseq")).distinct()
    key = ["structure_id", "resname", "chain", "resseq"]
    rest = guessed_bonds(atoms.join(has, key, "left_anti"), key, slack)
    return first.unionByName(rest.select("structure_id", "u", "v", F.lit("distance").alias("edge_type")))


def resolved_contacts(contacts: DataFrame, atoms: DataFrame, reach: float = 0.5) -> DataFrame:
    """Contacts with the serial of their ligand atom and how it was found.

    In order: the index of the record (``ligand_serial``), the first listed index that is a ligand atom
    (``ligand_serials``), the residue's only atom (``resname, chain, resseq``), and the atom
    nearest to the record's coordinates within ``reach``. ``contact_id`` names a record.
    """
    ids = atoms.select("structure_id", F.col("serial").alias("s"))
    c = contacts.select("*")
    direct = c.select("structure_id", "contact_id", F.col("ligand_serial").alias("s")).join(ids, ["structure_id", "s"]).select("structure_id", "contact_id", F.col("s").alias("s1"))
    each = c.select("structure_id", "contact_id", F.posexplode("ligand_serials").alias("k", "s")).join(ids, ["structure_id", "s"])
    listed = each.groupBy("structure_id", "contact_id").agg(F.min_by("s", "k").alias("s2"))
    key = ["structure_id", "resname", "chain", "resseq"]
    only = atoms.groupBy(*key).agg(F.count("*").alias("n"), F.min("serial").alias("s3")).where("n = 1").drop("n")
    d2 = sum(((F.col(f"c.{a}") - F.col(f"a.{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    close = c.alias("c").join(atoms.alias("a"), F.col("c.structure_id") == F.col("a.structure_id")).withColumn("d2", d2).where(F.col("d2") <= reach**2)
    close = close.groupBy(F.col("c.structure_id").alias("structure_id"), "contact_id").agg(F.min_by(F.col("a.serial"), F.struct("d2", F.col("a.serial"))).alias("s4"))
    out = c.join(direct, ["structure_id", "contact_id"], "left").join(listed, ["structure_id", "contact_id"], "left").join(only, key, "left").join(close, ["structure_id", "contact_id"], "left")
    how = F.coalesce(*[F.when(F.col(s).isNotNull(), n) for s, n in (("s1", "index"), ("s2", "index_list"), ("s3", "residue"), ("s4", "coordinates"))], F.lit("unresolved"))
    return out.select(*contacts.columns, F.coalesce("s1", "s2", "s3", "s4").alias("serial"), how.alias("resolved_by"))


def graph_edges(contacts: DataFrame) -> DataFrame:
    """(structure_id, u, v, type): a simple graph; of repeated contacts of a pair the last type stands."""
    return contacts.groupBy("structure_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max_by("type", "ordinal").alias("type"))


def scores_with_fallback(regions: DataFrame, values: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """``regions`` with the mean value of the exact key, else of the looser key (all its rows together), else null, and match_mode."""
    e = values.groupBy(*exact).agg(F.avg(value).alias("__e"))
    f = values.groupBy(*loose).agg(F.avg(value).alias("__f"))
    out = regions.join(e, exact, "left").join(f, loose, "left")
    mode = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__f").isNotNull(), "chain_insensitive").otherwise("missing")
    return out.withColumn(value, F.coalesce("__e", "__f")).withColumn("match_mode", mode).drop("__e", "__f")


def ordered_nodes(edges: DataFrame, structure: str, node: str, ordinal: str) -> DataFrame:
    """(structure, nodes): each node once, in the order in which it first appears."""
    first = edges.groupBy(structure, node).agg(F.min(ordinal).alias("o"))
    packed = F.array_sort(F.collect_list(F.struct("o", node)))
    return first.groupBy(structure).agg(packed.alias("p")).select(structure, F.transform("p", lambda r: r[node]).alias("nodes"))


def node_order(mode: str, column: str, manual: list[str] | None = None) -> Column:
    """Sort expression of residues: ``sequence`` (by number), ``first_seen`` (by their ordinal) or ``manual``; those not listed come last."""
    if mode == "manual":
        return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in manual or []]), F.col(column)), F.lit(0)), F.lit(2**31))
    if mode == "first_seen":
        return F.col("ordinal")
    return F.coalesce(F.regexp_extract(column, r"(-?[0-9]+)", 1).try_cast("int"), F.lit(2**31 - 1))


def residue_details(contacts: DataFrame, residue: str = "residue") -> DataFrame:
    """(residue, n, structures): the supporting structures of each residue within reach, in natural order."""
    ids = F.array_sort(F.collect_set(F.struct(natural_key(F.col("structure_id")).alias("k"), "structure_id")))
    return contacts.groupBy(residue).agg(F.count_distinct("structure_id").alias("n"), F.transform(ids, lambda r: r["structure_id"]).alias("structures"))


def closest_atoms(contacts: DataFrame, atoms: DataFrame) -> DataFrame:
    """For each contact the heavy atom of its residue that is closest to the ligand point (x, y, z)."""
    key = ["structure_id", "chain", "resseq"]
    heavy = atoms.where(~F.upper("atom_name").startswith("H"))
    d2 = sum(((F.col(f"c.{a}") - F.col(f"a.{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    j = contacts.alias("c").join(heavy.alias("a"), [F.col(f"c.{k}") == F.col(f"a.{k}") for k in key]).withColumn("d2", d2)
    return j.groupBy(F.col("c.structure_id").alias("structure_id"), "contact_id").agg(F.min_by(F.col("a.atom_name"), F.struct("d2", F.col("a.serial"))).alias("atom_name"), F.sqrt(F.min("d2")).alias("distance"))
