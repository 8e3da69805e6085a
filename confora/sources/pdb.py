"""Fixed-width structure files as DataFrames.

One scan reads whole files (so line numbers are exact) through Spark's text source, on any store; lines
are cut into columns by JVM expressions. One parser serves all tolerances: a ``Dialect`` says which
records count, what happens to bad lines and which alternate locations stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import AMINO_ACIDS, RADII, first_number, is_hydrogen, token_number
from .shared import file_name

#: Fixed values: (start, length) of the columns, counted from 1.
COLUMNS = {
    "record": (1, 6), "serial": (7, 5), "atom_name": (13, 4), "altloc": (17, 1), "resname": (18, 3), "chain": (22, 1), "resseq": (23, 4), "icode": (27, 1),
    "x": (31, 8), "y": (39, 8), "z": (47, 8), "occupancy": (55, 6), "b_factor": (61, 6), "element": (77, 2),
}
INTEGERS, DOUBLES = ("serial", "resseq"), ("x", "y", "z", "occupancy", "b_factor")
#: Residue names of water.
WATER = ("HOH", "WAT", "H2O", "DOD")
#: Element symbols of two letters that have a radius.
TWO_LETTERS = tuple(e for e in RADII["vdw"] if len(e) == 2)
#: Elements that graphs read from two letters of an atom name, and backbone atoms.
GRAPH_METALS = ("MG", "ZN", "FE", "MN", "CA", "NA", "CL", "CU", "CO", "NI")
BACKBONE = ("N", "CA", "C", "O", "OXT")


@dataclass(frozen=True)
class Dialect:
    """records: which count; required: columns that must parse; on_bad: ``raise``, ``skip`` or ``keep`` (nulls)."""

    records: tuple[str, ...] = ("ATOM", "HETATM")
    required: tuple[str, ...] = ("x", "y", "z")
    on_bad: str = "raise"
    altlocs: tuple[str, ...] | None = None
    blank_chain: str = ""
    last_serial_wins: bool = False
    guess_element: bool = True
    element: str = "clash"


STRICT = Dialect(records=("ATOM",), required=("resseq", "x", "y", "z", "b_factor"), guess_element=False)
CLASH = Dialect(altlocs=("", "A"))
GRAPH = Dialect(required=("serial",), on_bad="keep", last_serial_wins=True, element="graph")
LENIENT = Dialect(required=("resseq", "x", "y", "z"), on_bad="skip", blank_chain="_", element="screening")


def lines(spark: SparkSession, path: str, pattern: str = "*.pdb") -> DataFrame:
    """(structure_id, file, line_index, line); the id is the file name without its last suffix."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(file_name().alias("file"), "value")
    cut = files.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("structure_id"), "file", F.posexplode(F.split("value", "\r?\n")).alias("line_index", "line"))
    return cut.where("line != ''")


def guessed_element(atom_name: Column, explicit: Column) -> Column:
    """The first two letters of the explicit field, or else of the atom name without leading digits, where they are a known symbol; else the first."""
    text = F.upper(F.when(F.trim(explicit) != "", F.trim(explicit)).otherwise(F.regexp_replace(F.trim(atom_name), "^[0-9]+", "")))
    two = F.substring(text, 1, 2)
    return F.when(two.isin(*TWO_LETTERS), two).otherwise(F.substring(text, 1, 1))


def graph_element(atom_name: Column, explicit: Column) -> Column:
    """The whole explicit field, or else the first two letters of the atom name where they are a metal or halide of graphs; else the first letter."""
    name = F.upper(F.regexp_replace(F.trim(atom_name), "[^A-Za-z]", ""))
    two = F.substring(name, 1, 2)
    return F.when(F.trim(explicit) != "", F.upper(F.trim(explicit))).when(two.isin(*GRAPH_METALS), two).otherwise(F.substring(name, 1, 1))


def screening_element(atom_name: Column, explicit: Column) -> Column:
    """The whole explicit field, or else the first two letters of the atom name."""
    return F.when(F.trim(explicit) != "", F.upper(F.trim(explicit))).otherwise(F.upper(F.substring(F.regexp_replace(F.trim(atom_name), "[^A-Za-z]", ""), 1, 2)))


ELEMENTS = {"clash": guessed_element, "graph": graph_element, "screening": screening_element}


def atoms(source: DataFrame, dialect: Dialect = LENIENT) -> DataFrame:
    """Atom records of ``lines``, typed."""
    cut = {c: F.trim(F.substring("line", *at)) for c, at in COLUMNS.items()}
    typed = {c: (v.try_cast("int") if c in INTEGERS else v.try_cast("double") if c in DOUBLES else v) for c, v in cut.items()}
    out = source.where(cut["record"].isin(*dialect.records)).select("structure_id", "line_index", *[v.alias(c) for c, v in typed.items()], "line")
    good = F.lit(True)
    for c in dialect.required:
        good = good & F.col(c).isNotNull()
    if dialect.on_bad == "skip":
        out = out.where(good)
    elif dialect.on_bad == "raise":
        out = out.where(F.coalesce(F.assert_true(good, F.concat(F.lit("bad atom line in "), F.col("structure_id"), F.lit(": "), F.col("line"))).cast("boolean"), F.lit(True)))
    if dialect.altlocs is not None:
        out = out.where(F.col("altloc").isin(*dialect.altlocs))
    if dialect.blank_chain:
        out = out.withColumn("chain", F.when(F.col("chain") == "", dialect.blank_chain).otherwise(F.col("chain")))
    if dialect.guess_element:
        out = out.withColumn("element", ELEMENTS[dialect.element](F.col("atom_name"), F.col("element")))
    if dialect.last_serial_wins:
        row = F.struct(*[c for c in out.columns if c not in ("structure_id", "serial")])
        out = out.groupBy("structure_id", "serial").agg(F.max_by(row, "line_index").alias("r")).select("structure_id", "serial", "r.*")
    return out.drop("line")


def is_water() -> Column:
    return F.upper("resname").isin(*WATER)


def is_ligand() -> Column:
    return (F.col("record") == "HETATM") & ~is_water()


def clash_split(atoms: DataFrame, ligands: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(protein atoms: ATOM records of the twenty amino acids, ligand atoms: HETATM records, of the named residues only where there are names); no water."""
    dry, name = atoms.where(~is_water()), F.upper("resname")
    ligand = F.col("record") == "HETATM"
    return dry.where((F.col("record") == "ATOM") & name.isin(*AMINO_ACIDS)), dry.where(ligand & name.isin(*[x.upper() for x in ligands]) if ligands else ligand)


def screening_split(atoms: DataFrame, scope: str = "all", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(protein atoms: all ATOM records or, in scope ``sidechain``, those off the backbone; ligand atoms: HETATM records less water and ``exclude``), without hydrogens."""
    heavy, name = atoms.where(~is_hydrogen(F.col("element"), F.col("atom_name"))), F.upper("resname")
    protein = heavy.where("record = 'ATOM'")
    if scope == "sidechain":
        protein = protein.where(~F.upper("atom_name").isin(*BACKBONE))
    elif scope != "all":
        raise ValueError(f"unknown protein atom scope {scope!r}")
    ligand = heavy.where((F.col("record") == "HETATM") & ~is_water() & ~name.isin(*[x.upper() for x in exclude]))
    return protein, ligand.where(name.isin(*[x.upper() for x in include])) if include else ligand


def graph_ligands(atoms: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ("HOH", "WAT")) -> DataFrame:
    """HETATM records of the named residues, or of all but ``exclude``."""
    name = F.upper("resname")
    out = atoms.where((F.col("record") == "HETATM") & ~name.isin(*exclude))
    return out.where(name.isin(*include)) if include else out


def conect_edges(source: DataFrame) -> DataFrame:
    """(structure_id, u, v): undirected bonds of CONECT lines, u < v, each once. Reads fixed columns where they parse, else all integers."""
    numbers = F.array(*[F.trim(F.substring("line", 7 + 5 * i, 5)).try_cast("int") for i in range(5)])
    loose = F.transform(F.regexp_extract_all(F.substring("line", 7, 500), F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))
    fixed = F.filter(numbers, lambda x: x.isNotNull())
    found = source.where(F.col("line").startswith("CONECT")).select("structure_id", F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), fixed).otherwise(loose).alias("n"))
    pairs = found.where(F.size("n") > 1).select("structure_id", F.col("n")[0].alias("a"), F.explode(F.slice("n", 2, 100)).alias("b"))
    return pairs.where("a != b").select("structure_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def file_metadata(name: Column) -> dict[str, Column]:
    """rank, model and seed of a predictor's file name."""
    return {k: F.when((n := F.regexp_extract(name, rf"_{k}_(\d+)", 1)) != "", n).cast("int") for k in ("rank", "model", "seed")}


#: Words that a prediction's number follows in a file stem, before and after the rule that a number stands before ``chain``.
TELLING_WORDS, LESS_TELLING_WORDS = ("prediction", "pred", "model"), ("rank",)


def prediction_index(stem: Column, target_id: str | None = None) -> Column:
    """The prediction number of a file stem, read from its tokens between ``_`` and ``-``; the most telling place that has one.

    With a target's id: the token right behind the id, then the number before a chain; else, or without such, the number that goes with a telling word (as the next token, or
    joined to it), the number before a chain, one that goes with a rank, and last the first token that is a number."""
    tokens, places = F.split(F.lower(stem), "[_-]"), []
    if target_id:
        own = target_id.lower()
        behind = F.split(F.substring(F.lower(stem), len(own) + 1, 1000), "[_-]")  # the first of these runs on from the id
        named = F.lower(stem).startswith(own)
        places.append(F.when(named & (F.get(behind, F.lit(0)) == ""), token_number(F.get(behind, F.lit(1)))))
        places.append(F.when(named, first_number(F.slice(behind, 2, 1000), before="chain", whole=False)))
    places += [first_number(tokens, w) for w in TELLING_WORDS]
    places.append(first_number(tokens, before="chain"))
    places += [first_number(tokens, w) for w in LESS_TELLING_WORDS]
    return F.coalesce(*places, first_number(tokens)).cast("long")


def with_coordinates(line: Column, x: Column, y: Column, z: Column) -> Column:
    """The line with new coordinates in its fixed columns; all else stays."""
    padded = F.rpad(line, F.greatest(F.length(line), F.lit(54)), " ")
    return F.concat(F.substring(padded, 1, 30), F.format_string("%8.3f%8.3f%8.3f", x, y, z), F.substring(padded, 55, 1000))


def renamed_line(line: Column, serial: Column | None = None, record: str | None = None, resname: str | None = None, chain: str | None = None, resseq: int | None = None) -> Column:
    """The line with another serial and identity in their fixed columns; what is not given stays."""
    padded = F.rpad(line, F.greatest(F.length(line), F.lit(54)), " ")
    cut = lambda a, b: F.substring(padded, a, b - a + 1)
    return F.concat(
        F.lit(f"{record:<6}") if record else cut(1, 6), F.lpad(serial.cast("string"), 5, " ") if serial is not None else cut(7, 11), cut(12, 17),
        F.lit(f"{resname:>3}"[:3]) if resname else cut(18, 20), cut(21, 21), F.lit(chain[:1]) if chain else cut(22, 22), F.lit(f"{resseq:>4}") if resseq is not None else cut(23, 26), F.substring(padded, 27, 1000),
    )


def file_text(source: DataFrame, line: str = "line") -> DataFrame:
    """(structure_id, text): lines joined in order, for a sink that writes files."""
    rows = F.array_sort(F.collect_list(F.struct("line_index", line)))
    return source.groupBy("structure_id").agg(F.array_join(F.transform(rows, lambda r: r[line]), "\n").alias("text"))


def graph_text(structures: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, text) in the ``t # / v / e`` format; every graph lists all vertices of the blueprint."""
    v = vertices.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_idx", "label"))), lambda r: F.concat_ws(" ", F.lit("v"), r["global_idx"].cast("string"), r["label"])), "\n").alias("v"))
    e = edges.groupBy("structure_id").agg(F.array_sort(F.collect_set(F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))).alias("e"))
    lines_of = F.transform(F.coalesce("e", F.array().cast("array<struct<u: int, v: int>>")), lambda r: F.concat_ws(" ", F.lit("e"), r["u"].cast("string"), r["v"].cast("string"), F.lit("1")))
    out = structures.select("structure_id").distinct().join(e, "structure_id", "left").crossJoin(F.broadcast(v))  # one row, the vocabulary
    return out.select("structure_id", F.concat_ws("\n", F.concat(F.lit("t # "), "structure_id"), "v", F.array_join(lines_of, "\n")).alias("text"))
