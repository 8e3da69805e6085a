"""Index tables, manifests, interaction reports and configuration."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import interaction_type, natural_key, shift_last_integer
from ..operators.ordering import globally_numbered
from .shared import file_name, file_system


def resolve_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that the table has, whatever its case."""
    have = {c.lower().strip(): c for c in reversed(columns)}
    return next((have[c] for c in candidates if c in have), None)


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    r = spark.read.option("header", True).option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return bool(fs.exists(at))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, on any store: newest stage first is the caller's order."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these exists: {list(paths)}")


def class_manifest(df: DataFrame, offset: int = 0) -> DataFrame:
    """(reference_class, structure_id, representative) from any accepted column names."""
    at = [resolve_column(df.columns, c) for c in (("reference_class", "stable_class", "class"), ("structure_id", "normalized_structure_id", "graph_id"), ("reference_representative_structure_id", "representative_structure_id", "representative_id"))]
    if not at[0] or not at[1]:
        raise ValueError("a class manifest needs a class and a structure column")
    sid = lambda c: shift_last_integer(F.trim(F.col(c)), offset) if offset else F.trim(F.col(c))
    out = df.select(F.trim(F.col(at[0])).alias("reference_class"), sid(at[1]).alias("structure_id"), (sid(at[2]) if at[2] else F.lit("")).alias("representative"))
    return out.where("reference_class != '' and structure_id != ''")


def source_paths(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """``index`` (path, file) with source_path from the manifest (output, source): by exact path, else by a file name that is unique there."""
    name = F.element_at(F.split("output", "/"), -1)
    exact = manifest.select(F.col("output").alias("path"), F.col("source").alias("s1")).dropDuplicates(["path"])
    unique = manifest.groupBy(name.alias("file")).agg(F.count_distinct("source").alias("n"), F.min("source").alias("s2")).where("n = 1").drop("n")
    return index.join(exact, "path", "left").join(unique, "file", "left").withColumn("source_path", F.coalesce("s1", "s2")).drop("s1", "s2")


#: Elements of one contact in a report under the element of their group, where each keeps its distance, and where its ligand atom's serial.
CONTACT_GROUPS = {
    "hydrophobic_interactions": "hydrophobic_interaction", "hydrogen_bonds": "hydrogen_bond", "water_bridges": "water_bridge", "salt_bridges": "salt_bridge", "pi_stacks": "pi_stack",
    "pi_cation_interactions": "pi_cation_interaction", "halogen_bonds": "halogen_bond", "metal_complexes": "metal_complex",
}
DISTANCES = ("dist", "dist_h-a", "dist_d-a", "centdist", "dist_a-w")
LIGAND_ATOM, LIGAND_DONOR, LIGAND_ACCEPTOR = ("ligcarbonidx", "metal_idx", "don_idx"), ("donoridx", "donor_idx"), ("acceptoridx", "acceptor_idx")


def plip_report(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Contacts of XML reports, one row each: file, folder, kind, resnr, restype, reschain of the protein's residue, restype_lig, resnr_lig, reschain_lig, ligand_serial, ligand_serials, x, y, z, dist.

    One scan: a row of the source is the ``interactions`` of a binding site, with an array for each group of contacts. A ligand atom that donates or accepts is told by
    which side the protein is.
    """
    plain = ("resnr", "restype", "reschain", "restype_lig", "resnr_lig", "reschain_lig", "protisdon", *DISTANCES, *LIGAND_ATOM, *LIGAND_DONOR, *LIGAND_ACCEPTOR)
    contact = "struct<" + ", ".join(f"`{x}`: string" for x in plain) + ", lig_idx_list: struct<idx: array<string>>, ligcoo: struct<x: string, y: string, z: string>>"
    schema = ", ".join(f"{group} struct<{tag}: array<{contact}>>" for group, tag in CONTACT_GROUPS.items())
    sites = spark.read.format("xml").option("rowTag", "interactions").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema(schema).load(path)
    of = lambda group, tag: F.transform(F.coalesce(F.col(f"{group}.{tag}"), F.array().cast(f"array<{contact}>")), lambda c: F.struct(F.lit(tag).alias("tag"), c.alias("c")))
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = sites.select(file_name().alias("file"), F.regexp_extract(place, "([^/]*)/[^/]*$", 1).alias("folder"), F.explode(F.concat(*[of(*g) for g in CONTACT_GROUPS.items()])).alias("r")).where("r.c.resnr is not null")
    c = lambda name: F.col(f"r.c.`{name}`")
    whole = lambda name: c(name).try_cast("int")
    first = lambda names: F.coalesce(*[whole(n) for n in names])
    serial = F.coalesce(first(LIGAND_ATOM), F.when(F.lower(c("protisdon")) == "true", first(LIGAND_ACCEPTOR)).otherwise(first(LIGAND_DONOR)))
    listed = F.filter(F.transform(F.coalesce(F.col("r.c.lig_idx_list.idx"), F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return rows.select(
        "file", "folder", interaction_type(F.col("r.tag")).alias("kind"), whole("resnr").alias("resnr"), c("restype").alias("restype"), c("reschain").alias("reschain"), c("restype_lig").alias("restype_lig"),
        whole("resnr_lig").alias("resnr_lig"), c("reschain_lig").alias("reschain_lig"), serial.alias("ligand_serial"), listed.alias("ligand_serials"),
        *[F.col(f"r.c.ligcoo.{x}").try_cast("double").alias(x) for x in "xyz"], F.coalesce(*[c(d).try_cast("double") for d in DISTANCES]).alias("dist"),
    )


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, file, size, input_order): files of a folder in natural order of their names. Contents are not read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = r.select("path", F.regexp_replace("path", r"^.*/", "").alias("file"), F.col("length").alias("size"))
    return globally_numbered(out, natural_key(F.col("file")), "file", "path", name="input_order")


#: Kinds of result files by their endings, for a listing.
RESULT_KINDS = {"table": ("csv", "tsv", "parquet"), "report": ("json", "md"), "structure": ("pdb",), "text": ("txt",)}


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries; none if there is no such folder."""
    fs, at = file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, kind, size): the results under a folder, newest names last, with what kind of file each is."""
    ending = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    kind = F.coalesce(*[F.when(ending.isin(*v), k) for k, v in RESULT_KINDS.items()], F.lit("other"))
    return files(spark, path, recursive=True).select("path", "file", kind.alias("kind"), "size")


def interaction_lines(spark: SparkSession, path: str, pattern: str = "*.txt", more: Sequence[str] = ()) -> DataFrame:
    """(file, type, ligand, protein, ligand_node_key) of tab-separated ``Key: value`` lines, and further keys in lower case."""
    t = spark.read.option("pathGlobFilter", pattern).text(path).select(file_name().alias("file"), F.str_to_map("value", F.lit("\t"), F.lit(": ")).alias("m"))
    return t.where(F.col("m")["Type"].isNotNull()).select("file", F.trim(F.col("m")["Type"]).alias("type"), F.trim(F.col("m")["Ligand"]).alias("ligand"), F.trim(F.col("m")["Protein"]).alias("protein"), F.trim(F.col("m")["LigandNodeKey"]).alias("ligand_node_key"), *[F.trim(F.col("m")[k]).alias(k.lower()) for k in more])


def graph_files(spark: SparkSession, path: str, pattern: str = "*_final.txt") -> DataFrame:
    """(structure_id, u, v) of ``e`` lines of graph files."""
    t = spark.read.option("pathGlobFilter", pattern).text(path).where(F.col("value").startswith("e "))
    p = F.split("value", r"\s+")
    return t.select(F.regexp_replace(file_name(), r"_final\.txt$", "").alias("structure_id"), p[1].cast("int").alias("u"), p[2].cast("int").alias("v"))


#: Public section names and the runtime names of the same stage.
SECTIONS = {"step04": "step05", "step05": "step06", "step06": "step07", "step07": "step08", "step08": "step09", "step09": "step10"}


def config(path: str | Path, spark: SparkSession | None = None) -> dict:
    """A project's YAML, from the driver's disk or with ``spark`` from any store, with public section names translated when the file says ``workflow_numbering: public``."""
    import yaml

    text = Path(path).read_text(encoding="utf-8") if spark is None else spark.read.text(str(path), wholetext=True).first()[0]
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping")
    if raw.get("workflow_numbering") == "public":
        return {SECTIONS.get(k, k): v for k, v in raw.items()}
    return raw


def batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a CSV or YAML manifest; columns beyond ``project`` and ``config`` become meta_*."""
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        rows = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        rows = rows.get("projects", []) if isinstance(rows, dict) else rows
        names = sorted({k for r in rows for k in r})
        df = spark.createDataFrame([tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    else:
        df = csv(spark, path)
    return df.select(*[F.col(c).alias(c if c in ("project", "config") else f"meta_{c}") for c in df.columns])
