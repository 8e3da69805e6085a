"""What a stage leaves behind: tables, exports, id lists, reports, structure files."""

from __future__ import annotations

import re

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settings import structure_id
from .pdb import renamed_line


def stage_tables(df: DataFrame, path: str, flag: str = "passed", csv: bool = False) -> None:
    """All rows, partitioned by the verdict (read back as text), so that the next stage reads only what passed."""
    df.write.mode("overwrite").partitionBy(flag).parquet(f"{path}/table")
    if csv:
        flat = df.select(*[F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def id_list(df: DataFrame, path: str, column: str = "structure_id") -> None:
    df.select(F.col(column).cast("string")).orderBy(column).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str, name: str, flag: str = "passed", **settings) -> dict:
    """Counts by verdict and the settings, from one aggregated row, as JSON and Markdown beside the tables."""
    row = df.agg(F.count("*").alias("n_structures"), F.count(F.when(F.col(flag), 1)).alias("n_passed")).first().asDict()
    facts = {"stage": name, **row, "n_failed": row["n_structures"] - row["n_passed"], **settings}
    spark = df.sparkSession
    lines = [f"# {name}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for kind, text in (("json", json.dumps(facts, indent=1, default=str)), ("md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report_{kind}")
    return facts


def packed_structures(texts: DataFrame, path: str, per_file: int = 5000) -> None:
    """(structure_id, text) packed into sorted files of up to ``per_file`` structures: their statistics are the index that a lookup by id prunes with."""
    texts.select("structure_id", "text").repartitionByRange("structure_id").sortWithinPartitions("structure_id").write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def packed_structure(spark, path: str, structure_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("structure_id") == structure_id)


def append_pairs(pairs: DataFrame, path: str, by: str = "edge_count") -> None:
    """Appends pair results to a table partitioned by block, so that a run that stops keeps the blocks it has finished."""
    pairs.write.mode("append").partitionBy(by).parquet(path)


def pair_line() -> Column:
    """A pair result (leader, member, distance) as a tab-separated line; infinite distances are ``inf``, whole ones have no decimals."""
    d = F.when(F.col("distance") == float("inf"), "inf").when(F.col("distance") == F.floor("distance"), F.col("distance").cast("long").cast("string")).otherwise(F.col("distance").cast("string"))
    return F.concat_ws("\t", F.col("leader").cast("string"), F.col("member").cast("string"), d)


#: Folders by preference for a structure's file.
FOLDERS = (
    "04_catalytic_region_plddt_qc", "05_catalytic_region_plddt_qc", "05_pocket_plddt_qc", "04_ligand_atom_trimming", "03_clash_filter",
    "02_template_guided_docking", "05_plip_interaction_graphs", "06_plip_interaction_graphs",
)


#: The score outside of these folders, what a profiler's file costs, and what each preferred name gains.
NO_FOLDER, PROFILER_FILE, PREFERRED_NAME = 999, 10, 1


def file_score(path: Column) -> Column:
    """Preference of a structure file, smaller is better: its stage's place in FOLDERS, worse if a profiler made it, better for each of
    a trimmed complex and a name that ends in ``_complex.pdb``."""
    place = F.coalesce(*[F.when(F.contains(path, F.lit(f)), i) for i, f in enumerate(FOLDERS)], F.lit(NO_FOLDER))
    name = F.lower(F.regexp_replace(path, r"^.*/", ""))
    made = F.contains(name, F.lit("protonated")) | F.contains(name, F.lit("xcbrefx")) | F.contains(name, F.lit("plipfixed"))
    gain = lambda c: F.when(c, PREFERRED_NAME).otherwise(0)
    return place + F.when(made, PROFILER_FILE).otherwise(0) - gain(F.contains(name, F.lit("trimmed_complex"))) - gain(name.endswith("_complex.pdb"))


def file_kind(path: Column) -> Column:
    name = F.regexp_replace(path, r"^.*/", "")
    return F.when(name.endswith("_final.txt"), "graph").when(F.contains(name, F.lit("interaction_output")) & name.endswith(".txt"), "interaction").when(name == "report.xml", "plip_report_xml").when(
        name == "report.txt", "plip_report_txt").when(F.lower(name).endswith(".pdb"), "pdb")


def file_index(files: DataFrame) -> DataFrame:
    """(structure_id, kind, path, score) of the files (path) that an export can use; reports are named after their folder. Hidden files do not count."""
    name, kind = F.regexp_replace("path", r"^.*/", ""), file_kind(F.col("path"))
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    owner = F.when(name.isin("report.xml", "report.txt", "interaction_output.txt"), folder).otherwise(name)
    rows = files.where(kind.isNotNull() & ~name.startswith(".")).select(structure_id(owner, "export").alias("structure_id"), kind.alias("kind"), "path")
    return rows.where("structure_id != ''").withColumn("score", F.when(F.col("kind") == "pdb", file_score(F.col("path"))).otherwise(0))


#: The folder of each kind of exported file.
EXPORT_FOLDERS = {"pdb": "complexes", "graph": "ged_input_files", "interaction": "interaction_outputs", "plip_report_xml": "plip_reports", "plip_report_txt": "plip_reports"}


def export_targets(index: DataFrame, kinds: list[str], path: str) -> DataFrame:
    """(structure_id, class, kind, source, target) of an ``export_index``: a folder for each kind and class. Reports are named after their structure, and so are files whose names would meet."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("source")) for k in kinds])).alias("f")
    jobs = index.select("structure_id", F.coalesce(F.nullif(F.trim("class"), F.lit("")), F.lit("unclassified")).alias("class"), each).select("structure_id", "class", "f.*").where("source is not null")
    name = F.regexp_replace("source", r"^.*/", "")
    folder = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in EXPORT_FOLDERS.items()], F.col("kind"))
    owned = F.when(F.col("kind") == "interaction", F.concat("structure_id", F.lit("_interaction_output.txt"))).when(F.col("kind").startswith("plip_report"), F.concat("structure_id", F.lit("_"), name)).otherwise(name)
    jobs = jobs.withColumn("__t", F.concat_ws("/", F.lit(path.rstrip("/")), folder, "class", owned))
    shared_name = F.size(F.collect_set("source").over(Window.partitionBy("__t"))) > 1
    own = F.concat_ws("/", F.lit(path.rstrip("/")), folder, "class", F.concat("structure_id", F.lit("_"), name))
    return jobs.withColumn("target", F.when(shared_name, own).otherwise(F.col("__t"))).drop("__t")


def copied(batches):
    """Copies source to target for each row, in pieces; a file takes its name when it is whole, so that a repeated or lost task leaves no half of one."""
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    store = lambda at: fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", at))  # noqa: E731  local paths, and stores that pyarrow reaches
    for batch in batches:
        n, states = [], []
        for r in batch.to_pylist():
            try:
                (source, there), (target, here) = store(r["source"]), store(r["target"])
                target.create_dir(here.rsplit("/", 1)[0], recursive=True)
                part, size = f"{here}.{uuid.uuid4().hex}", 0
                with source.open_input_stream(there) as read, target.open_output_stream(part) as write:
                    while piece := read.read(1 << 20):
                        write.write(piece)
                        size += len(piece)
                target.move(part, here)
                n.append(size)
                states.append("copied")
            except FileNotFoundError:
                n.append(None)
                states.append("source not found")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(states, pa.string())], [*batch.schema.names, "bytes", "status"])


def exported_files(spark, index: DataFrame, kinds: list[str], path: str) -> DataFrame:
    """Copies the files of an ``export_index``, byte for byte, to stated names under ``path``; (structure_id, class, kind, source, target, bytes, status).

    Executors copy, each its rows; the driver sees no list of files. The result is also the manifest, ``path``/manifest, written last: an export without it is not finished.
    """
    jobs = export_targets(index, kinds, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    done = jobs.repartition("target").mapInArrow(copied, f"{schema}, bytes long, status string")
    done.write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def export_index(chosen: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """``chosen`` with the best file of each kind (by score, then the shortest path, then the path) and notes on what is missing."""
    best = files.groupBy("structure_id", "kind").agg(F.min(F.struct(F.col("score"), F.length("path").alias("n"), F.col("path"))).alias("b")).select("structure_id", "kind", F.col("b.path").alias("path"))
    wide = best.groupBy("structure_id").pivot("kind", kinds).agg(F.first("path"))
    out = chosen.join(wide, "structure_id", "left")
    return out.withColumn("notes", F.concat_ws("; ", *[F.when(F.col(k).isNull(), f"no {k} file") for k in kinds]))


def complex_lines(protein: DataFrame, ligands: DataFrame, identity: dict | None = None) -> DataFrame:
    """(structure_id, line_index, line): protein lines, ligand lines and an end record, in that order, atoms numbered through.

    ``identity`` (resname, chain, resseq) is what ligand lines are renamed to; they become HETATM records then."""
    if identity:
        ligands = ligands.withColumn("line", renamed_line(F.col("line"), record="HETATM", **identity))
    p = protein.select("structure_id", F.lit(0).alias("part"), F.col("line_index").cast("long").alias("i"), "line")
    lig = ligands.select("structure_id", F.lit(1), F.col("line_index").cast("long"), "line")
    end = protein.select("structure_id").distinct().select("structure_id", F.lit(2), F.lit(0).cast("long"), F.lit("END"))
    both = p.union(lig).union(end)
    n = F.row_number().over(Window.partitionBy("structure_id").orderBy("part", "i"))
    line = F.when(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"), renamed_line(F.col("line"), serial=n)).otherwise(F.col("line"))
    return both.select("structure_id", (n - 1).alias("line_index"), line.alias("line"))
