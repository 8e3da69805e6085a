"""Which atoms of a template correspond to which of a structure: by order, by key, or by aligned sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import one_letter
from ..sources.shared import broadcast_if_few
from .seqalign import SCORES, align


def residues(atoms: DataFrame) -> DataFrame:
    """One CA row per residue, in file order: (structure_id, chain, resseq, icode, resname, letter, ordinal, x, y, z)."""
    ca = atoms.where((F.col("record") == "ATOM") & (F.upper("atom_name") == "CA"))
    first = F.min_by(F.struct("resname", "x", "y", "z", "line_index"), "line_index").alias("r")
    r = ca.groupBy("structure_id", "chain", "resseq", "icode").agg(first).select("structure_id", "chain", "resseq", "icode", "r.*")
    order = Window.partitionBy("structure_id").orderBy("line_index")
    return r.select("structure_id", "chain", "resseq", "icode", "resname", one_letter(F.col("resname")).alias("letter"), (F.row_number().over(order) - 1).alias("ordinal"), "x", "y", "z")


def by_order(template: DataFrame, target: DataFrame) -> DataFrame:
    """The n-th residue with the n-th; the longer list is cut off. Template and target coordinates as m* and f*."""
    m = template.select("ordinal", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return target.join(broadcast_if_few(m), "ordinal").select("structure_id", "ordinal", "mx", "my", "mz", *[F.col(c).alias(f"f{c}") for c in "xyz"])  # a template is one protein


def by_key(template: DataFrame, target: DataFrame, key: tuple[str, ...] = ("chain", "resseq", "icode")) -> DataFrame:
    m = template.select(*key, *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return target.join(broadcast_if_few(m), list(key)).select("structure_id", "ordinal", "mx", "my", "mz", *[F.col(c).alias(f"f{c}") for c in "xyz"])


def compatible(template: DataFrame, target: DataFrame) -> DataFrame:
    """(structure_id, compatible): a single chain with the template's residue sequence."""
    seq = lambda df: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "resname"))), lambda r: r["resname"]), "-")
    want = template.agg(seq(template).alias("w"), F.count_distinct("chain").alias("wc"))
    got = target.groupBy("structure_id").agg(seq(target).alias("g"), F.count_distinct("chain").alias("gc"))
    return got.crossJoin(F.broadcast(want)).select("structure_id", ((F.col("w") == F.col("g")) & (F.col("wc") == 1) & (F.col("gc") == 1)).alias("compatible"))  # one row


def chain_pairs(a: dict[str, str], b: dict[str, str]) -> list[tuple[str, str, float, float, list[tuple[int, int]]]]:
    """Greedy one-to-one pairing of chains by identity, then coverage: (a, b, identity, coverage, aligned pairs)."""
    found = []
    for ca, sa in a.items():
        for cb, sb in b.items():
            score, pairs = align(sa, sb, "global", *SCORES["global"])
            if pairs:
                same = sum(sa[i] == sb[j] for i, j in pairs)
                found.append((same / len(pairs), len(pairs) / max(len(sa), len(sb)), score, ca, cb, pairs))
    found.sort(key=lambda x: (-x[0], -x[1], -x[2], x[3], x[4]))
    out, used_a, used_b = [], set(), set()
    for identity, coverage, _, ca, cb, pairs in found:
        if ca not in used_a and cb not in used_b:
            used_a.add(ca), used_b.add(cb)
            out.append((ca, cb, identity, coverage, pairs))
    return out


MATCHED = "structure_id string, template_chain string, target_chain string, identity double, coverage double, mx double, my double, mz double, fx double, fy double, fz double"


def by_sequence(template: DataFrame, target: DataFrame, min_identity: float = 0.3) -> DataFrame:
    """Residue pairs of aligned chains. The template is one protein and travels with the function; a structure is a group."""
    rows = template.select("chain", "letter", "ordinal", "x", "y", "z").orderBy("ordinal").collect()
    chains: dict[str, list] = {}
    for r in rows:
        chains.setdefault(r.chain, []).append(r)
    letters = {c: "".join(r.letter for r in rs) for c, rs in chains.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        own = {c: p.reset_index(drop=True) for c, p in pdf.groupby("chain", sort=False)}
        out = []
        for ca, cb, identity, coverage, pairs in chain_pairs(letters, {c: "".join(p["letter"]) for c, p in own.items()}):
            if identity >= min_identity:
                for i, j in pairs:
                    m, f = chains[ca][i], own[cb].loc[j]
                    out.append((pdf["structure_id"].iloc[0], ca, cb, identity, coverage, m.x, m.y, m.z, f["x"], f["y"], f["z"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MATCHED.split(", ")])

    return target.select("structure_id", "chain", "letter", "ordinal", "x", "y", "z").groupBy("structure_id").applyInPandas(run, MATCHED)
