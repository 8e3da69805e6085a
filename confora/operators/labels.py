"""Class labels that stay the same between runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import last_integer
from .graphs import jaccard_candidates

SCHEMA = "current_class string, reference_class string, assigned_class string, match_type string, jaccard double, current_size long, reference_size long"


def stable_labels(current: DataFrame, reference: DataFrame, minimum_jaccard: float = 0.5, prefix: str = "class_") -> DataFrame:
    """Current classes under the labels of a reference run.

    ``current`` (class, structure_id, representative), ``reference`` (reference_class, structure_id, representative). Pairs
    are taken greedily: equal member sets first, then those whose reference representative is still
    a member, then by overlap; a pair needs one of the first two or ``minimum_jaccard``. Unmatched classes
    get numbers after the largest of the reference; reference classes without a match are reported.
    Overlaps are joined and counted by Spark; only class pairs reach the one group that matches them.
    """
    c = current.select(F.col("class").alias("current_class"), "structure_id").distinct()
    r = reference.select("reference_class", "structure_id").distinct()
    pairs = jaccard_candidates(c, r, "structure_id", "current_class", "reference_class")
    rep = reference.where("representative != ''").select("reference_class", F.col("representative").alias("structure_id")).distinct().join(c, "structure_id").select("reference_class", "current_class", F.lit(True).alias("retained")).distinct()
    pairs = pairs.join(rep, ["reference_class", "current_class"], "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    sizes = c.groupBy(F.col("current_class").alias("name")).agg(F.count("*").alias("n")).withColumn("side", F.lit("c")).unionByName(r.groupBy(F.col("reference_class").alias("name")).agg(F.count("*").alias("n")).withColumn("side", F.lit("r")))
    rows = pairs.select("current_class", "reference_class", "shared", "n_current", "n_reference", "jaccard", "retained", F.lit("p").alias("side")).unionByName(
        sizes.select(F.col("name").alias("current_class"), "n", "side").withColumnRenamed("n", "n_current"), allowMissingColumns=True
    )
    rows = rows.withColumns({"ck": last_integer(F.col("current_class")), "rk": last_integer(F.col("reference_class"))})

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        size = {s: dict(zip(p["current_class"], p["n_current"], strict=True)) for s, p in pdf[pdf.side != "p"].groupby("side")}
        key = {n: (k, n) for n, k in zip(pdf["current_class"], pdf["ck"], strict=True)}
        p = pdf[pdf.side == "p"].copy()
        p["exact"] = (p["shared"] == p["n_current"]) & (p["shared"] == p["n_reference"])
        p["gap"] = (p["n_current"] - p["n_reference"]).abs()
        p["kept"] = p["retained"].fillna(False).astype(bool)
        p = p.sort_values(["exact", "kept", "jaccard", "shared", "gap", "rk", "reference_class", "ck", "current_class"], ascending=[False, False, False, False, True, True, True, True, True])
        out, cur, ref = [], set(), set()
        for x in p.itertuples():
            if x.current_class in cur or x.reference_class in ref or not (x.exact or x.kept or x.jaccard >= minimum_jaccard):
                continue
            cur.add(x.current_class), ref.add(x.reference_class)
            kind = "exact_member_set" if x.exact else "reference_representative_retained" if x.kept else "member_overlap"
            out.append((x.current_class, x.reference_class, x.reference_class, kind, float(x.jaccard), int(x.n_current), int(x.n_reference)))
        taken = set(size.get("r", {}))
        number = max((key[n][0] for n in taken if key[n][0] < 10**12), default=0) + 1
        for name in sorted(size.get("c", {}), key=key.get):
            if name not in cur:
                while f"{prefix}{number}" in taken:
                    number += 1
                out.append((name, "", f"{prefix}{number}", "new_class_appended", 0.0, int(size["c"][name]), 0))
                taken.add(f"{prefix}{number}")
                number += 1
        out += [("", n, "", "reference_class_not_present", 0.0, 0, int(size["r"][n])) for n in sorted(size.get("r", {}), key=key.get) if n not in ref]
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.groupBy().applyInPandas(match, SCHEMA)


def relabelled(rows: DataFrame, labels: DataFrame, column: str = "class") -> DataFrame:
    """``rows`` with class names replaced by their assigned ones."""
    m = labels.where("current_class != ''").select(F.col("current_class").alias(column), F.col("assigned_class").alias("__to"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(*rows.columns)
