"""Rigid superposition of matched atoms (Kabsch), a group per structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kabsch(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation) that take ``moving`` onto ``fixed`` with least squares: x @ rotation + translation."""
    a, b = moving.mean(axis=0), fixed.mean(axis=0)
    u, _, v = np.linalg.svd((moving - a).T @ (fixed - b))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0])
    rotation = u @ flip @ v
    return rotation, b - a @ rotation


def rmsd(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum(axis=1).mean()))


def superpose(moving: DataFrame, fixed: DataFrame, by: list[str], match: list[str], min_matched: int = 3) -> DataFrame:
    """Per group: n_matched, rmsd_before, rmsd_after, rotation (9, row major), translation (3), status.

    Atoms match on the columns of ``match``; matching is a Spark join, only matched coordinates of one
    structure reach a Python task. Fewer than ``min_matched`` atoms give status ``too_few`` and nulls.
    """
    last = lambda df, p: df.groupBy(*by, *match).agg(*[F.last(c).alias(p + c) for c in "xyz"])
    pairs = last(moving, "m").join(last(fixed, "f"), [*by, *match])
    kinds = ", ".join(f"{c} {moving.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = {c: [pdf[c].iloc[0]] for c in by}
        m, f = pdf[["mx", "my", "mz"]].to_numpy(float), pdf[["fx", "fy", "fz"]].to_numpy(float)
        if len(m) < min_matched:
            return pd.DataFrame(keys | {"n_matched": [len(m)], "rmsd_before": [None], "rmsd_after": [None], "rotation": [None], "translation": [None], "status": ["too_few"]})
        r, t = kabsch(m, f)
        return pd.DataFrame(keys | {"n_matched": [len(m)], "rmsd_before": [rmsd(m, f)], "rmsd_after": [rmsd(m @ r + t, f)], "rotation": [r.ravel().tolist()], "translation": [t.tolist()], "status": ["ok"]})

    return pairs.groupBy(*by).applyInPandas(run, f"{kinds}, n_matched long, rmsd_before double, rmsd_after double, rotation array<double>, translation array<double>, status string")
