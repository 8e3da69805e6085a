"""Pairwise sequence alignment as an Arrow-batched column function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(a: str, b: str, mode: str = "global", match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[float, list[tuple[int, int]]]:
    """(score, aligned index pairs). Ties prefer the diagonal, then a gap in ``b``, then one in ``a``. Local: Smith-Waterman.

    Of the score matrix only every k-th row is kept, k being the root of the number of rows. The way back takes one block of rows after the other, computed
    again from the row above it and only as far right as the way can still go: memory grows with the length times its root, time doubles at most.
    """
    n, m, local = len(a), len(b), mode == "local"
    letters, every = np.frombuffer(b.encode("utf-32-le"), np.uint32), max(1, math.isqrt(n))
    steps = gap * np.arange(m + 1, dtype=np.int32)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        """Row ``i`` of the matrix from the one above."""
        width = len(row)
        diagonal = row[:-1] + np.where(letters[: width - 1] == ord(a[i - 1]), match, mismatch).astype(np.int32)
        inner = np.maximum(diagonal, row[1:] + gap)
        whole = np.concatenate([np.array([0 if local else gap * i], np.int32), np.maximum(inner, 0) if local else inner])
        return np.maximum.accumulate(whole - steps[:width]) + steps[:width]  # gaps along the row

    row = np.zeros(m + 1, np.int32) if local else steps.copy()
    kept, best, i, j = {0: row}, int(row.max()) if local else 0, 0, int(row.argmax())
    for k in range(1, n + 1):
        row = below(row, k)
        if k % every == 0:
            kept[k] = row
        if local and row.max() > best:
            best, i, j = int(row.max()), k, int(row.argmax())
    if not local:
        best, i, j = int(row[m]), n, m
    pairs = []
    while i > 0 and j > 0:
        top = (i - 1) // every * every
        rows = [kept[top][: j + 1]]
        for k in range(top + 1, i + 1):
            rows.append(below(rows[-1], k))
        if local and rows[-1][j] == 0:
            break
        while i > top and j > 0 and not (local and rows[i - top][j] == 0):
            here, above = rows[i - top], rows[i - top - 1]
            if here[j] == above[j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif here[j] == above[j] + gap:
                i -= 1
            else:
                j -= 1
    return float(best), pairs[::-1]


#: Scores of the global and the local alignment.
SCORES = {"global": (2, -1, -2), "local": (3, -2, -3)}


def aligned_pairs(df: DataFrame, source: str, target: str, mode: str = "global") -> DataFrame:
    """Adds score, pairs (array of (i, j)), identity, source_coverage and target_coverage; null sequences give nulls."""

    @F.pandas_udf("score double, pairs array<struct<i: int, j: int>>, identity double, source_coverage double, target_coverage double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append((None, None, None, None, None))
                continue
            score, pairs = align(x, y, mode, *SCORES[mode])
            same = sum(x[i] == y[j] for i, j in pairs)
            out.append((score, [{"i": i, "j": j} for i, j in pairs], same / len(pairs) if pairs else 0.0, len(pairs) / len(x) if x else 0.0, len(pairs) / len(y) if y else 0.0))
        return pd.DataFrame(out, columns=["score", "pairs", "identity", "source_coverage", "target_coverage"])

    return df.withColumn("__a", run(source, target)).select("*", "__a.*").drop("__a")
