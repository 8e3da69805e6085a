"""Distance joins between point sets, clashes and contacts.

Every join has an equality: the structure, or a voxel of the grid whose edge is the cutoff. Two
points within the cutoff lie in the same or in neighbouring voxels, so the side that is repeated
into its 27 neighbours meets every partner exactly once. Catalyst gets an equi-join with a residual
predicate and never a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import deleted, written


def squared(left: str = "l", right: str = "r") -> Column:
    d = [F.col(f"{left}.{c}") - F.col(f"{right}.{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def voxel_pairs(left: DataFrame, right: DataFrame, cutoff: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of aliases l and r in the same or in neighbouring voxels, with their squared distance ``d2``."""
    by = by or []
    cell = {f"v{c}": F.floor(F.col(c) / F.lit(float(cutoff))) for c in "xyz"}
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r = right
    for c in "xyz":
        r = r.withColumn(f"o{c}", F.explode(near))
    r = r.withColumns({k: v + F.col(f"o{k[1]}") for k, v in cell.items()}).drop("ox", "oy", "oz")
    l = left.withColumns(cell)
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*by, *cell]]
    return l.alias("l").join(r.alias("r"), on).withColumn("d2", squared())


def voxel_join(left: DataFrame, right: DataFrame, cutoff: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of aliases l and r within ``cutoff`` (inclusive), with their squared distance ``d2``."""
    return voxel_pairs(left, right, cutoff, by).where(F.col("d2") <= float(cutoff) ** 2)


def structure_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """All pairs within a structure, with d2. Structures are small; the number of structures is what grows."""
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in by]).withColumn("d2", squared())


def overlaps(pairs: DataFrame, delta: float) -> DataFrame:
    """distance, cutoff (radius sum less delta), overlap and ``clash`` (strictly below the cutoff) of pairs with radii."""
    out = pairs.withColumn("distance", F.sqrt("d2")).withColumn("cutoff", F.col("l.radius") + F.col("r.radius") - F.lit(float(delta)))
    return out.withColumn("overlap", F.col("cutoff") - F.col("distance")).withColumn("clash", F.col("distance") < F.col("cutoff"))


#: Clashing pairs are listed by ligand atom, then protein atom, then distance.
PAIR_ORDER = ("ligand_serial", "protein_serial", "distance")


def ordered_pairs(clashes: DataFrame) -> DataFrame:
    """Adds pair_number, the place of a clashing pair in its structure's list."""
    return clashes.withColumn("pair_number", F.row_number().over(Window.partitionBy("structure_id").orderBy(*PAIR_ORDER)))


def clash_summary(structures: DataFrame, clashes: DataFrame, by: str, max_clashes: int) -> DataFrame:
    """Count, summed overlap, least clash distance and verdict; structures without clashes stay."""
    c = clashes.groupBy(by).agg(F.count("*").alias("n"), F.sum("overlap").alias("o"), F.min("distance").alias("min_clash_distance"))
    out = structures.select(by).distinct().join(c, by, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(by, n.cast("long").alias("clash_count"), F.coalesce("o", F.lit(0.0)).alias("overlap_sum"), "min_clash_distance", (n <= max_clashes).alias("passed"))


def repulsion(clashes: DataFrame, by: str) -> DataFrame:
    """Unit direction that pushes the r side away: overlap-weighted sum of unit vectors from l to r."""
    unit = lambda c: (F.col(f"r{c}") - F.col(f"l{c}")) / F.col("distance") * F.col("overlap")
    s = clashes.where("distance > 0").groupBy(by).agg(*[F.sum(unit(c)).alias(f"s{c}") for c in "xyz"])
    n = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return s.where(n > 0).select(by, *[(F.col(f"s{c}") / n).alias(f"d{c}") for c in "xyz"])


#: The first reach of a nearest neighbour search, which doubles from round to round, and the edge of the cells that targets are gathered in.
FIRST_REACH, CELL = 4.0, 4.0


def nearest_in_rings(left: DataFrame, right: DataFrame, by: list[str], unit: list[str], identity: str, reach: float = FIRST_REACH, compared: list | None = None) -> DataFrame:
    """(by, unit, min_distance, nearest_id): the nearest right point to any left point of each unit in the same ``by``, ties by identity.

    Right points are gathered in cells, each with one of its points. A round joins left points with the cells within the reach, by voxels. The nearest of the
    cells' points bounds the distance of the unit; if the bound is within the reach, all cells that could hold a nearer point were seen, and only cells whose box is
    within the bound are opened. The other units go on with twice the reach. Units of a ``by`` without right points, and points without finite
    coordinates, are left out. ``compared`` takes the pairs that each round compares.
    """
    known = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in "xyz"])
    unit = [c for c in unit if c not in by]
    group, cell = [*by, *unit], [f"c{c}" for c in "xyz"]
    points = right.where(known).select(*by, F.col(identity).alias("identity"), *"xyz").withColumns({f"c{c}": F.floor(F.col(c) / CELL) for c in "xyz"})
    points = written(points, "targets")
    cells = points.groupBy(*by, *cell).agg(F.min(F.struct(*"xyz")).alias("p"))
    cells = written(cells.select(*by, *cell, *[F.col(f"p.{c}").alias(f"p{c}") for c in "xyz"], *[((F.col(f"c{c}") + 0.5) * CELL).alias(c) for c in "xyz"]), "cells")
    rest = written(left.where(known).select(*group, *"xyz").join(cells.select(*by).distinct(), by, "left_semi"), "units")
    found = []
    while not rest.isEmpty():
        met = voxel_pairs(rest, cells, reach + CELL * 3**0.5 / 2, by)
        sum_of = lambda f: reduce(lambda a, b: a + b, [f(c) * f(c) for c in "xyz"])
        to_point, to_box = sum_of(lambda c: F.col(f"l.{c}") - F.col(f"r.p{c}")), sum_of(lambda c: F.greatest(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) - CELL / 2, F.lit(0.0)))
        met = met.select(*[F.col(f"l.{c}").alias(c) for c in group], *[F.col(f"l.{c}").alias(c) for c in "xyz"], *[f"r.{c}" for c in cell], to_point.alias("to_point"), to_box.alias("to_box"))
        met = met.withColumn("bound", F.min("to_point").over(Window.partitionBy(*group)))
        opened = met.where((F.col("bound") <= reach**2) & (F.col("to_box") <= F.col("bound") * (1 + 1e-9) + 1e-9)).select(*group, *"xyz", *cell)
        pairs = opened.alias("l").join(points.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, *cell]]).withColumn("d2", squared())
        if compared is not None:
            compared.append(met.count() + pairs.count())
        hits = pairs.groupBy(*[F.col(f"l.{c}").alias(c) for c in group]).agg(F.sqrt(F.min("d2")).alias("min_distance"), F.min_by("r.identity", F.struct("d2", "r.identity")).alias("nearest_id"))
        found.append(hits := written(hits, "nearest"))
        same = [F.col(f"u.{c}").eqNullSafe(F.col(f"h.{c}")) for c in group]
        after = written(rest.alias("u").join(hits.alias("h"), same, "left_anti"), "units")
        deleted(rest)
        rest, reach = after, reach * 2
    if not found:
        return rest.select(*group, F.lit(0.0).alias("min_distance"), F.lit(None).cast(points.schema["identity"].dataType).alias("nearest_id"))
    return reduce(DataFrame.unionByName, found)
