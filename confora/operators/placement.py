"""Ligand placement: rigid transform onto each structure, then deterministic clash relief with a full trace."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

TRACE = "structure_id string, attempt int, phase string, action string, clashes_before int, score_before double, clashes_after int, score_after double, translation double, rotation_deg double"


class Obstacles:
    """Points sorted by voxel, so that a trial costs the neighbourhood of the ligand and not all points."""

    def __init__(self, points: np.ndarray, edge: float):
        self.edge = edge
        cell = np.floor(points / edge).astype(np.int64)
        self.low = cell.min(axis=0) if len(points) else np.zeros(3, np.int64)
        self.size = (cell.max(axis=0) - self.low + 1) if len(points) else np.ones(3, np.int64)
        code = self.code(cell)
        order = np.argsort(code, kind="stable")
        self.points, self.codes = points[order], code[order]

    def code(self, cell: np.ndarray) -> np.ndarray:
        c = cell - self.low
        return (c[..., 0] * self.size[1] + c[..., 1]) * self.size[2] + c[..., 2]

    def near(self, ligand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(obstacle, ligand atom) of every pair in the same or in neighbouring voxels."""
        cell = np.floor(ligand / self.edge).astype(np.int64)[:, None] + AROUND
        at, atom = cell.reshape(-1, 3), np.repeat(np.arange(len(ligand)), len(AROUND))
        inside = ((at >= self.low) & (at < self.low + self.size)).all(axis=1)
        code, atom = self.code(at[inside]), atom[inside]
        first, last = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        n = last - first
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.points[place], ligand[np.repeat(atom, n)]


AROUND = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])


def collisions(obstacles: Obstacles | np.ndarray, ligand: np.ndarray, threshold: float) -> tuple[int, float, np.ndarray]:
    """(pairs below the threshold, summed depth, unit direction away from them weighted by depth). Voxels must be no smaller than the threshold."""
    found = obstacles if isinstance(obstacles, Obstacles) else Obstacles(obstacles, threshold)
    there, here = found.near(ligand)
    diff = here - there
    d = np.sqrt((diff**2).sum(axis=1))
    near = d < threshold
    diff, d = diff[near], d[near]
    depth = threshold - d
    push = (diff / np.maximum(d, 1e-12)[:, None] * depth[:, None]).sum(axis=0)
    size = np.linalg.norm(push)
    return len(d), float(depth.sum()), push / size if size > 1e-12 else np.zeros(3)


def rotated(x: np.ndarray, axis: np.ndarray, degrees: float) -> np.ndarray:
    a, c = np.radians(degrees), x.mean(axis=0)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return (x - c) @ (np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k).T + c


STEPS = {"translate": 1.0, "rotate": 12.0}
SMALLEST = {"translate": 0.05, "rotate": 0.5}


def axes_across(direction: np.ndarray) -> list[np.ndarray]:
    """Two unit axes that are perpendicular to the direction and to each other."""
    first = np.cross(direction, np.eye(3)[np.argmin(np.abs(direction))])
    first = first / np.linalg.norm(first)
    return [first, np.cross(direction, first)]


def relieved(obstacles: Obstacles | np.ndarray, ligand: np.ndarray, threshold: float = 2.0, attempts: int = 50, max_shift: float = 5.0, max_turn: float = 30.0):
    """(coordinates, trace): a bounded pattern search, without random numbers.

    Every attempt weighs a step away from the clash, turns about the axes along and across it, and both together; the one
    with the least summed depth is taken if it is less than now, else the steps are halved. It ends without clashes, with steps too small to
    matter, or after ``attempts``; the shift never exceeds ``max_shift`` and the turns never add up to more than ``max_turn``.
    The result is the best position seen, which is always the last one taken.
    """
    obstacles = obstacles if isinstance(obstacles, Obstacles) else Obstacles(obstacles, threshold)
    now, trace = ligand.copy(), []
    shift, turned, step = np.zeros(3), 0.0, dict(STEPS)
    n, score, away = collisions(obstacles, now, threshold)
    for k in range(1, attempts + 1):
        if n == 0 or all(step[p] < SMALLEST[p] for p in step):
            break
        if not away.any():
            away = np.array([0.0, 0.0, 1.0])
        moves = [("translate", away * step["translate"], None, 0.0)]
        angle = min(step["rotate"], max_turn - turned)
        if angle > 1e-9:
            turns = [(axis, sign * angle) for axis in (away, *axes_across(away)) for sign in (1, -1)]
            moves += [("rotate", np.zeros(3), *t) for t in turns] + [("combined", away * step["translate"], *t) for t in turns]
        tried = []
        for order, (phase, by, axis, degrees) in enumerate(moves):
            if np.linalg.norm(shift + by) <= max_shift + 1e-9:
                x = (rotated(now, axis, degrees) if axis is not None else now) + by
                tried.append((collisions(obstacles, x, threshold)[1], order, phase, by, abs(degrees), x))
        best = min(tried, default=None, key=lambda t: t[:2])
        if best is None or best[0] >= score - 1e-12:
            step = {p: s / 2 for p, s in step.items()}
            trace.append((k, "halved", "none", n, score, n, score, float(np.linalg.norm(shift)), turned))
            continue
        before, (_, _, phase, by, degrees, now) = (n, score), best
        shift, turned = shift + by, turned + degrees
        n, score, away = collisions(obstacles, now, threshold)
        trace.append((k, phase, "moved", *before, n, score, float(np.linalg.norm(shift)), turned))
    return now, trace


AUDIT = "structure_id string, group_index int, n_atoms int, clashes_before int, clashes_after int, n_attempts int, shift double, turn_deg double, clear boolean"
PLACED = ", ".join(dict.fromkeys(f"structure_id string, kind string, group_index int, atom_index int, x double, y double, z double, {TRACE}, {AUDIT}".split(", ")))


def placed(transforms: DataFrame, protein: DataFrame, ligands: DataFrame, threshold: float = 2.0, avoid: bool = True, assembly: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, trace, audit). ``transforms`` (structure_id, rotation, translation) take the template onto a structure; ``ligands``
    (group_index, atom_index, x, y, z) are the template's ligand groups, a few hundred rows. Groups are placed in order and
    become obstacles of the next ones, or move as one body (``assembly``). Every structure is placed once: its rows of all three kinds
    leave the same pass, kept in the shared folder."""
    template = ligands.orderBy("group_index", "atom_index").toPandas()  # one template
    packed = protein.groupBy("structure_id").agg(F.collect_list(F.struct("x", "y", "z")).alias("p"))
    jobs = transforms.join(packed, "structure_id")
    names = [c.split()[0] for c in PLACED.split(", ")]

    def place(row):
        r, t = np.array(row.rotation).reshape(3, 3), np.array(row.translation)
        obstacles = np.array([(a["x"], a["y"], a["z"]) for a in row.p])
        for _, part in [(1, template)] if assembly else template.groupby("group_index", sort=True):
            x, trace = part[["x", "y", "z"]].to_numpy(float) @ r + t, []
            there = Obstacles(obstacles, threshold)
            before = collisions(there, x, threshold)[0]
            if avoid:
                x, trace = relieved(there, x, threshold)
            after = collisions(there, x, threshold)[0]
            obstacles = np.concatenate([obstacles, x])
            g = int(part["group_index"].iloc[0])
            for gi, i, p in zip(part["group_index"], part["atom_index"], x, strict=True):
                yield {"structure_id": row.structure_id, "kind": "atom", "group_index": int(gi), "atom_index": int(i), "x": p[0], "y": p[1], "z": p[2]}
            for step in trace:
                yield {"structure_id": row.structure_id, "kind": "trace", "group_index": g, **dict(zip([c.split()[0] for c in TRACE.split(", ")][1:], step, strict=True))}
            shift, turn = trace[-1][-2:] if trace else (0.0, 0.0)
            moved = sum(t[2] == "moved" for t in trace)
            yield {"structure_id": row.structure_id, "kind": "audit", "group_index": g, "n_atoms": len(part), "clashes_before": before, "clashes_after": after, "n_attempts": moved, "shift": shift, "turn_deg": turn, "clear": after == 0}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for row in pdf.itertuples() for x in place(row)], columns=names).astype(object).where(lambda d: d.notna(), None)

    done = written(jobs.mapInPandas(run, PLACED), "placed")
    kind = lambda k, schema: done.where(F.col("kind") == k).select(*[c.split()[0] for c in schema.split(", ")])
    return kind("atom", "structure_id string, group_index int, atom_index int, x double, y double, z double"), kind("trace", TRACE), kind("audit", AUDIT)
