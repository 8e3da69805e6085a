"""Near-duplicate vectors by spherical k-means cells and blocked cosine products, without losing a link.

Cells are Voronoi cells of unit centroids. Vectors of a pair with cosine >= t lie within r = sqrt(2 - 2t) of
each other on the unit sphere. If x is at home in cell i and y in cell j, the plane that bisects i and j
stands between them, so their distances to it add up to r at most, and one of the two lies within r / 2 of it. A
vector therefore also visits every cell whose bisecting plane with its own is within r / 2, and every pair
meets in the home cell of one of its two vectors: nothing is sampled, estimated or tuned, whatever the
distribution of the data or the centroids. How many cells a vector visits does depend on the data: few where the
vectors have structure (low intrinsic dimension, clusters), a good part of all cells where they fill many dimensions evenly.

Bit-equal vectors are first collapsed to one weighted representative. Large cells are cut into home
blocks; within a block the products are matrix products, and only link counts and component edges
leave it. The number of cells grows with the number of rows up to MAX_CELLS, beyond which cells grow and are
compared block by block.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
kept; vectors of different lengths never link; equal vectors (ties, repeated rows) link; an id that names
several vectors is a vector for each, and so is every row with a null id, which is the least of no component that has another id and is kept
only in one that has none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, n_partitions, renamed, written

#: Documented bounds: rows for each fitted cell, the number of cells, and the representatives that a cell is to hold below that number.
FIT_ROWS_PER_CELL = 8
MAX_CELLS = 8192
ROWS_PER_CELL = 1024
#: Home rows of a block; a block's inner state is about BLOCK x BATCH booleans.
BLOCK = 2048
BATCH = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids; cells that run empty are dropped."""
    rng = np.random.default_rng(seed)
    c = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(rows[i : i + BATCH] @ c.T).argmax(axis=1) for i in range(0, len(rows), BATCH)])
        total = np.zeros_like(c)
        np.add.at(total, home, rows)
        size = np.sqrt((total * total).sum(axis=1))
        c = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def fit_cells(reps: DataFrame, n: int, rows_per_cell: int, seed: int = 11) -> dict[int, np.ndarray]:
    """Centroids by vector length, fitted on a sample of at most FIT_ROWS_PER_CELL rows for each cell."""
    cells = min(MAX_CELLS, max(1, n // rows_per_cell))
    rows = FIT_ROWS_PER_CELL * cells
    some = reps.select("vec").sample(min(1.0, 1.2 * rows / max(n, 1)), seed=seed).limit(rows).toPandas()["vec"]
    by: dict[int, list] = {}
    for v in some:
        by.setdefault(len(v), []).append(v)
    return {d: spherical_kmeans(unit(np.array(v, dtype=np.float64)), max(1, cells * len(v) // len(some))) for d, v in by.items()}


def visited(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cells, boolean matrix of visited cells) of unit rows ``x``: cells whose bisecting plane with the home cell is within ``reach``."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
    near = dots.max(axis=1)[:, None] - dots <= reach * apart + 1e-9
    near[np.arange(len(x)), home] = True
    return home, near


def by_length(column: pa.ListArray):
    """(length, rows, matrix) for each length among the lists."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        yield int(d), at, values[offsets[at][:, None] + np.arange(d)].astype(np.float64)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    spark = vectors.sparkSession
    v = renamed(vectors, id=id_col, vec=vec_col)
    if v.schema["vec"].dataType.elementType.typeName() not in ("float", "double"):
        v = v.withColumn("vec", F.col("vec").cast("array<double>"))
    kind = v.schema["vec"].dataType.elementType.typeName()  # vectors travel as they are and are compared in double precision
    good = F.coalesce(
        (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    v = v.select("id", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)).alias("vec"), good.alias("good"))
    v = v.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit("second"), "vec")})
    reps = v.where("good").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    reps = written(reps.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), "id", "n", "vec"), "reps")
    cells = fit_cells(reps, reps.count(), rows_per_cell)
    first = np.cumsum([0, *(len(cells[d]) for d in sorted(cells))])
    shared = spark.sparkContext.broadcast((cells, {d: int(first[i]) for i, d in enumerate(sorted(cells))}))  # at most MAX_CELLS centroids
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2

    def assign(batches):
        """A row for the home cell, which knows all visited cells, and one for each visited cell."""
        cells, offset = shared.value
        names = ["cell", "home_cell", "visits", "rep", "n", "vec"]
        for b in batches:
            for d, at, x in by_length(b.column(2)):
                c = cells.get(d)
                step = 1024 if c is None else max(16, min(1024, (1 << 21) // len(c)))
                for s in range(0, len(at), step):
                    some = at[s : s + step]
                    if c is None:  # a length too rare for the sample has one cell
                        take, cell = some, np.full(len(some), -d)
                        home, visits = cell, [[-d]] * len(some)
                    else:
                        homes, near = visited(unit(x[s : s + step]), c, reach)
                        row, cell = np.nonzero(near)
                        take, cell, home = some[row], cell + offset[d], homes[row] + offset[d]
                        lists = np.split(cell, np.cumsum(near.sum(axis=1))[:-1])
                        visits = [lists[r].tolist() if i == h else None for r, i, h in zip(row.tolist(), cell.tolist(), home.tolist(), strict=True)]
                    got = b.take(pa.array(take, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32())), got.column(0), got.column(1), got.column(2)], names)

    spread = max(n_partitions(spark), 1)
    members = reps.select("rep", "n", "vec").repartition(spread).mapInArrow(assign, f"cell int, home_cell int, visits array<int>, rep long, n long, vec array<{kind}>")
    members = written(members, "members")
    blocks = members.where("cell = home_cell").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spots = members.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spots = spots.withColumn("home", (F.col("home_cell") == F.col("cell")) & (mine == F.col("block"))).select("cell", "block", "home", "rep", "n", "vec", "home_cell", "visits")
    dealt = spots.repartition(spread, "cell", "block").sortWithinPartitions("cell", "block", F.desc("home"), "rep")

    def compare(batches):
        yield from compared(batches, threshold)

    found = written(dealt.mapInArrow(compare, "rep long, links long, other long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    comp = written(reps.select("rep", "id").join(comp, F.col("rep") == comp.node), "components")
    comp = comp.join(comp.groupBy("component").agg(F.min("id").alias("least")), "component").select("rep", "least")
    known = reps.select("k1", "k2", "rep", "n", F.col("id").alias("own")).join(links, "rep", "left").join(comp, "rep", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "own").alias("component_id"), F.lit(True).alias("good"))
    result = v.select("id", "k1", "k2", "good").join(known, ["k1", "k2", "good"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def record(rep, links, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["rep", "links", "other"])


class Block:
    """Home rows of one block of a cell: their links so far and the labels of what they link with."""

    def __init__(self, cell: int, threshold: float):
        self.cell, self.threshold, self.parts, self.visits, self.rows = cell, threshold, [], [], None

    def add(self, ids, weights, rows, visits) -> None:
        self.parts.append((ids, weights, rows))
        self.visits += visits

    def ready(self) -> None:
        if self.rows is None:
            self.ids, self.weights, self.rows = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.links, self.label = None, np.zeros(len(self.ids), np.int64), self.ids.copy()

    def meet(self, mid, mw, mrows, homes):
        """Home rows against other members; yields what visitors learn here and the edges of components."""
        self.ready()
        near = (self.rows @ mrows.T) >= self.threshold
        near &= self.ids[:, None] != mid[None, :]
        rows, cols = near.any(axis=1), near.any(axis=0)
        if not rows.any():
            return
        self.links += near @ mw
        for other in np.unique(homes[cols & (homes != self.cell)]):
            # visitors whose own cell the home row does not visit learn of the link here
            unseen = np.array([other not in v for v in self.visits])
            at = np.nonzero(cols & (homes == other))[0]
            gained = self.weights @ (near[:, at] & unseen[:, None])
            yield record(mid[at][gained > 0], gained[gained > 0], [None] * int((gained > 0).sum()))
        a, old = near[np.ix_(rows, cols)], self.label[rows]
        top = np.iinfo(np.int64).max
        hl, ml = old.copy(), mid[cols].copy()
        while True:
            m2 = np.minimum(ml, np.where(a, hl[:, None], top).min(axis=0))
            h2 = np.minimum(hl, np.where(a, m2[None, :], top).min(axis=1))
            if (m2 == ml).all() and (h2 == hl).all():
                break
            ml, hl = m2, h2
        self.label[rows] = hl
        edges = np.concatenate([np.stack([mid[cols], ml], 1), np.stack([old, hl], 1)])
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        yield record(edges[:, 0], np.zeros(len(edges), np.int64), edges[:, 1])

    def among_home(self):
        self.ready()
        for s in range(0, len(self.ids), BATCH):
            p = slice(s, s + BATCH)
            yield from self.meet(self.ids[p], self.weights[p], self.rows[p], np.full(len(self.ids[p]), self.cell))

    def finished(self):
        moved = self.label != self.ids
        yield record(np.concatenate([self.ids, self.ids[moved]]), np.concatenate([self.links, np.zeros(moved.sum(), np.int64)]), [None] * len(self.ids) + self.label[moved].tolist())


def compared(batches, threshold: float):
    """Rows come block by block, home rows first. Yields link counts and component edges."""
    now, block, begun = None, None, False

    def ended():
        if block is not None and (block.parts or block.rows is not None):
            if not begun:
                yield from block.among_home()
            yield from block.finished()

    for b in batches:
        cell, number, at_home = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ids, weights, homes = (b.column(i).to_numpy() for i in (3, 4, 6))
        values, offsets = b.column(5).values.to_numpy(zero_copy_only=False), b.column(5).offsets.to_numpy()
        cut = np.nonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(at_home.astype(np.int8)) != 0))[0] + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
            if s == e:
                continue
            if (cell[s], number[s]) != now:
                yield from ended()
                now, block, begun = (cell[s], number[s]), Block(int(cell[s]), threshold), False
            for lo in range(s, e, BATCH):
                hi = min(e, lo + BATCH)
                rows = unit(values[offsets[lo] : offsets[hi]].reshape(hi - lo, -1).astype(np.float64))
                if at_home[lo]:
                    block.add(ids[lo:hi], weights[lo:hi], rows, [set(x) for x in b.column(7).slice(lo, hi - lo).to_pylist()])
                elif block.parts or block.rows is not None:
                    if not begun:
                        yield from block.among_home()
                        begun = True
                    yield from block.meet(ids[lo:hi], weights[lo:hi], rows, homes[lo:hi])
    yield from ended()


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, queries: int = 500) -> float:
    """The share of the links of ``queries`` vectors, compared with every row, that ``found`` counts."""
    v = renamed(vectors, id=id_col, vec=vec_col).where("id is not null and vec is not null").orderBy(F.xxhash64("id")).limit(queries).toPandas()
    q, ids = unit(np.array(v["vec"].tolist(), np.float64)), v["id"].to_numpy()

    def count(batches):
        for b in batches:
            rows = unit(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
            near = ((q @ rows.T) >= threshold) & (ids[:, None] != b.column(0).to_numpy()[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.sum(axis=1))], ["id", "n"])

    rows = renamed(vectors, id=id_col, vec=vec_col).where("id is not null and vec is not null").select("id", F.col("vec").cast("array<double>"))
    true = rows.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = true.join(found, F.col("id") == F.col("vec_id")).agg(F.sum(F.least("n", "n_links")).alias("g"), F.sum("n").alias("n")).first()
    return (got.g or 0) / got.n if got.n else 1.0
